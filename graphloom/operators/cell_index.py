"""A vector index on disk: cells as folders, the centroids as a table, versions.

Below the index's folder: `v=N/cells/cell=C` (key, vector) and `v=N/centroids` (cell,
centroid) of version N, and `about`, one row a version: its rows, those left out, dimension,
probes and names.  That row is written last, so a version that isn't whole isn't opened.
`ids` of an opened index is its manifest: key and cell, read from the cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.similarity import assign_cells, nearest, nearest_of_all

ABOUT = "version long, rows long, skipped long, dimension int, probes int, key string, embedding string"
#: Vectors in one file of a large cell, about.
FILE_ROWS = 100_000


@dataclass
class CellIndex:
    """An opened version; a search reads the folders of the cells that it probes."""

    spark: SparkSession
    path: str
    version: int
    rows: int
    skipped: int
    dimension: int
    probes: int
    key: str
    embedding: str

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.version}/cells")

    @property
    def ids(self) -> DataFrame:
        return self.cells.select(self.key, "cell")

    @property
    def centroids(self) -> np.ndarray:
        """One row a cell; at most as many as the quantiser makes (4096)."""
        found = self.spark.read.parquet(f"{self.path}/v={self.version}/centroids").orderBy("cell").collect()
        return np.array([r["centroid"] for r in found]).reshape(len(found), -1)

    def probed(self, queries: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Cells next to each query, the nearest first."""
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, : probes or self.probes]

    def search(self, query: list[float], k: int, probes: int | None = None, skip: object = None) -> DataFrame:
        """The k vectors of greatest inner product with one query, from the folders of its cells."""
        found = [int(c) for c in self.probed(np.array([query], float), probes)[0]]
        return nearest(self.cells.where(F.col("cell").isin(found)), query, self.key, self.embedding, k, skip)

    def search_all(self, k: int, every: int = 20, probes: int | None = None) -> DataFrame:
        """query_id, key, score: the k nearest of each indexed vector whose key is divisible by `every`."""
        return nearest_of_all(self.cells, self.key, self.embedding, k, every, (self.cells, self.centroids.tolist(), probes or self.probes))


def write_cell_index(vectors: DataFrame, key: str, embedding: str, path: str, allowed: DataFrame | None = None, recall: float = 0.95, k: int = 10) -> CellIndex:
    """Writes the next version of the index: vectors of one dimension, of the allowed keys if given.

    The dimension is that of the vector of least key.  Rows without a key, of other dimensions,
    or with a null in the vector are counted as skipped.  The quantiser is fitted on a
    bounded sample and every row is indexed; a cell's rows are dealt to files by key, so
    that a cell with a large share of all rows is written by many tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(key, embedding)
    first = rows.where(F.col(key).isNotNull() & F.col(embedding).isNotNull()).agg(F.min_by(F.size(embedding), key)).first()[0] or 0
    good = rows.where(F.col(key).isNotNull() & (F.size(embedding) == first) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x)))
    if allowed is not None:
        good = good.join(allowed.select(key).distinct(), key, "left_semi")
    indexed, centroids, probes = assign_cells(good, key, embedding, recall=recall, k=k)
    version = newest(spark, path) + 1
    folder = f"{path}/v={version}"
    sizes = indexed.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("files"))  # a row a cell
    spread = indexed.join(sizes, "cell").withColumn("file", F.pmod(F.xxhash64(key), F.col("files")))
    spread.repartition("cell", "file").select(key, embedding, "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/cells")
    spark.createDataFrame([(c, list(map(float, x))) for c, x in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    held = spark.read.schema(f"{key} {vectors.schema[key].dataType.simpleString()}, cell int").parquet(f"{folder}/cells").count()
    about = (version, held, rows.count() - held, int(first), int(probes), key, embedding)
    spark.createDataFrame([about], ABOUT).coalesce(1).write.mode("append").parquet(f"{path}/about")
    return open_cell_index(spark, path, version)


def newest(spark: SparkSession, path: str) -> int:
    """The last version whose writing ended; 0 if there is none."""
    try:
        return spark.read.schema(ABOUT).parquet(f"{path}/about").agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def open_cell_index(spark: SparkSession, path: str, version: int | None = None) -> CellIndex:
    """A version, the newest by default; LookupError if there is none."""
    version = newest(spark, path) if version is None else version
    found = spark.read.schema(ABOUT).parquet(f"{path}/about").where(F.col("version") == version).collect() if version else []
    if not found:
        raise LookupError(f"no version {version or ''} of an index in {path}")
    return CellIndex(spark, path, **found[0].asDict())
