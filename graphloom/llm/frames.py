"""What all operators of the subpackage share: reading, buckets, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

_KINDS: dict[str, DataType] = {"double": DoubleType(), "string": StringType(), "binary": BinaryType(), "array<int>": ArrayType(IntegerType())}


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Arrow batches of at most so many rows and bytes from now on: bounds what a Python worker and its JVM hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame, name: str, kind: str) -> StructType:
    """df's schema with one more column."""
    return StructType([*df.schema.fields, StructField(name, _KINDS[kind])])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, as spark.checkpoint.dir names it.

    Without that setting a session on one machine gets a folder of its own; on a cluster,
    where executors don't share such a folder, that is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/graphloom-checkpoints/{uuid.uuid4().hex}")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the cluster's shared checkpoint folder; cuts the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidied(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of frames that nothing refers to any more.

    It learns of them when the driver's garbage is collected, which by itself may be long
    after a checkpoint made them useless.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(columns: list[str], name: str) -> str:
    """`name`, with underscores before it until no column is called so (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(columns: list[str]) -> list[str]:
    """The names as select() takes them, whatever they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def buckets(rows: int, each: int = 2000, least: int = 96) -> int:
    """How many buckets keep about `each` documents in one; grows with the input."""
    return max(least, -(-rows // each))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components by repeated minimum labels and pointer jumping.

    nodes(id), edges(a, b): undirected, both ends in nodes; repeated edges and loops do
    no harm.  Returns (id, component): the least id reachable.  Nodes without edges are
    their own components and take no part in the rounds.  Each round is a few hash
    aggregations with map-side partials; the joins are plain equi-joins that the
    adaptive planner may split when one label is hot.  Labels only fall, so the rounds end.
    """
    both = checkpointed(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    label = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id").select("id", F.least("component", "near").alias("next"), "component")
        jump = label.select(F.col("id").alias("next"), F.col("component").alias("root"))
        moved = checkpointed(step.join(jump, "next").select("id", F.least("next", "root").alias("next"), "component"))
        if moved.where("next <> component").isEmpty():
            break
        label = moved.select("id", F.col("next").alias("component"))
    return nodes.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def with_scores(docs: DataFrame, text: str, out: str, score) -> DataFrame:
    """docs with a double column `out`; score(bytes, offsets) -> one number a document.

    A narrow map in bounded chunks; a column already called `out` is replaced.
    """
    kept = docs.drop(out)
    small_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from graphloom.llm import arrays as A

        for batch in batches:
            data, off = A.flat(batch.column(text))
            parts = [score(d, o) for _, _, d, o in A.chunks(data, off)]
            values = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, widened(kept, out, "double"))
