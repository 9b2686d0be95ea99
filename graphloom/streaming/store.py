"""A keyed store that a stream merges into, exactly once a batch.

Below the store's folder: `data/in_bucket=B/as_of=V`, the rows of a bucket of keys as version V has
them, and `ledger`, one row a merged batch and bucket: batch, bucket, version.  A batch
reads and writes the buckets of its keys only; it counts once its rows are in the ledger, so a
batch that is replayed, or that failed before, changes nothing more.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

LEDGER = "batch long, bucket int, version long"


class KeyedStore:
    """The newest row of each key, by `order`; ties go to the greater row.  Columns can't be called in_bucket or as_of."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, order: str, buckets: int = 32):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path, schema, key, order, buckets

    def ledger(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def rows(self, buckets: DataFrame | None = None) -> DataFrame:
        """What the store has, of some buckets or of all: the folders that the ledger names last."""
        live = self.ledger().where("bucket IS NOT NULL").groupBy("bucket").agg(F.max("version").alias("v"))
        if buckets is not None:
            live = live.join(buckets, "bucket", "left_semi")
        named = [(r["bucket"], r["v"]) for r in live.collect()]  # at most one a bucket
        whole = StructType([*self.schema.fields]).add("in_bucket", IntegerType()).add("as_of", LongType())
        if not named:
            return self.spark.createDataFrame([], whole)
        held = self.spark.read.schema(whole).option("basePath", f"{self.path}/data")
        return held.parquet(*[f"{self.path}/data/in_bucket={b}/as_of={v}" for b, v in named])

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Upserts a batch; False if it was merged before.  Rows without a key are left out."""
        if not self.ledger().where(F.col("batch") == number).isEmpty():
            return False
        columns = self.schema.fieldNames()
        fresh = batch.where(F.col(self.key).isNotNull()).select(columns).withColumn("in_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        fresh = fresh.persist()  # asked for its buckets, then merged
        try:
            touched = fresh.select(F.col("in_bucket").alias("bucket")).distinct()
            every = self.rows(touched).select(*columns, "in_bucket").unionByName(fresh)
            row = F.struct(*columns)
            newest = every.groupBy("in_bucket", self.key).agg(F.max_by(row, F.struct(F.col(self.order), row)).alias("row")).select("row.*", "in_bucket", F.lit(number).cast("long").alias("as_of"))
            newest.repartition("in_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("in_bucket", "as_of").parquet(f"{self.path}/data")
            done = touched.select(F.lit(number).cast("long").alias("batch"), "bucket", F.lit(number).cast("long").alias("version"))
            empty = self.spark.createDataFrame([(number, None, None)], LEDGER)  # a batch without rows is one too
            done.union(empty).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        finally:
            fresh.unpersist()
        return True

    def follow(self, stream: DataFrame, checkpoint: str) -> int:
        """Merges all that the stream has now, batch by batch; the number of batches."""
        seen = []

        def step(batch: DataFrame, number: int) -> None:
            self.merge(batch, number)
            seen.append(number)

        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return len(seen)
