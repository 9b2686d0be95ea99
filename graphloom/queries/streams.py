"""Streams over the test tables, each run to the end of what is there and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.queries.registry import query, table
from graphloom.session import scratch
from graphloom.streaming.stateful import resolve_in_order
from graphloom.streaming.store import KeyedStore


def _as_stream(rows: DataFrame, folder: str, files: int = 4) -> DataFrame:
    """The rows as a stream of files, one a batch."""
    rows.repartition(files).write.parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("SELECT o_custkey, o_orderkey AS newest, o_totalprice AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def stream_merged_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream, merged by customer batch by batch, and all of it once more: each batch counts once."""
    folder = scratch(spark)
    stream = _as_stream(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), f"{folder}/in")
    store = KeyedStore(spark, f"{folder}/store", stream.schema, "o_custkey", "o_orderkey")
    for k in range(2):  # without its checkpoint the stream begins again, with the same batch numbers
        store.follow(stream, f"{folder}/checkpoint-{k}")
    return store.rows().select("o_custkey", F.col("o_orderkey").alias("newest"), F.col("o_totalprice").alias("total"))


def mentions_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention an event, of its user as the survivor."""
    who = F.expr("CASE event_type WHEN 'click' THEN 'my father' WHEN 'purchase' THEN 'he' WHEN 'error' THEN 'they' WHEN 'signup' THEN concat('Anna ', event_id % 7) ELSE 'I' END")
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.select("user_id", "at", F.col("event_id").alias("place"), who.alias("who"), F.concat(F.lit("S"), "user_id").alias("survivor"), F.lit("M").alias("gender"))


@query()
def coref_stream_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of events as a stream of files in no order; the tests compare it with the batch answer.

    The watermark is as late as the events span, since the files are in no order, and a last
    file with one row far ahead lets it pass all others.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, rows = scratch(spark), mentions_of_events(spark, sf_dir)
    stream = _as_stream(rows, f"{folder}/in", 3)
    last = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.to_timestamp(F.lit("2200-01-01")).alias("at"), F.lit(-1).cast("long").alias("place"), *[F.lit(None).cast("string").alias(c) for c in ("who", "survivor", "gender")])
    last.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    found = resolve_in_order(stream, "user_id", "at", "place", "who", "survivor", "gender", late="36500 days")
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out").withColumnRenamed("key", "user_id")
