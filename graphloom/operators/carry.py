"""Values carried forward over rows of any number, in ranges that may cut a key in two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import scratch


def carried_forward(df: DataFrame, value: Column, keys: list[str], order: list[Column], out: str, parts: int | None = None) -> DataFrame:
    """df with the last value, at or before each row of its key, that isn't null.

    Rows are dealt to ranges of (keys, order), so that a key of any size is spread over tasks,
    and written once.  A range fills its own rows; what it begins with comes from the ranges
    before it, of which only the last values are looked at, a row a key and range for keys
    that lie in several.  Without a value so far: null.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark)
    ranged = df.withColumn("_value", value).repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    held = spark.read.parquet(path)
    own = Window.partitionBy("_range", *keys).orderBy(*order)
    until, whole = (own.rowsBetween(Window.unboundedPreceding, e) for e in (0, Window.unboundedFollowing))
    filled = held.withColumns({out: F.last("_value", ignorenulls=True).over(until), "_last": F.last("_value", ignorenulls=True).over(whole)})
    ends = filled.groupBy("_range", *keys).agg(F.first("_last").alias("_end"))
    names = {c: f"_key{k}" for k, c in enumerate(["_range", *keys])}
    ends = ends.withColumnsRenamed(names)
    its = [names[c] for c in keys]
    # keys that lie in one range only have nothing to carry
    before = Window.partitionBy(*its).orderBy(names["_range"]).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).where("_carry IS NOT NULL").drop("_end")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    found = filled.join(carry, same, "left")
    return found.select(*[c for c in df.columns if c != out], F.coalesce(out, "_carry").alias(out))
