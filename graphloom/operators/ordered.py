"""Ordered analytics: fill-forward, top-k, rolling means, first seen, ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import coerce, is_nothing
from graphloom.operators.carry import carried_forward
from graphloom.session import scratch


def fill_forward(df: DataFrame, value: str, keys: list[str], order: list[Column], nothing: str = "None", out: str | None = None, ranges: int = 0) -> DataFrame:
    """The last value before or at each row; nulls and the string `nothing` are filled, `nothing` is left at the start.

    One window a key, or with `ranges` in as many ranges of (keys, order), for keys of any size.
    """
    if ranges:
        filled = carried_forward(df, F.nullif(F.col(value), F.lit(nothing)), keys, order, "_filled", ranges)
        return filled.withColumn(out or value, F.coalesce("_filled", F.lit(nothing))).drop("_filled")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out or value, F.coalesce(F.last(F.nullif(F.col(value), F.lit(nothing)), ignorenulls=True).over(w), F.lit(nothing)))


def sticky_fill(df: DataFrame, value: str, keys: list[str], order: list[Column], default: str = "not stated") -> DataFrame:
    """value filled from the last stated one, the original kept, and how it was found.

    Adds {value}_original and {value}_method: original, context_sticky or unresolved.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    text = coerce(F.col(value))
    stated = F.when(~is_nothing(text), text)
    last = F.last(stated, ignorenulls=True).over(w)
    return df.withColumns(
        {
            f"{value}_original": F.col(value),
            f"{value}_method": F.when(stated.isNotNull(), "original").when(last.isNotNull(), "context_sticky").otherwise("unresolved"),
            value: F.coalesce(last, F.lit(default)),
        }
    )


def ordinal(df: DataFrame, keys: list[str], order: list[Column], out: str = "ordinal") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def top_k(df: DataFrame, k: int, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """The first k rows of each key; the planner limits each partition before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)


def rolling_mean(df: DataFrame, value: str, keys: list[str], order: list[Column], width: int = 15, out: str = "rolling") -> DataFrame:
    """Mean over `width` rows around each row, of those that there are."""
    half = width // 2
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, width - 1 - half)))


def first_seen(df: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """For each key the values of its first row by `order`; an aggregate, not a sort."""
    place = F.struct(*[F.col(c) for c in order])
    return df.groupBy(key).agg(*[F.min_by(v, place).alias(v) for v in values])


def distinct_slugs(df: DataFrame, slug: str, number: str, out: str = "unique_slug") -> DataFrame:
    """A slug of its own for each number, as if they came by ascending number.

    A slug that a lesser number has is followed by `-number`, again if that is taken too.  A
    slug once taken by a lesser number stays taken by one, so all numbers may move at once:
    in each round, of the rows with one slug, all but the least number move on.  Only the
    slugs of rows that moved are looked at again; the rounds end when none does.
    """
    spark, folder = df.sparkSession, scratch(df.sparkSession)

    def kept(frame: DataFrame, k: int) -> DataFrame:
        frame.write.parquet(f"{folder}/{k}")
        return spark.read.parquet(f"{folder}/{k}")

    losers = lambda rows: rows.groupBy("slug").agg(F.min("n").alias("least"), F.count("*").alias("many")).where("many > 1")
    start = df.select(F.col(slug).alias("slug"), F.col(number).alias("n")).distinct()
    crowded = losers(start)
    lost = start.join(crowded, "slug").where("n > least")
    moved, k = kept(lost.select(F.concat_ws("-", "slug", F.col("n").cast("string")).alias("slug"), "n"), 0), 0
    while not moved.isEmpty():
        # what has one of the moved rows' slugs now: rows that never moved, rows that moved
        never = start.join(moved.select("n"), "n", "left_anti").join(moved.select("slug").distinct(), "slug", "left_semi")
        again = losers(never.union(moved.select("slug", "n")))
        beaten = never.union(moved.select("slug", "n")).join(again, "slug").where("n > least").select("slug", "n")
        step = beaten.select(F.concat_ws("-", "slug", F.col("n").cast("string")).alias("slug"), "n")
        k += 1
        step = kept(step, 2 * k - 1)
        if step.isEmpty():
            break
        moved = kept(moved.join(step.select("n"), "n", "left_anti").select("slug", "n").union(step), 2 * k)
    found = moved.select(F.col("n").alias(number), F.col("slug").alias("_moved"))
    return df.join(found, number, "left").withColumn(out, F.coalesce("_moved", F.col(slug))).drop("_moved")


def numeric_suffix(id: Column, separator: str = "_") -> Column:
    """The number behind the last separator of an id, to sort by; null (first) if there is none."""
    return F.substring_index(id, separator, -1).try_cast("long")


def category_rank(x: Column, order: list[str]) -> Column:
    """Place of a category in an explicit order; others and null come after them."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), x)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def running_total(df: DataFrame, order: str, value: str, out: str, parts: int = 64) -> DataFrame:
    """df with the sum of `value` over all rows before each, over ranges of the order.

    Ranges are summed apart and their totals, one row a range, added up; equal places in the
    order must be one row.
    """
    ranged = df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id())
    path = f"{scratch(df.sparkSession)}/ranges"
    ranged.write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    totals = held.groupBy("_range").agg(F.sum(value).alias("_sum"))  # a row a range
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return held.join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_range", "_sum", "_before")
