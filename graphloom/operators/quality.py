"""Integrity checks and evaluation figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.stats import kappa, share


def orphans(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct keys of left that right doesn't have."""
    return left.select(F.col(left_key).alias("key")).distinct().join(right.select(F.col(right_key).alias("key")), "key", "left_anti")


def precision(judged: DataFrame, verdict: str, stratum: str, correct: str = "correct", incorrect: str = "incorrect", unsure: str = "unsure") -> DataFrame:
    """stratum, correct, incorrect, unsure, blank, precision (correct of the decided)."""
    said = F.lower(F.trim(F.coalesce(F.col(verdict), F.lit(""))))
    n = lambda what: F.count_if(said == what)
    return judged.groupBy(stratum).agg(
        n(correct).alias("correct"), n(incorrect).alias("incorrect"), n(unsure).alias("unsure"), n("").alias("blank"), share(n(correct), n(correct) + n(incorrect)).alias("precision")
    )


class TooManyBlanks(ValueError):
    """More rows are unjudged than allowed."""


def require_judged(figures: DataFrame, most: float = 0.05) -> None:
    """Raises if the share of blank verdicts is above `most`."""
    row = figures.agg(F.sum("blank"), F.sum(F.expr("correct + incorrect + unsure + blank"))).first()
    if row[1] and row[0] / row[1] > most:
        raise TooManyBlanks(f"{row[0]} of {row[1]} rows are not judged")


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """by, n, agreed, expected, kappa of two annotators' verdicts."""
    cells = pairs.groupBy(by, a, b).agg(F.count("*").alias("n"))
    size = cells.groupBy(by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(by, F.col(a).alias("v")).agg(F.sum("n").alias("r"))
    cols = cells.groupBy(by, F.col(b).alias("v")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, [by, "v"]).groupBy(by).agg(F.sum(F.col("r") * F.col("c")).alias("chance"))
    both = size.join(chance, by, "left")
    po, pe = F.col("same") / F.col("total"), F.coalesce("chance", F.lit(0)) / (F.col("total") * F.col("total"))
    return both.select(by, F.col("total").alias("n"), po.alias("agreed"), pe.alias("expected"), kappa(po, pe).alias("kappa"))


def presence_recall(pairs: DataFrame, gold: str, found: str, by: str) -> DataFrame:
    """by, gold_present, both_present, recall: how often something is found where the gold has something."""
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    n, both = F.count_if(has(gold)), F.count_if(has(gold) & has(found))
    return pairs.groupBy(by).agg(n.alias("gold_present"), both.alias("both_present"), share(both, n).alias("recall"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """A proportional sample: rounded quotas, the rounding error to the largest stratum, rows by a seeded hash."""
    counts = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    all_rows = Window.partitionBy()
    # one row a stratum
    quota = counts.withColumn("_q", F.bround(F.lit(size) * F.col("_n") / F.sum("_n").over(all_rows)))
    largest = F.row_number().over(Window.orderBy(F.desc("_n"), "_s")) == 1
    quota = quota.withColumn("_q", F.when(largest, F.col("_q") + size - F.sum("_q").over(all_rows)).otherwise(F.col("_q")))
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    ranked = rows.withColumn("_r", F.row_number().over(w))
    return ranked.join(quota, ranked[stratum].eqNullSafe(quota["_s"])).where("_r <= _q").drop("_s", "_n", "_q", "_r")


def averages(figures: DataFrame, value: str = "precision") -> DataFrame:
    """One row from `precision`: macro (mean of the strata), micro, unsure_rate (of the judged), blank_rate."""
    total = lambda c: F.sum(c)
    judged = total("correct") + total("incorrect") + total("unsure")
    return figures.agg(
        F.avg(value).alias("macro"), share(total("correct"), total("correct") + total("incorrect")).alias("micro"),
        share(total("unsure"), judged).alias("unsure_rate"), share(total("blank"), judged + total("blank")).alias("blank_rate"),
    )


def totals(table: DataFrame, **figures: Column) -> DataFrame:
    """One row of figures, in one scan; zero where there is nothing to count."""
    return table.agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in figures.items()])


def facts(rows: DataFrame, key: str, first: dict[str, str], sets: dict[str, str], order: list[str]) -> DataFrame:
    """One row a key: the first value by `order` of some columns (nulls don't count), the sorted set of others."""
    place = F.struct(*[F.col(c) for c in order])
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(n) for n, c in first.items()]
    return rows.groupBy(key).agg(*firsts, *[F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()])


def dangling(links: DataFrame, to: str, nodes: DataFrame, key: str) -> DataFrame:
    """One row: links, dangling (links whose end isn't a node, each time), orphans (the different ends)."""
    ends = links.groupBy(F.col(to).alias("_to")).agg(F.count("*").alias("_n"))
    missing = ends.join(nodes.select(F.col(key).alias("_to")).distinct().withColumn("_hit", F.lit(True)), "_to", "left")
    lost = F.col("_hit").isNull() & F.col("_to").isNotNull()
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return missing.agg(n(F.sum("_n")).alias("links"), n(F.sum(F.when(lost, F.col("_n")))).alias("dangling"), n(F.count_if(lost)).alias("orphans"))


def simple_sample(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows by a seeded hash of their key; ties by the key itself."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(size)
