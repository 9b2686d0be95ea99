"""Quad dumps, marts, idempotent appends."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import nt_escape


def term_text(o: Column) -> Column:
    """A term as it stands in a line."""
    literal = F.concat(F.lit('"'), nt_escape(o["value"]), F.lit('"'), F.when(o["lang"].isNotNull(), F.concat(F.lit("@"), o["lang"])).when(o["datatype"].isNotNull(), F.concat(F.lit("^^<"), o["datatype"], F.lit(">"))).otherwise(""))
    return F.when(o["kind"] == "iri", F.concat(F.lit("<"), o["value"], F.lit(">"))).when(o["kind"] == "blank", o["value"]).otherwise(literal)


def quad_lines(quads: DataFrame) -> DataFrame:
    iri = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    return quads.select(F.concat_ws(" ", iri("s"), iri("p"), term_text(F.col("o")), iri("g"), F.lit(".")).alias("value"), "g")


def write_quads(quads: DataFrame, path: str) -> int:
    """Writes distinct quads, a folder a graph; returns how many, counted while writing."""
    seen = Observation()
    lines = quad_lines(quads.dropDuplicates()).observe(seen, F.count("*").alias("n"))
    lines.write.mode("overwrite").partitionBy("g").text(path)
    return seen.get["n"]


def load_once(quads: DataFrame, path: str, guard: int = 1_000_000) -> bool:
    """Adds quads to a Parquet store by graph and predicate unless it has more than `guard` already.

    What the store has stays, and what it has already isn't added again.
    """
    spark, new = quads.sparkSession, quads.dropDuplicates()
    try:
        held = spark.read.schema(quads.schema).parquet(path)
        if held.count() > guard:
            return False
        same = reduce(lambda a, b: a & b, [new[c].eqNullSafe(held[c]) for c in new.columns])
        new = new.join(held, same, "left_anti")
    except AnalysisException as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").partitionBy("g", "p").parquet(path)
    return True


def write_marts(spark: SparkSession, builders: dict[str, Callable[[], DataFrame]], folder: str, only: list[str] | None = None, dry_run: bool = False) -> list[str]:
    """Materialises the named results as JSON; returns the names."""
    names = [n for n in builders if only is None or n in only]
    for n in names:
        if not dry_run:
            builders[n]().write.mode("overwrite").json(f"{folder}/{n}")
    return names


def write_ranges(rows: DataFrame, path: str, key: str, order: str) -> None:
    """Parquet files by ranges of the key, in order: as many as there are partitions, not keys.

    A filter on the key skips files and row groups by their statistics; a key with many rows
    fills several files, cut by `order`.
    """
    rows.repartitionByRange(key, order).sortWithinPartitions(key, order).write.parquet(path)


def write_csv(rows: DataFrame, path: str, order: list[str], blank: list[str] = ()) -> None:
    """A template to be filled in: rows in order in one file, with empty columns `blank`."""
    made = rows.select("*", *[F.lit("").alias(c) for c in blank]).orderBy(*order)
    made.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_turtle(links: DataFrame, path: str, subject: str, target: str, predicate: str = "skos:exactMatch", prefixes: dict[str, str] | None = None) -> None:
    """Links as Turtle statements under their prefixes, sorted by subject and target, in one file."""
    head = [f"@prefix {k}: <{v}> ." for k, v in (prefixes or {"skos": "http://www.w3.org/2004/02/skos/core#"}).items()]
    line = F.format_string(f"<%s> {predicate} <%s> .", subject, target)
    spark = links.sparkSession
    rows = links.select(F.lit(1).alias("part"), F.col(subject).alias("s"), F.col(target).alias("t"), line.alias("value")).distinct()
    first = spark.createDataFrame([(0, f"{k:03}", "", h) for k, h in enumerate(head)], rows.schema)
    first.unionByName(rows).orderBy("part", "s", "t").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_report(figures: DataFrame, path: str, **about: object) -> None:
    """A report of one row as JSON, with what the run was about."""
    figures.select(*[F.lit(v).alias(k) for k, v in about.items()], "*").coalesce(1).write.mode("overwrite").json(path)


def kept_for(spark: SparkSession, folder: str, name: str, seconds: float, build: Callable[[], DataFrame], now: float | None = None) -> DataFrame:
    """A result that is built again once the one written before is older than `seconds`."""
    now = time.time() if now is None else now
    path = f"{folder}/{name}"
    try:
        held = spark.read.parquet(path)
        if now - (held.agg(F.max("_built")).first()[0] or 0) <= seconds:
            return held.drop("_built")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().withColumn("_built", F.lit(now)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("_built")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key: an upsert read from an append-only table."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done: what a resumed run has left."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def counted_write(rows: DataFrame, path: str) -> int:
    """Writes Parquet; returns the number of rows, counted while writing."""
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def write_counters(spark: SparkSession, counts: dict[str, int], path: str, **about: object) -> None:
    """Counters of a run as JSON lines, with what the run was about."""
    rows = spark.createDataFrame(list(counts.items()), "name string, n long")
    rows.select("*", *[F.lit(v).alias(k) for k, v in about.items()]).coalesce(1).write.mode("overwrite").json(path)
