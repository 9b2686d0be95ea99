"""Rewriting and checking line-based quad dumps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import humanise, nt_unescape, slug
from graphloom.operators.ordered import distinct_slugs


def drop_lines(lines: DataFrame, *needles: str, line: str = "line") -> DataFrame:
    """Lines that mention none of the strings, anywhere."""
    for needle in needles:
        lines = lines.where(~F.coalesce(F.col(line).contains(needle), F.lit(False)))
    return lines


def graph_of(line: Column) -> Column:
    """The graph, from the right end of a quad line."""
    return F.regexp_extract(line, r"(<[^<>]*>)\s*\.\s*$", 1)


def rewrite_iris(lines: DataFrame, mapping: DataFrame, pattern: str, line: str = "line") -> DataFrame:
    """IRIs that match the pattern replaced by mapping(old, new); others stay.

    Lines without such an IRI never reach the join.  A line goes by two 64-bit hashes of its
    text, so a partition that is computed again names it as before; equal lines are rewritten
    once.  Places within a line are kept by number.
    """
    hit = F.col(line).rlike(pattern)
    plain = lines.where(~F.coalesce(hit, F.lit(False)))
    numbered = lines.where(hit).withColumn("_n", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")))
    found = numbered.dropDuplicates(["_n"]).select("_n", F.posexplode(F.regexp_extract_all(line, F.lit(f"({pattern})"), F.lit(1))).alias("_k", "_x"))
    new = found.join(mapping.select(F.col("old").alias("_x"), F.col("new").alias("_y")), "_x", "left")
    iris = new.groupBy("_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_y", "_x").alias("v")))), lambda s: s["v"]).alias("_v"))
    between = F.split(line, pattern, -1)
    text = F.array_join(F.zip_with(between, "_v", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = numbered.join(iris, "_n").withColumn(line, text).drop("_n", "_v")
    return plain.unionByName(done.select(*plain.columns))


def complete_labels(quads: DataFrame, kind: str, label: str, base: str, graph: str) -> DataFrame:
    """(s, p, o, g) rows for subjects under `base` without a label or type: humanised names, first letters up."""
    mine = quads.where(F.col("s").startswith(base)).select("s").distinct()
    tail = F.substr(F.col("s"), F.lit(len(base) + 1))
    literal = lambda c: F.struct(F.lit("literal").alias("kind"), c.alias("value"), F.lit(None).cast("string").alias("datatype"), F.lit("en").alias("lang"))
    has = lambda p: quads.where(F.col("p") == p).select("s")
    names = mine.join(has(label), "s", "left_anti").select("s", F.lit(label).alias("p"), literal(humanise(tail)).alias("o"), F.lit(graph).alias("g"))
    iri = F.struct(F.lit("iri").alias("kind"), F.lit(kind).alias("value"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    types = mine.join(has("rdf:type"), "s", "left_anti").select("s", F.lit("rdf:type").alias("p"), iri.alias("o"), F.lit(graph).alias("g"))
    return names.unionByName(types)


def pseudonymise(lines: DataFrame, predicate: str, subject: str, line: str = "line") -> DataFrame:
    """Name literals of a predicate replaced by `"Interview <id>"`, the language tag kept."""
    pattern = rf'^(<{subject}(\d+)>\s+<{predicate}>\s+)"[^"\\]*+(?:\\.[^"\\]*+)*+"(@[a-z]+)?'
    return lines.withColumn(line, F.when(F.col(line).contains(predicate), F.regexp_replace(line, pattern, '$1"Interview $2"$3')).otherwise(F.col(line)))


class Contaminated(ValueError):
    """A dump holds what it must not."""


def forbidden(lines: DataFrame, patterns: list[str], line: str = "line") -> DataFrame:
    """The lines that match any of the patterns."""
    return lines.where(F.col(line).rlike("|".join(f"(?:{p})" for p in patterns))).select(line)


def gate(lines: DataFrame, patterns: list[str], line: str = "line") -> None:
    """Raises on the first line that matches a forbidden pattern; stops reading there."""
    found = forbidden(lines, patterns, line).take(1)
    if found:
        raise Contaminated(found[0][0][:200])


def check_counts(before: int, after: int, dropped: int) -> None:
    """Raises unless every line is either kept or dropped."""
    if before != after + dropped:
        raise Contaminated(f"{before} lines in, {after} out, {dropped} dropped")


def slug_map(dumps: list[DataFrame], number: str, label: str, base: str, line: str = "value") -> DataFrame:
    """old, new: addresses by name for numbered ones, over several dumps.

    `number` is a pattern whose group is the number; the label of a number is that of the first
    dump that has one (the least of several there).  Slugs are made distinct as by
    ascending number (`distinct_slugs`).
    """
    iri, told = f"<({number})>", []
    for k, lines in enumerate(dumps):
        rows = lines.where(F.col(line).contains(f"<{label}>") & F.col(line).rlike(f"^{iri}"))
        name = nt_unescape(F.regexp_extract(line, r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1))
        told.append(rows.select(F.regexp_extract(line, f"^{iri}", 1).alias("old"), F.regexp_extract(line, f"^{iri}", 2).cast("long").alias("n"), name.alias("name"), F.lit(k).alias("dump")))
    every = reduce(DataFrame.unionByName, told)
    first = every.groupBy("old", "n").agg(F.min(F.struct("dump", "name"))["name"].alias("name"))
    named = distinct_slugs(first.withColumn("slug", slug(F.col("name"))), "slug", "n", "unique")
    return named.select("old", F.concat(F.lit(base), "unique").alias("new"))
