"""Inverted index, ranked and typo-tolerant search, term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.stats import log_odds_z
from graphloom.functions.text import highlight, tokens
from graphloom.operators.ordered import top_k


def inverted_index(docs: DataFrame, key: str, text: str, stop: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """term, key, tf: how often each term (or each of `only`) is in each text; other terms end before the shuffle."""
    found = tokens(F.col(text), stop)
    if only is not None:
        found = F.filter(found, lambda t: t.isin(sorted(set(only))))
    return docs.select(key, F.explode(found).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def write_index(docs: DataFrame, key: str, text: str, path: str, stop: list[str] | None = None, parts: int = 64) -> None:
    """The index as Parquet, to be searched many times: terms dealt to `parts` folders, so that a search reads its terms' only."""
    index = inverted_index(docs, key, text, stop).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    index.repartition("part").sortWithinPartitions("term").write.mode("overwrite").partitionBy("part").parquet(path)


def read_index(spark: SparkSession, path: str, terms: list[str] | None = None, parts: int = 64) -> DataFrame:
    """A written index, or what it has of some terms: folders and row groups of others aren't read."""
    index = spark.read.parquet(path)
    if terms is not None:
        wanted = spark.createDataFrame([(t,) for t in sorted(set(terms))], "t string").select(F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int")).distinct()
        index = index.where(F.col("part").isin([r[0] for r in wanted.collect()]) & F.col("term").isin(sorted(set(terms))))  # as many as the query has words
    return index.drop("part")


def search(index: DataFrame, terms: list[str], key: str, total: int, typos: int = 0) -> DataFrame:
    """key, score of the texts that hold every term; score is the sum of tf * ln(1 + total / df).

    With typos, a term of five letters or more also matches index terms within that edit distance.
    """
    wanted = index.sparkSession.createDataFrame([(t,) for t in sorted(set(terms))], "wanted string")
    if typos:  # each distinct term meets the query's words once
        near = (F.col("term") == F.col("wanted")) | ((F.length("wanted") >= 5) & (F.levenshtein("term", "wanted", typos) >= 0))
        wanted = index.select("term").distinct().join(F.broadcast(wanted), near)  # as many rows as the query has words
        hits = index.join(wanted, "term")
    else:
        hits = index.join(F.broadcast(wanted), F.col("term") == F.col("wanted"))
    df = hits.groupBy("wanted").agg(F.count_distinct(key).alias("df"))
    scored = hits.groupBy("wanted", key).agg(F.sum("tf").alias("tf")).join(df, "wanted")
    return (
        scored.groupBy(key)
        .agg(F.count("*").alias("n"), F.round(F.sum(F.col("tf") * F.ln(1 + F.lit(total) / F.col("df"))), 6).alias("score"))
        .where(F.col("n") == len(set(terms)))
        .drop("n")
    )


def search_page(
    docs: DataFrame, hits: DataFrame, terms: list[str], key: str, text: str, keep: list[str], where: Column | None = None, order: list[Column] | None = None, limit: int = 20, offset: int = 0
) -> DataFrame:
    """One page of hits(key, score): keep, score, total (of all hits that pass) and the text with its matches marked.

    where filters the documents, order replaces that by score; ties go to the lesser key.
    Texts are marked for the page only.
    """
    found = (docs if where is None else docs.where(where)).join(hits, key)
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(*(order or [F.desc("score")]), F.asc(key)).offset(offset).limit(limit).join(F.broadcast(total))  # one row
    marked = F.col(text)
    for t in sorted(set(terms)):
        marked = highlight(marked, t)
    return page.select(*keep, "score", "total", marked.alias("marked"))


def label_lookup(labels: DataFrame, key: str, label: str, terms: list[str]) -> DataFrame:
    """key, label of the labels that hold every term, whatever the case."""
    found = inverted_index(labels.select(key, label), key, label, stop=[], only=[t.lower() for t in terms])
    every = found.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len({t.lower() for t in terms}))
    return labels.select(key, label).join(every.select(key), key, "left_semi")


def distribution(hits: DataFrame, links: DataFrame, on: str, dimension: str) -> DataFrame:
    """dimension, count of distinct hits: how the hits of a word spread over a dimension."""
    return hits.select(on).distinct().join(links, on).groupBy(dimension).agg(F.count_distinct(on).alias("hits"))


def surprising_terms(docs: DataFrame, group: str, text: str, least: int = 25, k: int = 50, stop: list[str] | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """group, term, score, in_count, rest_count: terms over-represented in a group against all others.

    group may be a column or the name of one.

    vocabulary(term), if given, holds the terms that count (for instance nouns).
    """
    words = docs.select(F.col(group).alias("group"), F.explode(tokens(F.col(text), stop)).alias("term"))
    if vocabulary is not None:
        words = words.join(vocabulary.select("term").distinct(), "term", "left_semi")
    # one shuffle by term: a row a term with its counts by group
    by_term = words.groupBy("term", "group").agg(F.count("*").alias("c1")).groupBy("term").agg(F.sum("c1").alias("c"), F.collect_list(F.struct("group", "c1")).alias("each"))
    each = by_term.select("term", "c", F.explode("each").alias("x")).select("x.group", "term", "x.c1", "c")
    by_group = each.groupBy("group").agg(F.sum("c1").alias("n1"))
    by_group = by_group.withColumn("n", F.sum("n1").over(Window.partitionBy()))  # a row a group
    c2, n2 = F.col("c") - F.col("c1"), F.col("n") - F.col("n1")
    scored = each.where(F.col("c1") >= least).join(by_group, "group").select(
        "group", "term", F.bround(log_odds_z(F.col("c1"), F.col("n1"), c2, n2), 4).alias("score"), F.col("c1").alias("in_count"), c2.alias("rest_count")
    )
    return top_k(scored, k, ["group"], [F.desc("score"), F.desc("term")]).drop("rank")
