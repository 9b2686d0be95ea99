"""Corpus pipeline: documents in, packed training sequences out, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all
but the last return the columns of documents.  Null and empty texts are scored like texts
without features and link with nothing; null and repeated ids are documents of their own;
further columns stay as they are, whatever their names; an empty table gives empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce, wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard_join, packing, quality, substring_dedup, toxicity
from graphloom.llm.frames import checkpointed, free_name, shared_folder, table


def with_plain_names(stage: Callable) -> Callable:
    """The stage with columns whose names aren't plain words (`a.b`) renamed while it works."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain: list[str] = []
        for c in docs.columns:
            plain.append(c if c.replace("_", "x").isalnum() else free_name([*docs.columns, *plain], "_c"))
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*docs.columns)

    return run


@with_plain_names
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below a half."""
    model, score = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")), free_name(docs.columns, "_score")
    return toxicity.score_toxicity(docs, model, out=score).where(F.col(score) < 0.5).drop(score)


@with_plain_names
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that rank above the quality threshold."""
    model, score = quality.fit_quality(docs, table(spark, sf_dir, "labels"), cut=0.3), free_name(docs.columns, "_score")
    return quality.score_quality(docs, model, out=score).where(F.col(score) >= 0.3).drop(score)


@with_plain_names
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of Jaccard similarity 0.8 or more: that of least id.

    Null ids come last; of rows with one id the least hash of the text, and of rows with one
    id and text the least row stays.  Texts without words link with nothing and all stay.
    """
    text, own, row = F.col("text"), free_name(docs.columns, "_key"), free_name(docs.columns, "_row")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))
    classes = jaccard_join.similarity_classes(docs.select(key.alias("doc_id"), "text"))
    held = classes.where("n_shingles = 0 OR doc_id = component_id").groupBy("doc_id").agg(F.max("n_shingles").alias("size"), F.count("*").alias("n"))
    held = checkpointed(held.select(F.col("doc_id").alias(row), (F.expr("n > 1 AND size > 0")).alias("many")))
    keyed = docs.withColumn(own, key)
    # each field apart, so that null ids meet
    same = reduce(lambda x, y: x & y, [F.col(f"{own}.{c}").eqNullSafe(F.col(f"{row}.{c}")) for c in ("id", "h", "g")])
    kept = keyed.join(held.where("NOT many").select(row), same, "left_semi").select(docs.columns)
    many = held.where("many").select(row)
    if many.isEmpty():
        return kept
    # rows are told apart by what they hold, as text; maps and the like have no order
    whole = F.struct(*docs.columns)
    one = keyed.join(many, same, "left_semi").groupBy(own).agg(F.min_by(whole, F.to_json(whole)).alias("least"))
    return kept.union(one.select(*(F.col("least")[c].alias(c) for c in docs.columns)))


@with_plain_names
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words of 20-word windows that start earlier."""
    return substring_dedup.without_repeated_words(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents, packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram Jaccard join", one_of_near_copies),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Learned models and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole documents table; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
