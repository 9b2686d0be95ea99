"""Registered queries of the subpackage: thin contracts over its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, compaction, conversations, embedding_dedup, fingerprint, jaccard_join, packing, pii, quality, substring_dedup, suffix_dedup, toxicity, url_filter
from graphloom.llm.corpus_rules import URL_RULES
from graphloom.llm.frames import table
from graphloom.llm.linear import fold


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_filter.rules_frame(spark, URL_RULES)
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_word_digests(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def embedding_links_at_038(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join at a threshold that some vectors of every table reach: at 0.9 most tables have no link at all."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.38)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def packing_with_three_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packing with at most 8 documents and half of the attention cost of one full document a sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), max_documents=8, max_cost=2048.0**2 / 2)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"))


def _verdicts(scored: DataFrame, cut: float) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _verdicts(toxicity.score_toxicity(docs, model), 0.5)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_byte_digests(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return _verdicts(quality.score_quality(docs, model), 0.3)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compacted(table(spark, sf_dir, "clicks"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_fingerprints": op2_fingerprints,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "embedding_links_at_038": embedding_links_at_038,
    "op5_best_fit_packing": op5_best_fit_packing,
    "packing_with_three_capacities": packing_with_three_capacities,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_pii": op11_pii,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_compaction": op13_compaction,
}
