"""The pipeline and the registered queries against brute force on the smallest tables."""

import zlib

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from graphloom.llm.oracle import ORACLE
from graphloom.llm.queries import QUERIES
from oracle_check import connection, same


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            kept = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if name == "n-gram Jaccard join":
            assert set(kept) == {i for i, _, c in brute.jaccard_components(list(before.items())) if i == c}
        if name == "substring dedup":
            rows = list(before.items())
            assert kept == {i: (" ".join(w) if n else t) for (i, t), (_, w, n) in zip(rows, brute.kept_words(rows, 20))}
    assert {r["doc_id"] for r in docs.collect()} == set(kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "substring dedup", "best-fit packing"]


def test_one_row_of_near_copies(spark):
    x, y, z = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red green blue white black brown grey pink")
    rows = [
        (1, x, "a"), (1, x, "b"), (1, x, "b"), (2, x.upper(), "c"), (1, y, "d"), (3, y, "e"), (0, y, "f"), (1, z, "g"), (None, z, "h"),
        (None, "only null ids with this text here", "i"), (None, "only null ids with this text here", "j"), (5, "", "k"), (5, "", "k"), (None, None, "l"),
    ]
    got = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert got.columns == ["doc_id", "text", "source"]
    want = [(1, x, "a"), (0, y, "f"), (1, z, "g"), (None, "only null ids with this text here", "i"), (5, "", "k"), (5, "", "k"), (None, None, "l")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_stages_on_odd_tables(spark, sf_dir, tmp_path):
    """Nulls, empty and repeated texts, repeated and null ids, columns named like the stages' own; and no rows at all."""
    good = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None), (None, ""), (5, None), (900001, "the same words twice in the table here"), (900001, "the same words twice in the table here")], "doc_id long, text string")
    rows = good.unionByName(odd, allowMissingColumns=True)
    for name in ("_score", "_key", "_row", "_bucket", "many", "least", "score"):
        rows = rows.withColumn(name, F.lit(7))
    rows = rows.withColumns({"a.b": F.lit("dot"), "c`d": F.lit(1.5), "map": F.create_map(F.lit("k"), F.col("doc_id"))})
    for empty in (False, True):
        docs = rows.limit(0) if empty else rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{empty}-{k}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if k < 4:
                assert docs.columns == rows.columns
                assert docs.where("_score <> 7 OR _key <> 7 OR _row <> 7 OR many <> 7 OR least <> 7").count() == 0
        assert (docs.count() == 0) == empty


def test_run_rereads_what_stages_wrote(spark, sf_dir, monkeypatch):
    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs.where("doc_id > 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    assert corpus_pipeline.run(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id > 0").count()
    assert not set(read[0]) & set(read[1]) and not set(read[1]) & set(read[2])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLE[name])


@pytest.mark.parametrize("name,label,cut", [("op7_toxicity", "toxic", 0.5), ("op9_quality", "quality", 0.3)])
def test_held_out(spark, name, label, cut):
    sf_dir = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()}
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held)
    assert all(r["predicted"] == int(r["score"] >= cut) for r in got.values())
    assert sum(got[i]["predicted"] == labels[i] for i in held) / len(held) > 0.9
