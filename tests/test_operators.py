"""Operators on small fixtures: order, resolution, dumps, sources, evaluation, streams."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import coref, dump, ordered, quality, search, similarity
from graphloom.operators.pipeline_tables import build_quads, extract, select_ids, summary
from graphloom.plans.algebra import Graphs, Pattern, as_quads
from graphloom.sinks.writers import write_quads
from graphloom.sources import graphs, tables
from graphloom.sources.transcripts import paragraphs, transcripts
from graphloom.streaming.stateful import request_counts, resolve_stream


def test_fill_forward(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "INT"), (1, 3, None), (1, 4, "None"), (1, 5, "A")], "i int, k int, speakers string")
    got = [r["speakers"] for r in ordered.fill_forward(df, "speakers", ["i"], [F.asc("k")]).orderBy("k").collect()]
    assert got == ["None", "INT", "INT", "INT", "A"]


def test_sticky(spark):
    df = spark.createDataFrame([(1, k, w) for k, w in enumerate(["not stated", "Lviv", "", "Berlin", None])], "i int, k int, w string")
    got = [(r["w"], r["w_method"]) for r in ordered.sticky_fill(df, "w", ["i"], [F.asc("k")]).orderBy("k").collect()]
    assert got == [("not stated", "unresolved"), ("Lviv", "original"), ("Lviv", "context_sticky"), ("Berlin", "original"), ("Berlin", "context_sticky")]


def test_coref(spark):
    said = ["my father", "he", "I", "we", "I and my brother", "they", "his", "Anna", "it", "she", "", None]
    df = spark.createDataFrame([(1, k, w, "S", "M") for k, w in enumerate(said)], "i int, k int, who string, name string, sex string")
    got = [(r["who"], r["who_method"]) for r in coref.resolve_mentions(df, "i", ["k"], "who", "name", "sex").orderBy("k").collect()]
    assert got == [
        ("S's father", "rule_relational"), ("S's father", "coref_local"), ("S", "rule_self"), ("S and family", "rule_we"), ("S, S's brother", "rule_self_compound"),
        ("S and family", "coref_local"), ("S, S's brother's", "coref_local"), ("Anna", "original"), ("it", "original"), ("Anna", "coref_local"), ("", "empty"), ("", "empty"),
    ]


def test_first_seen_and_slugs(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 3)], "k string, v string, n int")
    assert {r["k"]: r["v"] for r in ordered.first_seen(df, "k", ["v"], ["n"]).collect()} == {"a": "y", "b": "z"}
    assert sorted(r["unique_slug"] for r in ordered.distinct_slugs(df, "k", "n").collect()) == ["a", "a-2", "b"]


def test_similar_edges(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [2.0, 0.0]), (1, 3, [0.0, 1.0]), (2, 4, [1.0, 0.0])], "g int, k int, v array<double>")
    assert [tuple(r) for r in similarity.similar_edges(df, "g", "k", "v", 1, 0.82).collect()] == [(1, 2, 1.0)]


def test_ann_recall(spark, sf_dir):
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    indexed, centroids, probes = similarity.assign_cells(rows, "vec_id", "embedding")
    assert indexed.where("cell IS NULL").count() == 0
    all_rows = rows.collect()
    x, ids = np.array([r["embedding"] for r in all_rows]), np.array([r["vec_id"] for r in all_rows])
    hits = []
    for q in (3, 17, 40, 99):
        v = x[ids == q][0]
        want = set(ids[np.argsort(-(x @ v), kind="stable")][:10].tolist())
        got = {r["vec_id"] for r in similarity.probe(indexed, centroids, probes, v.tolist(), "vec_id", "embedding", 10).collect()}
        hits.append(len(want & got) / 10)
    assert np.mean(hits) >= 0.9


def _recall(x, ids, cells, centroids, probes):
    """Share of the 10 nearest other rows of all ids divisible by 20 that lie in the probed cells."""
    import numpy as np

    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        want = np.argsort(-score, kind="stable")[:10]
        hits.append(np.isin(cells[want], np.argsort(-(np.array(centroids) @ x[i]), kind="stable")[:probes]).mean())
    return np.mean(hits)


@pytest.mark.parametrize("sample", [20_000, 2000])  # probes chosen on all rows, and on rows apart from the fitted ones
def test_ann_recall_of_many_cells(spark, sample):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    x = rng.normal(size=(10, 48))[rng.integers(0, 10, 8000)] * 0.3 + rng.normal(size=(8000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(8000), "embedding": list(x)}))
    indexed, centroids, probes = similarity.assign_cells(rows, "vec_id", "embedding", sample=sample)
    cells = indexed.select("vec_id", "cell").toPandas().sort_values("vec_id")["cell"].to_numpy()
    assert 0 < probes < len(centroids)
    assert _recall(x, np.arange(8000), cells, centroids, probes) >= 0.9


def test_nearest_of_all(spark, tmp_path):
    import numpy as np

    from graphloom.queries.statistics import ann_topk, knn_topk_of_all

    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 8)).round(2)
    x[200:500] = x[200]  # a common vector: ties
    ids = np.arange(900) + 4  # no id 3
    data = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(None, x[0].tolist()), (1000, None)]
    spark.createDataFrame(data, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {}
    for i in np.flatnonzero(ids % 20 == 0):
        order = np.lexsort((ids, -np.round(x @ x[i], 6)))
        want[int(ids[i])] = [int(j) for j in ids[order] if j != ids[i]][:10]

    def found(rows):
        got = {}
        for r in sorted(rows.collect(), key=lambda r: (-r["score"], r["vec_id"])):
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        return got

    rows = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    assert found(knn_topk_of_all(spark, str(tmp_path))) == want
    assert found(similarity.nearest_of_all(rows, "vec_id", "embedding", 10, block_rows=20, block_queries=7)) == want
    got = found(ann_topk(spark, str(tmp_path)))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    rows = rows.where("vec_id < 0")
    assert similarity.nearest_of_all(rows, "vec_id", "embedding", 10, cells=similarity.assign_cells(rows, "vec_id", "embedding")).count() == 0


def test_search(spark):
    docs = spark.createDataFrame([(1, "whale ship whale"), (2, "ship only"), (3, "whales shipped"), (4, None)], "k int, t string")
    index = search.inverted_index(docs, "k", "t", [])
    assert [r["k"] for r in search.search(index, ["whale", "ship"], "k", 4).collect()] == [1]
    assert {r["k"] for r in search.search(index, ["whale"], "k", 4, typos=1).collect()} == {1, 3}


def test_dump(spark):
    df = spark.createDataFrame([("<a> <p> <urn:x:1> <g> .",), ("<urn:x:1> <p> <urn:x:2> <g> .",), ('<c> <p> "' + "y" * 50_000 + '" <h> .',)], "line string")
    mapping = spark.createDataFrame([("<urn:x:1>", "<n>")], "old string, new string")
    got = {r[0][:40] for r in dump.rewrite_iris(df, mapping, r"<urn:x:\d+>").collect()}
    assert got == {"<a> <p> <n> <g> .", "<n> <p> <urn:x:2> <g> .", '<c> <p> "' + "y" * 31}
    assert dump.drop_lines(df, "<h>").count() == 2
    with pytest.raises(dump.Contaminated):
        dump.gate(df, [r"urn:x:\d"])
    dump.gate(df, ["nowhere"])
    with pytest.raises(dump.Contaminated):
        dump.check_counts(3, 1, 1)


def test_quads_written_and_read(spark, tmp_path):
    o = F.struct(F.lit("literal").alias("kind"), F.col("v").alias("value"), F.lit(None).cast("string").alias("datatype"), F.lit("en").alias("lang"))
    said = ['a "b"\n', "a \\ b\t", "ü", "x" * 100_000]
    q = spark.createDataFrame([(v,) for v in said + said[:1]], "v string").select(F.lit("urn:s").alias("s"), F.lit("urn:p").alias("p"), o.alias("o"), F.lit("urn:g").alias("g"))
    path = str(tmp_path / "q")
    assert write_quads(q, path) == 4
    back = graphs.read_quads(spark, path)
    assert sorted(r["o"]["value"] for r in back.where("ok").collect()) == sorted(said)
    bad = graphs.parse_quads(spark.createDataFrame([("# c",), ("",), ("broken",)], "value string"))
    assert [r["ok"] for r in bad.collect()] == [False]


def test_vocabularies(spark, tmp_path):
    (tmp_path / "t.ttl").write_text('<urn:t/1> a skos:Concept ;\n  skos:prefLabel "Lviv (Poland)"@en ;\n  skos:prefLabel "Lwow"@en ;\n  skos:broader <urn:t/2> .\n<urn:t/2> a skos:Concept ;\n  skos:prefLabel "Poland"@en .\n')
    terms = {r["term_id"]: (r["label"], r["key"]) for r in graphs.thesaurus(graphs.numbered(spark, str(tmp_path / "t.ttl"))).collect()}
    assert terms == {"1": ("Lviv (Poland)", "lviv"), "2": ("Poland", "poland")}
    (tmp_path / "a.ttl").write_text("<urn:t/1> a x:A ;\n  skos:exactMatch <https://w.org/Q1> ;\n  skos:closeMatch <https://g.org/2>, <https://g.org/3> ;\n  x:confidence 0.5 ;\n  x:confidence 0.9 .\n")
    (row,) = graphs.alignment(graphs.numbered(spark, str(tmp_path / "a.ttl"))).collect()
    assert (row["term_id"], row["exact_matches"], row["close_matches"], row["confidence"]) == ("1", ["https://w.org/Q1"], ["https://g.org/2", "https://g.org/3"], 0.9)


def test_transcripts(spark, tmp_path):
    xml = '<r xmlns="u"><p><span m="10">INT: hello</span> tail<span m="5">x</span></p><p>  </p><p>no span</p></r>'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "12.3.xml").write_text(xml)
    (tmp_path / "in" / "bad.xml").write_text("<r>")
    rows = transcripts(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r["interview_id"], r["part_number"], r["text"], r["start_timestamp"], r["end_timestamp"], r["speakers"]) for r in rows] == [(12, 3, "INT: hello  tail x", 5, 10, "INT"), (12, 3, "no span", None, None, None)]
    assert paragraphs(b"<r>") == []


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("IntCode,Name\n1,Jos\xe9\n".encode("latin-1"))
    assert tables.csv(spark, str(tmp_path / "m.csv")).first()["Name"] == "José"


def test_algebra(spark):
    q = spark.createDataFrame([("a", "p", "b", "g"), ("a", "p", "b", "h"), ("b", "q", "c", "g"), ("x", "p", "x", "g")], "s string, p string, o string, g string")
    graph = Graphs(q)
    assert graph.match(Pattern("?s", "p", "?o")).count() == 2
    assert graph.match(Pattern("?s", "p", "?s", "g")).collect()[0]["s"] == "x"
    assert graph.bgp(Pattern("?s", "p", "?o", "?g"), Pattern("?o", "q", "?z", "?g")).count() == 1
    assert graph.ask(Pattern("a", "p", "?o", "g")) and not graph.ask(Pattern("a", "z", "?o", "g"))
    with pytest.raises(ValueError):
        graph.bgp(Pattern("?s", "p", "?o"), Pattern("?x", "q", "?y"))
    typed = spark.createDataFrame([(1, None, "v")], "k int, a string, b string")
    assert as_quads(typed, F.lit("s"), "g", {"a": F.col("a"), "b": F.col("b")}).count() == 1


def test_build_quads_is_a_set(spark):
    row = ("h1", "Anna", "deported to the camp", "Lviv", "1942", "fear; fear")
    df = spark.createDataFrame([row, row], "utterance_hash string, who string, what string, where string, when string, emotion string")
    q = build_quads(df)
    assert q.count() == q.distinct().count()
    assert {r["o"] for r in q.where("p = 'temporalBucket'").collect()} == {"late_war_holocaust"}


def test_ids_summary_extract(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "i int"), spark.createDataFrame([(2,), (3,)], "i int")
    assert [r["i"] for r in select_ids("all", a, b, "i").collect()] == [2]
    assert sorted(r["i"] for r in select_ids("3, 1,3", a, b, "i").collect()) == [1, 3]
    u = spark.createDataFrame([(1, 1, 5, 20, 0.5, "B, A"), (1, 2, 1, 4, 0.1, "A")], "interview_id int, part_number int, word_count int, char_count int, duration_minutes double, speakers string")
    assert summary(u).first()["all_speakers"] == "A, B"
    seg = spark.createDataFrame([("a", "w " * 12), ("b", "short"), ("c", "w " * 15)], "utterance_hash string, t string")
    got = extract(seg, "t", lambda said: ["[]" for _ in said], done=spark.createDataFrame([("c",)], "utterance_hash string"))
    assert [(r["utterance_hash"], r["response"]) for r in got.collect()] == [("a", "[]")]


def test_blank_gate(spark):
    judged = spark.createDataFrame([("a", "correct"), ("a", ""), ("a", None)], "s string, v string")
    with pytest.raises(quality.TooManyBlanks):
        quality.require_judged(quality.precision(judged, "v", "s"))


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([("i1", "2024-01-01 00:00:01", "my father", "S", "M"), ("i1", "2024-01-01 00:00:02", "he", "S", "M"), ("i2", "2024-01-01 00:02:00", "she", "T", "F")], "key string, at string, who string, name string, sex string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("key string, at timestamp, who string, name string, sex string").parquet(str(src))
    counts = request_counts(stream, "at", "key", 60, 1).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert {(r["key"], r["n"], r["limited"]) for r in spark.table("counts").collect()} == {("i1", 2, True), ("i2", 1, False)}
    names = resolve_stream(stream, "key", "who", "name", "sex").writeStream.format("memory").queryName("names").outputMode("append").trigger(availableNow=True).start()
    names.awaitTermination(120)
    assert {(r["key"], r["resolved"]) for r in spark.table("names").collect()} >= {("i1", "S's father"), ("i2", "she")}


def test_matrices_of_similar_blocks_are_bounded():
    """Blocks of 2,000 rows meet in steps that keep a worker's matrices small."""
    import numpy as np

    rows = np.arange(2000)
    steps = similarity._steps(rows, 2000)
    assert np.array_equal(np.concatenate(steps), rows) and max(map(len, steps)) * 2000 <= similarity.HELD
    assert similarity._steps(rows[:0], 5) == []
