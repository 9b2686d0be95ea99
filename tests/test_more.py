"""Files, stores, marts, search, similarity and coreference on small inputs, against plain loops where there is no SQL."""

import json
import random
import re
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.functions import lexicon
from graphloom.functions.text import tokens
from graphloom.operators import coref, dump, entities, pipeline_tables, quality, search, similarity
from graphloom.plans import sparql
from graphloom.session import scratch
from graphloom.sinks import writers
from graphloom.sources import tables


def test_embedding_files(spark, tmp_path):
    for n in (12, 345):
        spark.createDataFrame([(n, [1.0, 2.0])], "k int, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (part,) = (tmp_path / f"w{n}").glob("part*.parquet")
        part.rename(tmp_path / f"{n}.parquet")
    (tmp_path / "9.parquet").write_bytes(b"broken")
    for n in (12, 345):
        for f in (tmp_path / f"w{n}").iterdir():
            f.unlink()
        (tmp_path / f"w{n}").rmdir()
    got = tables.embeddings(spark.newSession(), str(tmp_path)).select("k", "interview_id").collect()
    assert sorted((r["k"], r["interview_id"]) for r in got) == [(12, 12), (345, 345)]


def test_load_once_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "store")
    q = spark.createDataFrame([("a", "p", "1", "g"), ("a", "p", "1", "g"), ("b", "p", None, "g")], "s string, p string, o string, g string")
    assert writers.load_once(q, path) and spark.read.parquet(path).count() == 2
    assert writers.load_once(q.withColumn("s", F.concat(F.lit("x"), "s")), path) and spark.read.parquet(path).count() == 4
    assert writers.load_once(q, path) and spark.read.parquet(path).count() == 4
    assert not writers.load_once(q.withColumn("s", F.lit("z")), path, guard=3) and spark.read.parquet(path).count() == 4


def test_marts_and_results_kept(spark, tmp_path):
    made = []
    build = {n: lambda n=n: made.append(n) or spark.createDataFrame([(n, 1)], "label string, n long") for n in ("a", "b")}
    folder = str(tmp_path)
    assert writers.write_marts(spark, build, folder, dry_run=True) == ["a", "b"] and not made
    assert writers.write_marts(spark, build, folder, only=["b"]) == ["b"] and made == ["b"]
    assert tables.mart(spark, folder, "a") is None and tables.mart(spark, folder, "b").count() == 1
    kept = lambda at: [r["label"] for r in writers.kept_for(spark, folder, "c", 60, build["a"], now=at).collect()]
    assert kept(1000.0) == kept(1050.0) == ["a"] and made == ["b", "a"]
    kept(1061.0)
    assert made == ["b", "a", "a"]


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_word_list_and_csv(spark, tmp_path):
    (tmp_path / "w.txt").write_text("b a\nc a\n")
    assert tables.words(spark, str(tmp_path / "w.txt")) == ["a", "b", "c"]
    (tmp_path / "x.csv").write_bytes(b"k,v\n" + b"1,plain\n" * 1500 + "2,é\n".encode("latin-1"))
    assert tables.csv(spark, str(tmp_path / "x.csv")).where("k = 2").first()["v"] == "é"
    (tmp_path / "y.csv").write_text("k,v\n1,é\n2,x\n2,y\n")
    rows = tables.csv(spark, str(tmp_path / "y.csv"))
    assert {r["k"]: r["v"] for r in tables.keyed(rows, "k", ["v"]).collect()} == {"1": "é", "2": "y"}


def test_rewriting_equal_lines_and_long_names(spark):
    lines = spark.createDataFrame([("<urn:x:1> <p> <urn:x:2> .",), ("<urn:x:1> <p> <urn:x:2> .",), ("<urn:y> .",), (None,)], "line string")
    mapping = spark.createDataFrame([("urn:x:1", "urn:a"), ("urn:x:2", "urn:b")], "old string, new string")
    got = sorted((r["line"] or "") for r in dump.rewrite_iris(lines, mapping, r"urn:x:\d+").collect())
    assert got == ["", "<urn:a> <p> <urn:b> .", "<urn:a> <p> <urn:b> .", "<urn:y> ."]
    tail = "a" * 5000 + "z"
    q = spark.createDataFrame([(f"urn:g:{tail}", "p", ("iri", "x", None, None), "g")], "s string, p string, o struct<kind:string,value:string,datatype:string,lang:string>, g string")
    made = dump.complete_labels(q, "K", "label", "urn:g:", "g").where("p = 'label'").first()
    assert made["o"]["value"] == tail.capitalize()


def test_string_functions_without_a_match(spark):
    q = spark.createDataFrame([("s", "p", "abc", "g", "en"), ("t", "p", "ab", "g", None)], "s string, p string, o string, g string, lang string")
    got = sparql.run('SELECT ?s (STRBEFORE(?x, "c") AS ?b) (STRAFTER(?x, "a") AS ?a) (LANG(?x) AS ?l) WHERE { GRAPH <g> { ?s <p> ?x } }', q)
    assert {r["s"]: (r["b"], r["a"], r["l"]) for r in got.collect()} == {"s": ("ab", "bc", "en"), "t": ("", "b", "")}
    assert sparql.run("SELECT * WHERE { GRAPH <g> { ?s <p> ?x . FILTER(LANG(?x) = 'en') } }", q).columns == ["s", "x"]


def test_quads_of_events_are_those_of_their_tables(spark, sf_dir):
    words = ["deported to the camp", "he fled and was hidden", "worked for money in the war", "moved to town", "", None]
    felt = ["fear; joy", "Great Sorrow, hope", "not stated", "odd", None, ""]
    when = ["1942", "March 1944", "after the war", "1939-1941", "nan", None]
    rng = random.Random(1)
    rows = [(f"h{k}", rng.choice(["Anna", "", None]), rng.choice(words), rng.choice(["Lviv", "", None]), rng.choice(when), rng.choice(felt)) for k in range(120)]
    df = spark.createDataFrame(rows, "utterance_hash string, who string, what string, where string, when string, emotion string")
    got = Counter(tuple(r) for r in pipeline_tables.build_quads(df).select("s", "p", "o").collect())
    event = lambda k: f"urn:graph:event:{k}"
    want = Counter((event(r[0]), p, v) for r in rows for p, v in (("participant", r[1]), ("whatText", r[2]), ("placeText", r[3])) if v)
    want.update((event(r["utterance_hash"]), f"has_{r['kind']}", r["name"]) for r in pipeline_tables.event_labels(df, "utterance_hash", "what").collect())
    for r in pipeline_tables.event_times(df, "utterance_hash", "when").collect():
        want.update((event(r["utterance_hash"]), p, str(r[c])) for p, c in (("startYear", "start_year"), ("endYear", "end_year"), ("temporalBucket", "bucket")) if r[c] is not None)
    for r in pipeline_tables.event_emotions(df, "utterance_hash", "emotion").collect():
        node = f"urn:graph:emotion:{r['utterance_hash']}:{re.sub('[^a-z0-9]+', '-', r['label'].lower())}"
        want.update([(event(r["utterance_hash"]), "emotion", node), (node, "emotionLabel", r["label"]), (node, "category", r["category"])])
        want.update((node, c, str(r[c])) for c in ("valence", "arousal", "intensity"))
    assert set(got) == set(want) and max(got.values()) == 1
    some = pipeline_tables.build_quads(df, only=["valence", "has_activity"])
    assert {r["p"] for r in some.collect()} == {"valence", "has_activity"}


def test_lexicon_score(spark):
    df = spark.createDataFrame([("Joy ",), ("great grief",), ("sorr",), ("zzz",), (None,)], "x string")
    got = [tuple(r["s"]) for r in df.select(lexicon.lexicon_score(F.col("x"), lexicon.VAD, (0.0, 0.5, 0.5)).alias("s")).collect()]
    assert got == [(0.9, 0.75, 0.8), (-0.9, 0.7, 0.85), (-0.85, 0.6, 0.75), (0.0, 0.5, 0.5), (0.0, 0.5, 0.5)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("typos", [0, 1, 2])
def test_search_against_a_plain_loop(spark, typos):
    rng = random.Random(typos)
    words = ["house", "horse", "houses", "mouse", "river", "rivers", "driver", "camp", "lamp", "forest"]
    texts = {k: [rng.choice(words) for _ in range(rng.randrange(1, 12))] for k in range(150)}
    asked = ["house", "river", "camp"][: 1 + typos]
    near = lambda t, w: t == w or (typos and len(w) >= 5 and edits(t, w) <= typos)
    df = {w: sum(any(near(t, w) for t in ts) for ts in texts.values()) for w in asked}
    want = {}
    for k, ts in texts.items():
        tf = {w: sum(bool(near(t, w)) for t in ts) for w in asked}
        if all(tf.values()):
            want[k] = sum(n * log(1 + 150 / df[w]) for w, n in tf.items())
    docs = spark.createDataFrame([(k, " ".join(ts)) for k, ts in texts.items()], "k int, t string")
    got = {r["k"]: r["score"] for r in search.search(search.inverted_index(docs, "k", "t"), asked, "k", 150, typos).collect()}
    assert got == pytest.approx(want, abs=1e-6) and want
    page = search.search_page(docs, search.search(search.inverted_index(docs, "k", "t", only=asked), asked, "k", 150), asked, "k", "t", ["k"], where=F.col("k") % 2 == 0, limit=3, offset=1)
    exact = {k: sum(ts.count(w) * log(1 + 150 / sum(w in x for x in texts.values())) for w in asked) for k, ts in texts.items() if k % 2 == 0 and all(w in ts for w in asked)}
    order = sorted(exact, key=lambda k: (-round(exact[k], 6), k))
    rows = page.collect()
    assert [r["k"] for r in rows] == order[1:4] and all(r["total"] == len(order) for r in rows)
    assert all(f"<mark>{w}</mark>" in r["marked"] for r in rows for w in asked)


def test_recall_of_cells(spark):
    """100 queries against 2,000 vectors in clusters, with far fewer probes than cells; null vectors and an empty table do no harm."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(60, 24))
    x = centre[rng.integers(0, 60, 2000)] + 0.4 * rng.normal(size=(2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, [float(f) for f in v]) for k, v in enumerate(x)] + [(None, [0.0] * 24), (5000, None)], "k long, v array<double>")
    cells = similarity.assign_cells(df, "k", "v", sample=800)
    assert cells[2] < len(cells[1]) / 2
    assert cells[0].where("k = 5000").first()["cell"] is None
    got = {}
    for r in similarity.nearest_of_all(df, "k", "v", 10, cells=cells).collect():
        got.setdefault(r["query_id"], set()).add(r["k"])
    score = x @ x.T
    np.fill_diagonal(score, -2)
    true = {q: set(np.argsort(-score[q], kind="stable")[:10].tolist()) for q in range(0, 2000, 20)}
    assert len(got) == 100 and np.mean([len(got[q] & true[q]) / 10 for q in true]) >= 0.9
    empty = similarity.assign_cells(df.limit(0), "k", "v")
    assert empty[1] == [] and similarity.nearest_of_all(df.limit(0), "k", "v", 10, cells=empty).count() == 0


def test_vector_index(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (None, [1.0, 1.0]), (20, [0.9, 0.1])], "k long, v array<double>")
    index = similarity.vector_index(df, "k", "v", str(tmp_path / "i"), 2, spark.createDataFrame([(1,), (20,), (3,)], "k long"))
    assert (index["rows"], index["skipped"]) == (2, 4)
    assert [tuple(r) for r in similarity.nearest_of_all(index["cells"][0], "k", "v", 3).collect()] == [(20, 1, 0.9)]


@pytest.mark.parametrize("block", [7, 1000])
def test_similar_edges_against_a_plain_loop(spark, block):
    rng = np.random.default_rng(block)
    x = rng.normal(size=(90, 6))
    group = rng.integers(0, 3, 90)
    df = spark.createDataFrame([(int(g), k, [float(f) for f in v]) for k, (g, v) in enumerate(zip(group, x))] + [(None, 500, [1.0] * 6), (1, 501, None), (1, 502, [1.0])], "g int, k int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(u @ u.T, 6)
    want = set()
    for a in range(90):
        others = sorted((b for b in range(90) if b != a and group[b] == group[a]), key=lambda b: (-score[a, b], b))[:4]
        want |= {(a, b) for b in others if score[a, b] >= 0.3 and a < b}
    got = similarity.similar_edges(df, "g", "k", "v", 4, 0.3, block_rows=block).collect()
    assert {(r["src"], r["dst"]) for r in got} == want and len(got) == len(want)


def test_facts_enrich_and_samples(spark):
    rows = spark.createDataFrame([(1, 2, None, "b"), (1, 3, "y", "a"), (1, 4, "z", "a"), (2, 1, None, None)], "k int, n int, l string, t string")
    got = {r["k"]: (r["label"], r["types"]) for r in quality.facts(rows, "k", {"label": "l"}, {"types": "t"}, ["n"]).collect()}
    assert got == {1: ("y", ["a", "b"]), 2: (None, [])}
    base = spark.createDataFrame([(1, "own"), (2, "own"), (None, "own")], "k int, l string")
    more = spark.createDataFrame([(1, "new", 5), (1, "new", 5)], "k int, l string, x int")
    assert sorted(map(str, (tuple(r) for r in entities.enriched(base, more, "k").select("k", "l", "x", "matched").collect()))) == ["(1, 'new', 5, True)", "(2, 'own', None, False)", "(None, 'own', None, False)"]
    assert quality.totals(rows.limit(0), n=F.count("*"), s=F.sum("n"), a=F.avg("n")).first() == (0, 0, 0)
    assert quality.simple_sample(rows, "n", 10, 1).count() == 4


def test_embed(spark):
    got = pipeline_tables.embed(spark.createDataFrame([("a",), ("bbb",)], "t string"), "t", lambda said: [[float(len(s)), 1.0] for s in said])
    assert sorted(tuple(r["embedding"]) for r in got.collect()) == [(1.0, 1.0), (3.0, 1.0)]


def plain_coref(mentions, survivor, gender):
    """The rules one mention after another, looking back over all that came before."""
    said, out = [], []
    for who in mentions:
        who = (who or "").strip()
        low, method, found = who.lower(), "original", who
        mine = re.match(r"(?:my|our)\s+(.+)$", who, re.I)
        if not who:
            method = "empty"
        elif low in ("i", "me", "myself"):
            found, method = survivor, "rule_self"
        elif low in ("we", "us", "ourselves"):
            found, method = f"{survivor} and family", "rule_we"
        elif mine:
            found, method = f"{survivor}'s {mine[1].strip()}".rstrip(",.;:"), "rule_relational"
        elif re.match(r"i[,\s]", who, re.I):
            parts = [p.strip() for p in re.split(r",|\sand\s", who, flags=re.I) if p.strip()]
            own = lambda p: survivor if p.lower() in ("i", "me", "myself") else re.sub(r"^(?:my|our)\s+", f"{survivor}'s ", p, flags=re.I)
            found, method = ", ".join(own(p) for p in parts), "rule_self_compound"
        elif re.match(r"(he|him|his|she|her|hers|they|them|their|theirs)\b", low):
            first, recent, name = low.split()[0], said[-10:][::-1], None
            words = [set(re.findall("[a-z]+", c.lower())) for c in recent]
            for kind, marks, sex in (({"he", "him", "his"}, coref.MALE, "M"), ({"she", "her", "hers"}, coref.FEMALE, "F")):
                if first in kind:
                    name = next((c for c, w in zip(recent, words) if w & set(marks)), None)
                    if name is None and gender == sex and survivor in recent:
                        name = survivor
            if first in {"they", "them", "their", "theirs"}:
                name = next((c for c in recent if " and " in c.lower() or c.lower().endswith("s") or "family" in c.lower() or "parents" in c.lower()), None)
            name = name or (recent[0] if recent else None)
            if name is None:
                method = "unresolved_pronoun"
            else:
                found, method = (f"{name}'s" if first in {"his", "her", "hers", "their", "theirs"} else name), "coref_local"
        out.append((found, method))
        if found and method != "empty" and not re.match(rf"({'|'.join(coref.PRONOUNS)})\b", found, re.I) and (not said or said[-1] != found):
            said.append(found)
    return out


def test_coref_against_a_plain_loop(spark):
    rng = random.Random(11)
    pool = ["my father", "My mother,", "our neighbors", "he", "she", "They", "his", "her", "their", "I", "we", "I and my brother", "I, my uncle and Anna", "Anna", "the Germans", "Uncle Max", "two girls", "it", "", None, "them all", "him"]
    rows, want = [], {}
    for i, (name, sex) in enumerate([("Sara", "F"), ("Jan", "M"), ("Lea", "F"), ("Otto", "M"), ("Mia", "")]):
        said = [rng.choice(pool) for _ in range(100)]
        rows += [(i, k, w, name, sex) for k, w in enumerate(said)]
        want |= {(i, k): r for k, r in enumerate(plain_coref(said, name, sex))}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, k int, who string, name string, sex string").repartition(7)
    got = {(r["i"], r["k"]): (r["who"], r["who_method"]) for r in coref.resolve_mentions(df, "i", ["k"], "who", "name", "sex").collect()}
    assert got == want


def test_config(spark, tmp_path):
    told = {"paths": {"workspace_root": "data", "events_parquet": "e.parquet", "out": "s3://b/out"}, "build": {"interview_ids": "all"}}
    (tmp_path / "c.json").write_text(json.dumps(told))
    c = Config.read(spark, str(tmp_path / "c.json"), home="/home/x/")
    assert c.path("events_parquet") == "/home/x/data/e.parquet" and c.path("out") == "s3://b/out"
    assert c.get("build", "interview_ids") == "all" and c.get("build", "none", 3) == 3 and c.get("other", "x") is None
    assert Config.of({"paths": {"workspace_root": "/r", "a": "b"}}, "/h").path("a") == "/r/b"


def test_tokens_against_a_plain_loop(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcABx--'' é1\n", k=rng.randrange(0, 40))) for _ in range(3000)] + [None, "", "it's rock'n'roll -- the o'-x a--b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["w"] for r in df.select("k", tokens(F.col("t"), ["abc", "the"]).alias("w")).collect()}
    for k, t in enumerate(texts):
        if t is not None:
            clean = [w.replace("'", "").strip("-") for w in re.findall(r"[a-z][a-z'-]{2,}", t.lower())]
            assert got[k] == [w for w in clean if len(w) >= 3 and w not in ("abc", "the")], t


def test_events_of_many_interviews_are_few_files(spark, tmp_path):
    from graphloom.sinks import writers

    rows = spark.range(5000).select(F.col("id").alias("event_id"), (F.col("id") % 900).alias("interview_id"), F.lit(" x ").alias("who"))
    rows = rows.union(spark.range(5000, 5003).select("id", F.lit(None), F.lit("y")))
    path = str(tmp_path / "events")
    writers.write_ranges(rows, path, "interview_id", "event_id")
    files = sorted((tmp_path / "events").rglob("*.parquet"))
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = tables.events(spark, path, ids=[3, 4])
    assert got.count() == 12 and {r["who"] for r in got.collect()} == {"x"}
    assert "In(interview_id" in got._jdf.queryExecution().executedPlan().toString()
    assert tables.events(spark, path).count() == 5003


def test_partitioned_events_makes_no_folder_an_interview(spark, sf_dir, monkeypatch, tmp_path):
    from graphloom.queries import QUERIES
    from graphloom.queries import tables as made

    monkeypatch.setattr(made, "scratch", lambda _: str(tmp_path / "e"))
    assert QUERIES["partitioned_events"](spark, sf_dir).count() == 1000
    assert not [p for p in (tmp_path / "e").iterdir() if p.is_dir()]
