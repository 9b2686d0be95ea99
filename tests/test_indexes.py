"""Written indexes, carried values, exact quantiles, slugs and streams against plain forms."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import carry, cell_index, coref, ordered, similarity, text_index
from graphloom.queries import QUERIES
from graphloom.queries.streams import mentions_of_events
from graphloom.sources import graphs
from graphloom.streaming.store import KeyedStore


@pytest.fixture(scope="module")
def vectors():
    """Clustered vectors, so that cells are worth probing."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 2
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best(x, q, k, skip):
    score = np.round(x @ x[q], 6)
    score[skip] = -np.inf
    return set(np.lexsort((np.arange(len(x)), -score))[:k].tolist())


def test_cell_index_is_opened_by_another_session(spark, vectors, tmp_path):
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(None, [1.0] * 16), (9000, [1.0]), (9001, None), (9002, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    written = cell_index.write_cell_index(df, "id", "v", str(tmp_path))
    assert (written.rows, written.skipped, written.dimension, written.version) == (3000, 4, 16, 1)
    index = cell_index.open_cell_index(spark.newSession(), str(tmp_path))
    assert index.probes < len(index.centroids) / 2 and index.ids.count() == 3000
    # only the probed cells' folders are read
    one = index.search(vectors[7].tolist(), 10, skip=7)
    probed = {int(c) for c in index.probed(vectors[7:8])[0]}
    assert {int(f.split("cell=")[1].split("/")[0]) for f in one.inputFiles()} >= probed
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert len({r["id"] for r in one.collect()} & best(vectors, 7, 10, [7])) >= 9
    # recall over all ids divisible by 20; all cells: exact
    for probes, least in ((None, 0.9), (len(index.centroids), 1.0)):
        found = {}
        for r in index.search_all(10, probes=probes).collect():
            found.setdefault(r["query_id"], set()).add(r["id"])
        assert set(found) == set(range(0, 3000, 20))
        assert np.mean([len(found[q] & best(vectors, q, 10, [q])) / 10 for q in found]) >= least
    again = cell_index.write_cell_index(df.where("id < 100"), "id", "v", str(tmp_path), allowed=df.where("id < 50"))
    assert (again.version, again.rows) == (2, 50) and cell_index.open_cell_index(spark, str(tmp_path), 1).rows == 3000
    with pytest.raises(LookupError):
        cell_index.open_cell_index(spark, str(tmp_path / "none"))
    empty = cell_index.write_cell_index(df.limit(0), "id", "v", str(tmp_path / "empty"))
    assert empty.rows == 0


def test_probed_cells_of_the_table(spark, sf_dir):
    want = {}
    for r in QUERIES["cell_index_all_cells"](spark, sf_dir).collect():
        want.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = {}
    for r in QUERIES["cell_index_probed"](spark, sf_dir).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(found.get(q, set()) & w) / len(w) for q, w in want.items()]) >= 0.9


def test_matrices_of_workers_are_bounded(spark):
    """However many cells there are, and rows in a block that all queries visit."""
    tracemalloc.start()
    x, centres = np.ones((3000, 8)), np.ones((4096, 8))
    base = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    assert not similarity._closest(x, centres).any()
    peak = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert peak < 16e6
    for width in (1, 1000, 20_000, 10_000_000):
        assert similarity._rows_held(width, 250) == 1 or similarity._rows_held(width, 250) * width <= similarity.HELD


WORDS = ["alpha", "alpine", "beta", "betas", "gamma", "delta", "alphas", "gama", "the", "an"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return {k: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 30))) for k in range(200)}


def split(text):
    return [w for w in text.split() if len(w) >= 3]


def test_positional_index(spark, texts, tmp_path):
    docs = spark.createDataFrame([*texts.items(), (None, "alpha beta"), (999, None)], "id long, body string")
    index = text_index.upsert(spark, str(tmp_path), docs, "id", "body")
    phrase = {r["key"]: r["times"] for r in index.phrase(["alpha", "beta", "alpha"]).collect()}
    want = {k: n for k, t in texts.items() if (n := sum(split(t)[i : i + 3] == ["alpha", "beta", "alpha"] for i in range(len(split(t)))))}
    assert phrase == want and want

    def far(words, a, b):
        pairs = [j - i if j > i else i - j + 1 for i, x in enumerate(words) if x == a for j, y in enumerate(words) if y == b]
        return min(8, *pairs, 8) if pairs else None

    got = {r["key"]: r["distance"] for r in index.proximity(["delta", "gamma", "beta"]).collect()}
    both = {k: (far(split(t), "delta", "gamma"), far(split(t), "gamma", "beta")) for k, t in texts.items()}
    assert got == {k: a + b for k, (a, b) in both.items() if a is not None and b is not None}
    assert {r["term"] for r in index.with_prefix("alp").collect()} == {"alpha", "alpine", "alphas"}
    assert {(r["wanted"], r["term"]) for r in index.near_words(["alpha", "gamma", "beta", "zzzzz"]).collect()} == {("alpha", "alpha"), ("alpha", "alphas"), ("gamma", "gamma"), ("gamma", "gama"), ("beta", "beta")}
    plan = index.postings(index.words(["alpha"]))._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        index.near_words(["alpha"], typos=2)


def test_two_typos(spark, tmp_path):
    docs = spark.createDataFrame([(1, "reading raiding breading trading readers boring")], "id long, body string")
    index = text_index.upsert(spark, str(tmp_path), docs, "id", "body", typos=2)
    assert {r["term"] for r in index.near_words(["reading"], 2).collect()} == {"reading", "raiding", "breading", "trading"}


def test_batches_answer_like_one_build(spark, texts, tmp_path):
    df = lambda d: spark.createDataFrame(list(d.items()), "id long, body string")
    rng, now = random.Random(2), {}
    for batch in range(4):
        some = {k: texts[rng.randrange(200)] for k in rng.sample(range(120), 50)}
        gone = {k: "" for k in rng.sample(range(120), 10) if k not in some}
        now.update(some)
        for k in gone:
            now.pop(k, None)
        for _ in range(2):  # a batch that comes twice counts once
            index = text_index.upsert(spark, str(tmp_path / "a"), df(some), "id", "body", f"b{batch}", delete=df(gone) if gone else None)
    whole = text_index.upsert(spark, str(tmp_path / "b"), df(now), "id", "body")
    merged = text_index.merge(spark, str(tmp_path / "a"))
    rows = lambda i: sorted(tuple(r) for r in i.postings().select("term", "key", "at").collect())
    assert rows(index) == rows(whole) == rows(merged)
    assert len(index.segments) == 4 and len(merged.segments) == 1
    # a segment without its commit isn't read
    text_index._segment(merged, spark.createDataFrame([("stray", 1, 0)], "term string, key long, at int"), merged.seq + 1)
    assert rows(text_index.open_index(spark, str(tmp_path / "a"))) == rows(whole)
    assert rows(text_index.open_index(spark, str(tmp_path / "a"), 4)) == rows(whole)
    assert text_index.open_index(spark, str(tmp_path / "none")).version == 0


def test_newest_segment_is_not_joined(spark, tmp_path):
    """Tombstones meet older segments only; one segment meets none."""
    joins = lambda i: i.postings()._jdf.queryExecution().optimizedPlan().toString().count("Join")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (2, "gamma")], "id long, body string")
    one = text_index.upsert(spark, str(tmp_path), docs, "id", "body")
    assert joins(one) == 0 and one.postings().count() == 4
    two = text_index.upsert(spark, str(tmp_path), docs.where("id = 2"), "id", "body", delete=docs.where("id = 1"))
    assert joins(two) == 1 and sorted(r["term"] for r in two.postings().collect()) == ["alpha", "gamma"]
    assert joins(text_index.open_index(spark, str(tmp_path), 1)) == 0
    assert text_index.open_index(spark, str(tmp_path), 1).postings().count() == 4


def test_tasks_that_write_postings_follow_the_rows(spark, tmp_path, monkeypatch):
    """However few partitions a shuffle has, or adaptive execution makes of them."""
    for rows in (0, 10**6, 10**8, 3 * 10**9):
        files, tasks = text_index._dealt(64, rows)
        assert rows / files <= 32 * text_index.TASK_ROWS and rows / tasks <= text_index.TASK_ROWS and files * 64 < 4 * tasks + 257
    dealt = []
    plain = type(spark.range(0)).repartitionById
    monkeypatch.setattr(type(spark.range(0)), "repartitionById", lambda self, n, by: dealt.append(n) or plain(self, n, by))
    monkeypatch.setattr(text_index, "TASK_ROWS", 10)
    docs = spark.createDataFrame([(k, "alpha beta " * 10) for k in range(60)], "id long, body string")
    index = text_index.upsert(spark, str(tmp_path), docs, "id", "body")
    assert dealt == [-(-(60 * 110 // 4 + 1) // 10)] and index.postings().count() == 1200
    text_index.merge(spark, str(tmp_path))
    assert dealt[1:] == [120]


def test_exact_quantiles(spark):
    rng = random.Random(3)
    shapes = {
        "even": [rng.random() for _ in range(3000)],
        "ties": [rng.choice([0.5, 0.5, 0.5, 0.25]) for _ in range(3000)],
        "scales": [10.0 ** rng.uniform(-300, 300) * rng.choice([1, -1]) for _ in range(2000)],
        "one": [4.5],
        "two": [1.0, 2.0],
    }
    points = [0.0, 0.1, 0.5, 0.75, 0.99, 1.0]
    for name, x in shapes.items():
        got = similarity.exact_quantiles(spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "s double"), "s", points, buckets=16, held=40)
        s = sorted(x)
        for p, g in zip(points, got):
            at = (len(s) - 1) * p
            a, b = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            assert g == a + (b - a) * (at - int(at)), (name, p)
    assert similarity.exact_quantiles(spark.createDataFrame([(None,)], "s double"), "s", [0.5]) == [None]


def test_carried_forward_over_ranges(spark):
    """One key with most rows, cut into many ranges; others, null ones too, beside it."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, None, None, None, f"v{k}"])) for k in range(2000)]
    df = spark.createDataFrame(rows, "key string, at int, v string").repartition(7)
    got = {(r["key"], r["at"]): r["filled"] for r in carry.carried_forward(df, F.col("v"), ["key"], [F.asc("at")], "filled", parts=13).collect()}
    last = {}
    for key, at, v in rows:
        last[key] = v or last.get(key)
        assert got[key, at] == last[key], (key, at)
    assert len(got) == 2000
    assert carry.carried_forward(df.limit(0), F.col("v"), ["key"], [F.asc("at")], "filled").count() == 0


def test_lines_of_a_large_file_in_splits(spark, tmp_path):
    """A vocabulary read in many splits, some of which begin inside a term."""
    lines = []
    for k in range(3000):
        lines += [f"<urn:v:t{k}> a skos:Concept ;", f'  skos:prefLabel "name {k}"@en ;', f"  skos:broader <urn:v:t{k // 2}> ."]
    (tmp_path / "v.ttl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        read = graphs.numbered(spark, str(tmp_path / "v.ttl"))
        assert read.rdd.getNumPartitions() > 20
        got = {r["term_id"]: (r["label"], r["broader"]) for r in graphs.thesaurus(read).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"t{k}": (f"name {k}", f"<urn:v:t{k // 2}>") for k in range(3000)}


def test_slugs_by_ascending_number(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "a", f"a-{rng.randrange(60)}", "b", f"a-{rng.randrange(9)}-{rng.randrange(60)}"])) for k in rng.sample(range(200), 120)] + [(500, "a-2"), (501, None)]
    taken, want = set(), {}
    for n, s in sorted(r for r in rows if r[1]):
        while s in taken:
            s = f"{s}-{n}"
        taken.add(s)
        want[n] = s
    got = {r["n"]: r["unique_slug"] for r in ordered.distinct_slugs(spark.createDataFrame(rows, "n long, s string"), "s", "n").collect()}
    assert got == {**want, 501: None}


def test_slug_of_a_number_that_is_another_slug(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (9, "a-2")], "n long, s string")
    assert {r["n"]: r["unique_slug"] for r in ordered.distinct_slugs(rows, "s", "n").collect()} == {1: "a", 2: "a-2", 9: "a-2-9"}


def test_store_counts_a_batch_once(spark, tmp_path):
    schema = "k long, v int, x string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    store = KeyedStore(spark, str(tmp_path), frame([]).schema, "k", "v", buckets=8)
    assert store.rows().count() == 0
    assert store.merge(frame([(k, 1, "old") for k in range(40)] + [(None, 1, "x")]), 0)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "data").rglob("*.parquet")}
    before = files()
    assert store.merge(frame([(3, 2, "new"), (3, 0, "late"), (77, 5, None)]), 1)
    after = files()
    assert all(after[p] == t for p, t in before.items()) and 1 <= len(after) - len(before) <= 2
    for _ in range(2):
        assert not store.merge(frame([(3, 9, "replayed")]), 1)
    assert store.merge(frame([]), 2)
    got = {r["k"]: (r["v"], r["x"]) for r in store.rows().collect()}
    assert got == {k: (1, "old") for k in range(40)} | {3: (2, "new"), 77: (5, None)}


def test_stream_of_mentions_equals_the_batch(spark, sf_dir):
    got = {r["place"]: (r["user_id"], r["who"], r["resolved"], r["method"]) for r in QUERIES["coref_stream_in_order"](spark, sf_dir).collect()}
    rows = mentions_of_events(spark, sf_dir)
    want = coref.resolve_mentions(rows, "user_id", ["at", "place"], "who", "survivor", "gender")
    assert got == {r["place"]: (r["user_id"], r["who_original"], r["who"], r["who_method"]) for r in want.collect()}
    assert len(got) == rows.count()


def test_mentions_that_wait_are_read_once_when_due():
    """As many timers as arrivals, and one read of the list a watermark, however many mentions wait."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    from graphloom.streaming.stateful import _InOrder

    class Held:
        def __init__(self):
            self.rows, self.reads, self.map, self.timers = [], 0, {}, []
            self.getListState = self.getMapState = lambda *_: self
            self.appendValue, self.registerTimer = self.rows.append, self.timers.append
            self.containsKey, self.getValue = self.map.__contains__, self.map.get
            self.updateValue = self.map.__setitem__

        def get(self):
            self.reads += 1
            return list(self.rows)

        def put(self, rows):
            self.rows[:] = rows

        def clear(self):
            self.rows.clear()

    held, run = Held(), _InOrder(["at", "place", "key", "who", "survivor", "gender"], "bigint", 10)
    run.init(held)
    part = pd.DataFrame({"at": [k * 1_000_000 for k in range(200)], "place": range(200), "key": [k % 3 for k in range(200)], "who": ["Anna", "he"] * 100, "survivor": "S", "gender": "M"})
    list(run.handleInputRows((5,), iter([part[::-1], part[:0]]), None))
    assert held.timers == [1]
    got = pd.concat(run.handleExpiredTimer((5,), TimerValues(0, 150_000), ExpiredTimerInfo(1)))
    assert list(got["place"]) == list(range(150)) and held.reads == 1 and held.timers == [1, 150_001]
    got = pd.concat([got, *run.handleExpiredTimer((5,), TimerValues(0, 900_000), ExpiredTimerInfo(150_001))])
    assert held.reads == 2 and not held.rows
    whole = {k: coref.Resolver("S", "M", 10) for k in range(3)}
    assert list(zip(got["resolved"], got["method"], strict=True)) == [whole[k % 3](("Anna", "he")[k % 2]) for k in range(200)]
