"""A graph on disk: what a pattern reads, the order of joins, rows as without the store."""

import pytest

from graphloom.plans import sparql, stored
from graphloom.plans.algebra import Graphs, Pattern
from graphloom.plans.stored import StoredGraphs, write_graph

SCHEMA = "s string, p string, o string, g string, lang string"


def people(spark):
    """200 people, all with a name and a town, three with a prize; 4 towns in 2 lands."""
    rows = [(f"p{k}", "name", f"n{k % 50}", "people", "en" if k % 2 else None) for k in range(200)]
    rows += [(f"p{k}", "town", f"t{k % 4}", "people", None) for k in range(200)] + [(f"p{k}", "prize", "gold", "people", None) for k in (3, 8, 90)]
    rows += [(f"t{k}", "land", f"l{k % 2}", "towns", None) for k in range(4)] + [("x", "", "y", "", None), ("x", "a/b=c %", "ü", "people", None)]
    return spark.createDataFrame(rows + [rows[0], (None, "name", "n", "people", None), ("s", None, "n", "people", None)], SCHEMA)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "g")
    write_graph(people(spark), path, file_rows=40)
    return StoredGraphs(spark, path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_holds_all_quads(spark, store):
    assert rows(store.quads.select(*SCHEMA.replace(" string", "").split(", "))) == rows(people(spark).dropna(subset=["s", "p", "o", "g"]))


def test_no_task_grows_with_the_graph(spark, tmp_path, monkeypatch):
    """A task has a file or small predicates, however shuffles are coalesced; subjects are dealt by their number."""
    sizes = [("a", "p", 900), ("a", "q", 3), ("a", "r", 4), ("b", "p", 250), ("b", "q", 5), ("b", "r", 100)]
    placed, tasks = stored._tasks(sizes, 100)
    load = [0] * tasks
    for (_, _, n), (_, _, first, files) in zip(sizes, placed, strict=True):
        for k in range(files):
            load[first + k] += n / files
    assert max(load) <= 100 and tasks <= 16 and min(load) > 0
    assert stored._tasks([], 100) == ([], 0)
    dealt = []
    plain = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, n, *by: dealt.append((n, by)) or plain(self, n, *by))
    monkeypatch.setattr(stored, "TASK_ROWS", 10)
    write_graph(people(spark), str(tmp_path / "g"), file_rows=40)
    assert dealt == [(41, ("g", "s"))]
    files = [f for f in StoredGraphs(spark, str(tmp_path / "g")).quads.where("p = 'name'").inputFiles() if "p=name" in f]
    assert len(files) == 6  # 201 rows, the repeated one too


def test_reads_only_folders_of_the_pattern(store):
    found = store.match(Pattern("?s", "town", "?o", "people"))
    text = plan(found)
    assert "PartitionFilters" in text and "town" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert found.count() == 200
    assert store.match(Pattern("?s", "", "?o", "")).count() == 1
    assert store.match(Pattern("?s", "a/b=c %", "?o", "people")).first()["o"] == "ü"


def test_joins_start_with_the_fewest_bindings(store):
    written = [Pattern("?s", "name", "?n", "people"), Pattern("?s", "town", "?t", "people"), Pattern("?t", "land", "?l", "towns"), Pattern("?s", "prize", "gold", "people")]
    assert [p.p for p in store.order(written)][0] == "prize"
    assert store.order(written)[-1].p != "prize" and set(store.order(written)) == set(written)
    star = [written[0], written[3]]
    assert abs(store.star_rows(star) - 3) < 0.5  # the set of three predicates has three subjects
    assert store.star_rows(written[2:]) is None


def test_rows_are_those_of_plain_graphs(spark, store):
    plain = Graphs(people(spark).dropna(subset=["s", "p", "o", "g"]))
    written = [Pattern("?s", "name", "?n", "people"), Pattern("?s", "town", "?t", "people"), Pattern("?t", "land", "?l", "towns"), Pattern("?s", "prize", "?z", "people")]
    got, want = store.bgp(*written), plain.bgp(*written)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want.select(*got.columns))
    for p in (Pattern("?s", "?p", "?o"), Pattern("?s", "?p", "?s", "people"), Pattern("?s", "name", "n1", "?g"), Pattern("?s", "none", "?o", "people")):
        assert rows(store.match(p)) == rows(plain.match(p))
    with pytest.raises(ValueError, match="no shared variable"):
        store.bgp(Pattern("?a", "name", "?b", "people"), Pattern("?c", "land", "?d", "towns"))


def test_query_text(spark, store):
    text = """SELECT ?s ?n ?l WHERE { GRAPH <people> { ?s <name> ?n ; <town> ?t } GRAPH <towns> { ?t <land> ?l } GRAPH <people> { ?s <prize> "gold" }
              OPTIONAL { GRAPH <people> { ?s <none> ?x } } FILTER(LANG(?n) = "en") }"""
    got, want = sparql.run(text, store), sparql.run(text, people(spark).dropna(subset=["s", "p", "o", "g"]))
    assert rows(got) == rows(want) and got.count() == 1
    values = 'SELECT ?s WHERE { GRAPH <people> { ?s <name> ?n } VALUES ?t { "t1" } GRAPH <people> { ?s <town> ?t } }'
    assert rows(sparql.run(values, store)) == [(f"p{k}",) for k in sorted(range(1, 200, 4), key=str)]


def test_empty_and_missing(spark, tmp_path):
    write_graph(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    graph = StoredGraphs(spark, str(tmp_path / "none"))
    assert graph.bgp(Pattern("?s", "a", "?o", "g"), Pattern("?o", "b", "?x", "g")).count() == 0
    with pytest.raises(LookupError):
        StoredGraphs(spark, str(tmp_path / "absent"))
