"""What pages and the REST interface ask for: lists, details, marts and query texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.plans import sparql
from graphloom.plans.algebra import Graphs, Pattern, annotated, join, optional
from graphloom.queries.graph import quads
from graphloom.queries.registry import query, table
from graphloom.queries.texts import _TOKENS
from graphloom.session import scratch
from graphloom.sinks.writers import kept_for, write_marts
from graphloom.sources.tables import mart


def _number(iri: str):
    return F.substring_index(iri, ":", -1).cast("long")


def list_events(graph: Graphs, activity: str | None = None, place: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of events with text, activity and place where they have them; filters are optional."""
    events = graph.match(Pattern("?e", "customer", "?c", "orders"))
    found = optional(events, graph.match(Pattern("?e", "status", "?what", "orders")), F.col("what") != "P")
    acts = graph.match(Pattern("?e", "priority", "?activity", "orders"))
    places = graph.bgp(Pattern("?c", "nation", "?n", "customer"), Pattern("?n", "name", "?place", "nation")).drop("n")
    found = optional(found, acts) if activity is None else join(found, acts.where(F.col("activity") == activity))
    found = optional(found, places) if place is None else join(found, places.where(F.col("place") == place))
    return found.select(_number("e").alias("id"), "what", "activity", "place").orderBy("id").offset(offset).limit(limit)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS what, o_orderpriority AS activity, n_name AS place
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' AND n_name = 'NATION_3' ORDER BY 1 LIMIT 20 OFFSET 5""")
def rest_events_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_events(Graphs(quads(spark, sf_dir, "orders", "customer", "nation")), "1-URGENT", "NATION_3", 20, 5)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS what, o_orderpriority AS activity, n_name AS place
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY 1 LIMIT 50""")
def rest_events_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_events(Graphs(quads(spark, sf_dir, "orders", "customer", "nation")))


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey < 12 THEN c_name END AS label FROM customer ORDER BY 1 LIMIT 50 OFFSET 50""")
def rest_interviews_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graphs(quads(spark, sf_dir, "customer"))
    named = graph.bgp(Pattern("?c", "nation", "?n", "customer"), Pattern("?c", "name", "?label", "customer")).where(_number("n") < 12).drop("n")
    return optional(graph.match(Pattern("?c", "segment", "?s", "customer")), named).select(_number("c").alias("id"), "label").orderBy("id").offset(50).limit(50)


@query("""WITH c AS (SELECT * FROM customer WHERE c_custkey = 7), n AS (SELECT count(*) AS events FROM orders WHERE o_custkey = 7)
    SELECT p, o, events FROM (SELECT 'name' AS p, c_name AS o FROM c UNION ALL SELECT 'nation', 'urn:nation:' || c_nationkey FROM c UNION ALL SELECT 'segment', c_mktsegment FROM c), n""")
def rest_interview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is said of one subject in any graph, with how many events refer to it."""
    graph = Graphs(quads(spark, sf_dir, "customer", "orders"))
    events = graph.match(Pattern("?e", "customer", "urn:customer:7", "orders")).agg(F.count("*").alias("events"))
    return graph.match(Pattern("urn:customer:7", "?p", "?o", "?g")).select("p", "o").join(F.broadcast(events))  # one row


@query("""WITH e AS (SELECT * FROM orders WHERE o_orderkey = 11)
    SELECT 'property' AS kind, 'status' AS p, o_orderstatus AS o FROM e UNION ALL SELECT 'property', 'priority', o_orderpriority FROM e UNION ALL SELECT 'property', 'year', CAST(year(o_orderdate) AS VARCHAR) FROM e
    UNION ALL SELECT 'property', 'customer', 'urn:customer:' || o_custkey FROM e UNION ALL SELECT 'status|' || o_orderstatus, 'method', 'rule' FROM e""")
def rest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's properties and the annotations of its statements."""
    told = quads(spark, sf_dir, "orders").where("s = 'urn:order:11' AND p <> 'bucket'")
    notes = told.where("p = 'status'").select("s", "p", "o", F.lit("method").alias("ap"), F.lit("rule").alias("ao"))
    made = annotated(told, notes).select(F.concat_ws("|", "p", "o").alias("kind"), F.col("ap").alias("p"), F.col("ao").alias("o"))
    return told.select(F.lit("property").alias("kind"), "p", "o").unionByName(made)


_DETAIL = """SELECT o_orderkey AS event, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS what, CASE WHEN n_regionkey <> 0 THEN n_name END AS place,
    CASE WHEN year(o_orderdate) >= 1996 THEN year(o_orderdate) END AS y, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS activity, event_type AS emotion, CASE WHEN value > 10 THEN round(value, 4) END AS valence
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN events ON event_id = o_orderkey WHERE o_custkey < 40"""


def interview_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of some interviews, each with up to six things that may be missing."""
    graph = Graphs(quads(spark, sf_dir, "orders", "customer", "nation"))
    rows = graph.match(Pattern("?e", "customer", "?c", "orders")).where(_number("c") < 40)
    rows = optional(rows, graph.match(Pattern("?e", "status", "?what", "orders")), F.col("what") != "P")
    places = graph.bgp(Pattern("?c", "nation", "?n", "customer"), Pattern("?n", "name", "?place", "nation"), Pattern("?n", "region", "?r", "nation"))
    rows = optional(rows, places.where("r <> 'urn:region:0'").drop("n", "r"))
    rows = optional(rows, graph.match(Pattern("?e", "year", "?y", "orders")), F.col("y").cast("int") >= 1996)
    rows = optional(rows, graph.match(Pattern("?e", "priority", "?activity", "orders")), F.col("activity") != "3-MEDIUM")
    felt = table(spark, sf_dir, "events").select(F.concat(F.lit("urn:order:"), "event_id").alias("e"), F.col("event_type").alias("emotion"), F.when(F.col("value") > 10, F.round("value", 4)).alias("valence"))
    rows = optional(rows, felt)
    return rows.select(_number("e").alias("event"), "what", "place", F.col("y").cast("long").alias("y"), "activity", "emotion", "valence")


@query(f"SELECT * FROM ({_DETAIL}) ORDER BY y NULLS FIRST, event LIMIT 500")
def interview_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interview_events(spark, sf_dir).orderBy(F.asc_nulls_first("y"), "event").limit(500)


@query(f"SELECT 'emotion' AS kind, emotion AS label, count(*) AS n FROM ({_DETAIL}) WHERE emotion <> '' GROUP BY 2 UNION ALL SELECT 'place', place, count(*) FROM ({_DETAIL}) WHERE place <> '' GROUP BY 2")
def interview_detail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each emotion and place occurs; empty ones don't count.  One scan of the events."""
    rows = interview_events(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("emotion", "place")])).alias("x")
    return rows.select(each).select("x.*").where("label <> ''").groupBy("kind", "label").agg(F.count("*").alias("n"))


@query("""SELECT n_name AS label, count(*) AS event_count, CASE WHEN r_name IN ('AFRICA', 'ASIA') THEN r_name END AS wikidata, CASE WHEN r_name NOT IN ('AFRICA', 'ASIA') THEN r_name END AS geonames
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL ORDER BY event_count DESC, label LIMIT 500""")
def mart_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by events, with the links of either authority."""
    graph = Graphs(quads(spark, sf_dir, "customer", "nation", "region"))
    events = graph.bgp(Pattern("?e", "nation", "?place", "customer"), Pattern("?place", "name", "?label", "nation"))
    links = graph.bgp(Pattern("?place", "region", "?r", "nation"), Pattern("?r", "name", "?link", "region")).drop("r")
    near = F.col("link").isin("AFRICA", "ASIA")
    rows = optional(optional(events, links.where(near).withColumnRenamed("link", "wikidata")), links.where(~near).withColumnRenamed("link", "geonames"))
    counted = rows.groupBy("place", "label", "wikidata", "geonames").agg(F.count("e").alias("event_count"))
    return counted.orderBy(F.desc("event_count"), "label").limit(500).drop("place")


def marts(spark: SparkSession, sf_dir: str) -> dict:
    """Builders of the marts that pages read, by name; each gives label and n."""
    q = quads(spark, sf_dir)
    count = lambda g, p: lambda: Graphs(q).match(Pattern("?s", p, "?label", g)).groupBy("label").agg(F.count("*").alias("n"))
    graph = Graphs(q)
    named = lambda: graph.bgp(Pattern("?c", "nation", "?n", "customer"), Pattern("?n", "name", "?label", "nation")).groupBy("label").agg(F.count("*").alias("n"))
    interviews = lambda: graph.match(Pattern("?c", "name", "?label", "customer")).select("label", F.lit(1).cast("long").alias("n"))
    return {"activities": count("orders", "priority"), "emotions": count("events", "type"), "places": named, "interviews": interviews, "historical_events": count("orders", "status"), "periods": count("orders", "bucket")}


_BUCKETS = "CASE WHEN year(o_orderdate) < 1996 THEN 'early' WHEN year(o_orderdate) < 1998 THEN 'middle' WHEN year(o_orderdate) <= 1999 THEN 'late' ELSE 'last' END"


@query(f"""SELECT 'activities' AS mart, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'emotions', event_type, count(*) FROM events GROUP BY 2
    UNION ALL SELECT 'places', n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 UNION ALL SELECT 'interviews', c_name, 1 FROM customer
    UNION ALL SELECT 'historical_events', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'periods', {_BUCKETS}, count(*) FROM orders GROUP BY 2""")
def marts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All marts written and read again; one that was never written is missed, not an error."""
    folder, found = scratch(spark), None
    for name in [*write_marts(spark, marts(spark, sf_dir), folder), "never_written"]:
        one = mart(spark, folder, name)
        if one is not None:
            one = one.select(F.lit(name).alias("mart"), "label", "n")
            found = one if found is None else found.unionByName(one)
    return found


@query("SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1")
def result_kept_for_an_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built once; the second call reads what the first one wrote."""
    folder = scratch(spark)
    build = lambda: table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"))
    kept_for(spark, folder, "segments", 3600, build)
    return kept_for(spark, folder, "segments", 3600, lambda: table(spark, sf_dir, "customer").limit(0))


@query("""SELECT c_mktsegment AS survivor_group, o_orderpriority AS activity, count(*) AS events, count(DISTINCT o_custkey) AS survivors FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (1996, 1997) AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') GROUP BY 1, 2""")
def explore_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under four filters at once, and how many different survivors tell of them."""
    graph = Graphs(quads(spark, sf_dir, "orders", "customer", "nation"))
    rows = graph.star("o", "orders", c="customer", status="status", activity="priority", y="year").where("status = 'F' AND y IN ('1996', '1997')")
    people = graph.star("c", "customer", n="nation", survivor_group="segment")
    places = graph.match(Pattern("?n", "name", "?place", "nation")).where(F.col("place").isin([f"NATION_{k}" for k in range(1, 5)]))
    return join(join(rows, people), places).groupBy("survivor_group", "activity").agg(F.count("*").alias("events"), F.count_distinct("c").alias("survivors"))


@query("""SELECT 'quads' AS part, count(*) > 0 AS ok FROM nation UNION ALL SELECT 'interviews', count(*) > 0 FROM customer UNION ALL SELECT 'missing', false""")
def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part answers: an ASK each."""
    graph = Graphs(quads(spark, sf_dir, "nation", "customer"))
    asked = {"quads": Pattern("?s", "?p", "?o"), "interviews": Pattern("?c", "name", "?n", "customer"), "missing": Pattern("?s", "?p", "?o", "nowhere")}
    return spark.createDataFrame([(k, graph.ask(p)) for k, p in asked.items()], "part string, ok boolean")


@query("""SELECT year(o_orderdate) AS y, string_agg(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN c_name ELSE CAST(o_custkey AS VARCHAR) END, '|' ORDER BY CASE WHEN o_custkey % 3 = 0 THEN c_name ELSE CAST(o_custkey AS VARCHAR) END) AS people
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1""")
def sparql_nested_optional_labels(spark: SparkSession, sf_dir: str, store: Callable[[DataFrame], Graphs] = Graphs) -> DataFrame:
    """Labels from another graph, or else the end of the address."""
    told = quads(spark, sf_dir, "orders", "customer")
    told = told.where("NOT (g = 'customer' AND p = 'name') OR cast(substring_index(s, ':', -1) AS long) % 3 = 0")
    found = sparql.run(
        """SELECT ?y (GROUP_CONCAT(DISTINCT ?label; separator="|") AS ?people) WHERE {
             GRAPH <orders> { ?o <status> "P" ; <year> ?y ; <customer> ?c . OPTIONAL { GRAPH <customer> { ?c <name> ?l } } BIND(COALESCE(?l, REPLACE(STR(?c), ".*[/:]", "")) AS ?label) }
           } GROUP BY ?y""",
        store(told),
    )
    return found.select(F.col("y").cast("long").alias("y"), "people")


_TAG = "CASE n_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE '' END"


@query(f"""SELECT 'urn:nation:' || n_nationkey AS place, CASE WHEN {_TAG} IN ('en', '') THEN n_name END AS label, 'urn:region:' || n_regionkey AS target, CASE WHEN {_TAG} IN ('en', '') THEN {_TAG} ELSE '' END AS tag FROM nation""")
def sparql_language_tags(spark: SparkSession, sf_dir: str, store: Callable[[DataFrame], Graphs] = Graphs) -> DataFrame:
    """Labels in English or without a language, if there are any."""
    names = table(spark, sf_dir, "nation").selectExpr("concat('urn:nation:', n_nationkey) AS s", "'label' AS p", "n_name AS o", "'metadata' AS g", f"{_TAG} AS lang")
    links = table(spark, sf_dir, "nation").selectExpr("concat('urn:nation:', n_nationkey) AS s", "'match' AS p", "concat('urn:region:', n_regionkey) AS o", "'alignment' AS g", "cast(NULL AS string) AS lang")
    return sparql.run(
        """SELECT ?place ?label ?target (LANG(?label) AS ?tag) WHERE { GRAPH <alignment> { ?place <match> ?target }
             OPTIONAL { GRAPH <metadata> { ?place <label> ?label . FILTER(LANG(?label) = "en" || LANG(?label) = "") } } }""",
        store(names.unionByName(links)),
    )


@query("""SELECT 'urn:nation:' || n_nationkey AS n, r_name AS link FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND starts_with(r_name, 'A') ORDER BY link DESC NULLS LAST, n LIMIT 12""")
def sparql_unbound_sorts_lowest(spark: SparkSession, sf_dir: str, store: Callable[[DataFrame], Graphs] = Graphs) -> DataFrame:
    """Falling order puts what is unbound last; the limit shows it."""
    return sparql.run(
        """SELECT ?n ?link WHERE { GRAPH <nation> { ?n <name> ?x } OPTIONAL { GRAPH <nation> { ?n <region> ?r } GRAPH <region> { ?r <name> ?link } FILTER(STRSTARTS(?link, "A")) } } ORDER BY DESC(?link) ?n LIMIT 12""",
        store(quads(spark, sf_dir, "nation", "region")),
    )


@query("SELECT 'urn:region:' || r_regionkey AS s, 'name' AS p, r_name AS o FROM region")
def sparql_select_star(spark: SparkSession, sf_dir: str, store: Callable[[DataFrame], Graphs] = Graphs) -> DataFrame:
    return sparql.run("SELECT * WHERE { GRAPH <region> { ?s ?p ?o } }", store(quads(spark, sf_dir, "region")))


@query("""SELECT n_name AS name, split_part(n_name, '_', 1) AS before, '' AS absent, substr(n_name, 8) AS after, replace(n_name, 'NATION', 'x') AS short, substr(n_name, 1, 3) AS head, lower(n_name) || '!' AS joined FROM nation""")
def sparql_string_functions(spark: SparkSession, sf_dir: str, store: Callable[[DataFrame], Graphs] = Graphs) -> DataFrame:
    return sparql.run(
        """SELECT ?name (STRBEFORE(?name, "_") AS ?before) (STRBEFORE(?name, "#") AS ?absent) (STRAFTER(?name, "_") AS ?after) (REPLACE(?name, "NATION", "x") AS ?short)
             (SUBSTR(?name, 1, 3) AS ?head) (CONCAT(LCASE(?name), "!") AS ?joined) WHERE { GRAPH <nation> { ?n <name> ?name } }""",
        store(quads(spark, sf_dir, "nation")),
    )


_SEARCH = f"""i AS (SELECT doc_id, term, count(*) AS tf FROM {_TOKENS} AND term IN ('erea', 'onea') GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM i GROUP BY 1), n AS (SELECT count(*) AS total FROM documents),
    h AS (SELECT doc_id, round(sum(tf * ln(1 + total / df)), 6) AS score FROM i JOIN d USING (term), n GROUP BY 1 HAVING count(*) = 2)"""


@query(f"""WITH {_SEARCH}, f AS (SELECT doc_id, source, lang, score, count(*) OVER () AS total, regexp_replace(regexp_replace(text, 'erea', '<mark>erea</mark>', 'gi'), 'onea', '<mark>onea</mark>', 'gi') AS marked FROM h JOIN documents USING (doc_id) WHERE source <> 'src1')
    SELECT doc_id, source, score, total, length(marked) AS marked_chars FROM f ORDER BY score DESC, doc_id LIMIT 10 OFFSET 5""")
def search_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, a filter, a page, the total of hits and marked matches; scores over all documents."""
    docs = table(spark, sf_dir, "documents")
    terms = ["erea", "onea"]
    hits = search.search(search.inverted_index(docs, "doc_id", "text", only=terms), terms, "doc_id", docs.count())
    page = search.search_page(docs, hits, terms, "doc_id", "text", ["doc_id", "source"], where=F.col("source") != "src1", limit=10, offset=5)
    return page.select("doc_id", "source", "score", "total", F.length("marked").alias("marked_chars"))


@query(f"WITH {_SEARCH} SELECT doc_id, score FROM h")
def written_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written once; a search reads the folders of its words."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark)
    search.write_index(docs, "doc_id", "text", path)
    return search.search(search.read_index(spark, path, ["erea", "onea"]), ["erea", "onea"], "doc_id", docs.count())


@query("SELECT p_partkey AS key, p_name AS label FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'small') AND list_contains(string_split(lower(p_name), ' '), 'ring')")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.label_lookup(table(spark, sf_dir, "part"), "p_partkey", "p_name", ["Small", "ring"])
    return found.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("label"))


@query(f"""WITH w AS (SELECT lang || '/' || source AS g, term FROM {_TOKENS.replace("doc_id, lang,", "doc_id, lang, source,")}), c AS (SELECT g, term, count(*) AS c1 FROM w GROUP BY 1, 2),
    s AS (SELECT g, term, c1, sum(c1) OVER (PARTITION BY term) - c1 AS c2, sum(c1) OVER (PARTITION BY g) AS n1, sum(c1) OVER () - sum(c1) OVER (PARTITION BY g) AS n2 FROM c),
    z AS (SELECT g, term, c1, c2, round((ln((c1 + 0.5) / (n1 - c1 + 0.5)) - ln((c2 + 0.5) / (n2 - c2 + 0.5))) / sqrt(1 / (c1 + 0.5) + 1 / (c2 + 0.5)), 4) AS score FROM s WHERE c1 >= 25)
    SELECT g AS "group", term, score, c1 AS in_count, CAST(c2 AS BIGINT) AS rest_count FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, term DESC) AS r FROM z) WHERE r <= 20""")
def surprise_by_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms over-represented in each pair of two groupings."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("pair"), "text")
    return search.surprising_terms(docs, "pair", "text", 25, 20)
