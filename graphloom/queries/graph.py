"""Graph queries over quads made from the star schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import temporal
from graphloom.operators import alignment
from graphloom.operators.ordered import top_k
from graphloom.operators.similarity import similar_edges
from graphloom.plans.algebra import Graphs, Pattern, annotated, as_quads, group_concat, join, optional, values
from graphloom.queries.registry import query, table

_EDGES = [(1996, False, "early"), (1998, False, "middle"), (1999, True, "late")]
_BUCKET = "CASE WHEN year(o_orderdate) < 1996 THEN 'early' WHEN year(o_orderdate) < 1998 THEN 'middle' WHEN year(o_orderdate) <= 1999 THEN 'late' ELSE 'last' END"


def quads(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(s, p, o, g) of the named tables; one graph a table."""

    def iri(kind: str, key: str):
        return F.concat(F.lit(f"urn:{kind}:"), F.col(key).cast("string"))

    year = F.year("o_orderdate")
    specs = {
        "region": ("region", "r_regionkey", {"name": F.col("r_name")}),
        "nation": ("nation", "n_nationkey", {"name": F.col("n_name"), "region": iri("region", "n_regionkey")}),
        "customer": ("customer", "c_custkey", {"name": F.col("c_name"), "nation": iri("nation", "c_nationkey"), "segment": F.col("c_mktsegment")}),
        "orders": (
            "order",
            "o_orderkey",
            {"customer": iri("customer", "o_custkey"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": year, "bucket": temporal.bucket(year, year, None, _EDGES, "last")},
        ),
        "events": ("event", "event_id", {"type": F.col("event_type"), "user": iri("customer", "user_id"), "value": F.col("value")}),
    }
    made = []
    for name in names or tuple(specs):
        kind, key, columns = specs[name]
        made.append(as_quads(table(spark, sf_dir, name), iri(kind, key), name, columns))
    return reduce(DataFrame.unionByName, made)


_COUNTS = [("region", 1), ("nation", 2), ("customer", 3), ("orders", 5), ("events", 3)]


@query(" UNION ALL ".join(f"SELECT '{t}' AS g, {n} * count(*) AS quads FROM {t}" for t, n in _COUNTS))
def quads_per_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(spark, sf_dir).groupBy("g").agg(F.count("*").alias("quads"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS g, count(*) AS entities FROM {t}" for t, _ in _COUNTS))
def entities_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads(spark, sf_dir).groupBy("g").agg(F.count_distinct("s").alias("entities"))


@query("SELECT event_type AS label, count(*) AS uses, round(avg(value), 4) AS avg_value FROM events GROUP BY 1 ORDER BY uses DESC, label LIMIT 25")
def top_labels_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graphs(quads(spark, sf_dir, "events"))
    rows = graph.bgp(Pattern("?e", "type", "?label", "events"), Pattern("?e", "value", "?v", "events"))
    return rows.groupBy("label").agg(F.count("*").alias("uses"), F.round(F.avg(F.col("v").try_cast("double")), 4).alias("avg_value")).orderBy(F.desc("uses"), "label").limit(25)


@query("""SELECT n_name AS place, CASE WHEN r_name LIKE 'A%' THEN r_name END AS link, count(*) AS customers
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
          GROUP BY 1, 2 ORDER BY customers DESC, place LIMIT 50""")
def optional_link_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graphs(quads(spark, sf_dir, "customer", "nation", "region"))
    places = graph.bgp(Pattern("?c", "nation", "?n", "customer"), Pattern("?n", "name", "?place", "nation"))
    links = graph.bgp(Pattern("?n", "region", "?r", "nation"), Pattern("?r", "name", "?link", "region")).drop("r")
    found = optional(places, links, F.col("link").startswith("A"))
    return found.groupBy("place", "link").agg(F.count("*").alias("customers")).orderBy(F.desc("customers"), "place").limit(50)


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS orders FROM orders GROUP BY 1")
def temporal_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Graphs(quads(spark, sf_dir, "orders")).match(Pattern("?o", "bucket", "?bucket", "orders"))
    return rows.groupBy("bucket").agg(F.count("*").alias("orders")).orderBy("bucket")


@query("""SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
          GROUP BY 1, 2 HAVING count(*) > 10""")
def cross_tab_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graphs(quads(spark, sf_dir, "orders", "customer"))
    rows = graph.bgp(Pattern("?o", "priority", "?priority", "orders"), Pattern("?o", "customer", "?c", "orders"), Pattern("?c", "segment", "?segment", "customer"))
    return rows.groupBy("segment", "priority").agg(F.count("*").alias("n")).where("n > 10").orderBy(F.desc("n"), "segment", "priority")


_SIMILAR = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    p AS (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id),
    edges AS (SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY label, src ORDER BY score DESC, dst) AS r FROM p)
              WHERE r <= 5 AND score >= 0.2 AND src < dst)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_edges(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 5, 0.2)


@query(f"WITH {_SIMILAR} SELECT src, dst, score FROM edges ORDER BY score DESC, src, dst LIMIT 50")
def similarity_pairs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).orderBy(F.desc("score"), "src", "dst").limit(50)


@query(f"""WITH {_SIMILAR} SELECT e.src, e.dst, a.label AS label, c.c_name AS src_name, d.c_name AS dst_name, n.n_name AS src_place, m.n_name AS dst_place, e.score
           FROM edges e JOIN embeddings a ON a.vec_id = e.src JOIN embeddings b ON b.vec_id = e.dst JOIN customer c ON c.c_custkey = e.src JOIN customer d ON d.c_custkey = e.dst
           JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN nation m ON m.n_nationkey = d.c_nationkey ORDER BY e.score DESC, e.src, e.dst LIMIT 40""")
def chain_join_pairs(spark: SparkSession, sf_dir: str, store: Callable[[DataFrame], Graphs] = Graphs) -> DataFrame:
    """The most alike pairs with what both ends are called and where they are: a chain of seven joins."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    graph = store(quads(spark, sf_dir, "customer", "nation"))
    people = graph.bgp(Pattern("?c", "name", "?name", "customer"), Pattern("?c", "nation", "?n", "customer"), Pattern("?n", "name", "?place", "nation"))
    people = people.select(F.substring_index("c", ":", -1).cast("long").alias("vec_id"), "name", "place")
    rows = _edges(spark, sf_dir)
    for end in ("src", "dst"):
        rows = join(rows, people.withColumnsRenamed({"vec_id": end, "name": f"{end}_name", "place": f"{end}_place"}))
    rows = join(join(rows, labels.withColumnRenamed("vec_id", "src")), labels.select(F.col("vec_id").alias("dst")))
    found = rows.select("src", "dst", "label", "src_name", "dst_name", "src_place", "dst_place", "score")
    return found.orderBy(F.desc("score"), "src", "dst").limit(40)


@query("SELECT n_name AS name, r_name AS source FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def provenance_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graphs(quads(spark, sf_dir, "nation", "region"))
    told = graph.bgp(Pattern("?n", "region", "?r", "nation"), Pattern("?r", "name", "?source", "region")).where("source <> 'ASIA'")
    return optional(graph.match(Pattern("?n", "name", "?name", "nation")), told).select("name", "source")


@query("""SELECT c_name AS name, c_mktsegment AS segment, n_name AS nation, CAST(o_orderkey AS VARCHAR) AS order_key, o_orderstatus AS status
          FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (7, 11, 12)""")
def entity_card_multi_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default graph, each branch a left join; several values multiply the rows."""
    graph = Graphs(quads(spark, sf_dir, "customer", "nation", "orders"))
    card = graph.match(Pattern("?c", "name", "?name")).where(F.col("c").isin("urn:customer:7", "urn:customer:11", "urn:customer:12"))
    card = optional(card, graph.match(Pattern("?c", "segment", "?segment")))
    card = optional(card, graph.bgp(Pattern("?c", "nation", "?n"), Pattern("?n", "name", "?nation")).drop("n"))
    orders = graph.bgp(Pattern("?o", "customer", "?c"), Pattern("?o", "status", "?status"))
    return optional(card, orders).select("name", "segment", "nation", F.substring_index("o", ":", -1).alias("order_key"), "status")


@query("""SELECT DISTINCT c_name AS name, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          WHERE contains(lower(o_orderpriority), 'urgent') AND contains(lower(c_mktsegment), 'house')""")
def text_filter_three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graphs(quads(spark, sf_dir, "orders", "customer", "nation"))
    rows = graph.bgp(
        Pattern("?o", "priority", "?priority", "orders"), Pattern("?o", "customer", "?c", "orders"), Pattern("?c", "segment", "?segment", "customer"),
        Pattern("?c", "nation", "?n", "customer"), Pattern("?n", "name", "?place", "nation"), Pattern("?c", "name", "?name", "customer"),
    )
    kept = rows.where(F.lower("priority").contains("urgent") & F.lower("segment").contains("house"))
    return kept.select("name", "priority").distinct()


@query("SELECT o_orderkey AS order_key, o_orderpriority AS priority FROM orders WHERE contains(o_orderpriority, 'HIGH') OR contains(o_orderpriority, 'LOW')")
def disjunctive_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Graphs(quads(spark, sf_dir, "orders")).match(Pattern("?o", "priority", "?priority", "orders"))
    kept = rows.where(F.col("priority").contains("HIGH") | F.col("priority").contains("LOW"))
    return kept.select(F.substring_index("o", ":", -1).cast("long").alias("order_key"), "priority")


@query("""SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'wikidata' WHEN starts_with(p_brand, 'Brand#2') THEN 'geonames' ELSE 'other' END AS authority,
                 CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'https://www.wikidata.org/wiki/Q' || p_size WHEN starts_with(p_brand, 'Brand#2') THEN 'https://www.geonames.org/' || p_size ELSE 'https://example.org/' || p_size END AS browse FROM part""")
def authority_nested_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, size = F.col("p_brand"), F.col("p_size").cast("string")
    iri = F.when(brand.startswith("Brand#1"), F.concat(F.lit("https://www.wikidata.org/entity/Q"), size)).when(brand.startswith("Brand#2"), F.concat(F.lit("https://sws.geonames.org/"), size, F.lit("/")))
    rows = table(spark, sf_dir, "part").select("p_partkey", iri.otherwise(F.concat(F.lit("https://example.org/"), size)).alias("iri"))
    return rows.select("p_partkey", alignment.authority(F.col("iri")).alias("authority"), alignment.browse_url(F.col("iri")).alias("browse"))


@query("SELECT o_custkey AS customer, o_orderkey AS order_key, year(o_orderdate) AS year, o_orderstatus AS status FROM orders WHERE o_custkey IN (3, 4, 5)")
def sequence_values_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graphs(quads(spark, sf_dir, "orders"))
    star = graph.star("o", "orders", c="customer", status="status", y="year")
    tail = lambda c: F.substring_index(c, ":", -1).cast("long")
    kept = values(star, "c", [f"urn:customer:{k}" for k in (3, 4, 5)])
    return kept.select(tail("c").alias("customer"), tail("o").alias("order_key"), F.col("y").cast("long").alias("year"), "status").orderBy("customer", "year", "order_key")


@query("SELECT event_type AS type, count(*) AS n FROM events WHERE contains(event_type, 'err') OR contains(event_type, 'view') OR contains(event_type, 'sign') GROUP BY 1")
def labels_of_any_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Graphs(quads(spark, sf_dir, "events")).match(Pattern("?e", "type", "?type", "events"))
    t = F.col("type")
    return rows.where(t.contains("err") | t.contains("view") | t.contains("sign")).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_id, user_id, CAST(floor(epoch(ts) * 1000) AS BIGINT) AS ms FROM events WHERE event_type = 'error'")
def media_of_marked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording and the place in it of each segment with a marker, from three graphs."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    said = as_quads(table(spark, sf_dir, "events"), F.concat(F.lit("urn:event:"), "event_id"), "transcripts", {"start": ms})
    graph = Graphs(quads(spark, sf_dir, "events").unionByName(said))
    marked = graph.bgp(Pattern("?e", "type", "error", "events"), Pattern("?e", "user", "?u", "events"), Pattern("?e", "start", "?ms", "transcripts"))
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return marked.select(number("e").alias("event_id"), number("u").alias("user_id"), F.col("ms").cast("long").alias("ms")).distinct()


@query("""SELECT o_orderpriority AS priority, count(DISTINCT o_custkey) AS customers, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1""")
def coverage_two_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Graphs(quads(spark, sf_dir, "orders")).star("o", "orders", priority="priority", c="customer", y="year")
    return rows.groupBy("priority").agg(F.count_distinct("c").alias("customers"), F.count_distinct("y").alias("years")).orderBy(F.desc("customers"), "priority")


@query("""SELECT c_custkey AS customer, CAST(NULL AS VARCHAR) AS label, count(DISTINCT o_orderstatus) AS statuses FROM orders JOIN customer ON o_custkey = c_custkey
          GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 2""")
def having_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label is looked up in a graph that has none: the optional side stays unbound."""
    graph = Graphs(quads(spark, sf_dir, "orders", "customer"))
    rows = graph.bgp(Pattern("?o", "customer", "?c", "orders"), Pattern("?o", "status", "?s", "orders"))
    rows = optional(rows, graph.match(Pattern("?c", "name", "?label", "orders")))
    found = rows.groupBy("c", "label").agg(F.count_distinct("s").alias("statuses")).where("statuses > 2")
    return found.select(F.substring_index("c", ":", -1).cast("long").alias("customer"), "label", "statuses")


@query(f"SELECT {_BUCKET} AS bucket, o_orderpriority AS activity, count(*) AS n FROM orders GROUP BY 1, 2")
def period_activity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Graphs(quads(spark, sf_dir, "orders")).star("o", "orders", bucket="bucket", activity="priority")
    return rows.groupBy("bucket", "activity").agg(F.count("*").alias("n")).orderBy("bucket", "activity")


@query("SELECT event_type AS activity, count(*) AS events, round(avg(value), 4) AS avg_valence, round(avg(user_id), 4) AS avg_arousal FROM events GROUP BY 1")
def mean_va_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graphs(quads(spark, sf_dir, "events"))
    rows = graph.star("e", "events", activity="type", v="value", u="user")
    arousal = F.substring_index("u", ":", -1).try_cast("double")
    return rows.groupBy("activity").agg(F.count("*").alias("events"), F.round(F.avg(F.col("v").try_cast("double")), 4).alias("avg_valence"), F.round(F.avg(arousal), 4).alias("avg_arousal"))


@query("""WITH d AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer)
          SELECT 'NATION_' || a.n AS a, 'NATION_' || b.n AS b, count(*) AS shared FROM d a JOIN d b ON a.s = b.s AND ('NATION_' || a.n) < ('NATION_' || b.n) GROUP BY 1, 2 HAVING count(*) >= 4""")
def shared_pairs_theta_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (nation, segment) first, then the self-join: rows grow with distinct pairs only."""
    graph = Graphs(quads(spark, sf_dir, "customer", "nation"))
    d = graph.bgp(Pattern("?c", "nation", "?n", "customer"), Pattern("?c", "segment", "?s", "customer"), Pattern("?n", "name", "?a", "nation")).select("a", "s").distinct()
    pairs = d.join(d.withColumnRenamed("a", "b"), "s").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared >= 4").orderBy(F.desc("shared"), "a", "b")


@query("""SELECT o_orderpriority AS place, year(o_orderdate) AS year, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW')
          AND year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2""")
def values_multi_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Graphs(quads(spark, sf_dir, "orders")).star("o", "orders", place="priority", y="year")
    kept = values(values(rows, "place", ["1-URGENT", "3-MEDIUM", "5-LOW"]), "y", ["1996", "1997"])
    return kept.groupBy("place", F.col("y").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(DISTINCT event_id) AS marks, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1 ORDER BY marks DESC, user_id LIMIT 25")
def density_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_id").alias("marks"), F.count_distinct("event_type").alias("kinds"))
    return rows.orderBy(F.desc("marks"), "user_id").limit(25)


@query("""SELECT DISTINCT n_name AS place, c_name AS interview, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
          LEFT JOIN region ON r_regionkey = n_regionkey AND r_name = 'EUROPE' WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3')""")
def place_to_interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graphs(quads(spark, sf_dir, "customer", "nation", "region"))
    rows = values(graph.bgp(Pattern("?c", "nation", "?n", "customer"), Pattern("?n", "name", "?place", "nation"), Pattern("?c", "name", "?interview", "customer")), "place", ["NATION_1", "NATION_2", "NATION_3"])
    regions = graph.bgp(Pattern("?n", "region", "?r", "nation"), Pattern("?r", "name", "?region", "region")).where("region = 'EUROPE'").drop("r")
    return optional(rows, regions).select("place", "interview", "region").distinct()


@query("SELECT (SELECT count(*) FROM customer) AS interviews, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM orders) AS segments")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts apart from each other: conditional aggregates of one scan of the quads, no cross product."""
    q = quads(spark, sf_dir, "customer", "events", "orders")
    n = lambda g, p, name: F.count(F.when((F.col("g") == g) & (F.col("p") == p), 1)).alias(name)
    return q.agg(n("customer", "name", "interviews"), n("events", "type", "events"), n("orders", "status", "segments"))


@query("""WITH f AS (SELECT year(o_orderdate) AS period, o_orderpriority AS activity, o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1, 2, 3),
          t AS (SELECT activity FROM f GROUP BY 1 ORDER BY sum(n) DESC, activity LIMIT 3)
          SELECT period, activity, category, n FROM f WHERE activity IN (SELECT activity FROM t)""")
def sankey_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("period"), F.col("o_orderpriority").alias("activity"), F.col("o_orderstatus").alias("category")).agg(F.count("*").alias("n"))
    top = flow.groupBy("activity").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "activity").limit(3)
    return flow.join(top, "activity", "left_semi").select("period", "activity", "category", "n")


@query("""WITH f AS (SELECT year(o_orderdate) AS period, o_orderpriority AS activity, count(*) AS n FROM orders GROUP BY 1, 2)
          SELECT period, activity, round(100.0 * n / sum(n) OVER (PARTITION BY period), 4) AS share FROM f""")
def share_of_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    flow = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("period"), F.col("o_orderpriority").alias("activity")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("period"))
    return flow.select("period", "activity", F.round(100.0 * F.col("n") / total, 4).alias("share"))


@query("SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, label LIMIT 100")
def dropdown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Graphs(quads(spark, sf_dir, "customer")).match(Pattern("?c", "segment", "?label", "customer"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(100)


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey
          WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997 AND c_mktsegment = 'BUILDING'""")
def free_form_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any subset of filters, combined when the plan is built."""
    asked = {"o_orderstatus": "F", "year": 1997, "c_mktsegment": "BUILDING", "o_orderpriority": None}
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    test = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in asked.items() if v is not None])
    return rows.where(test).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 50 OFFSET 100")
def paging_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_name").offset(100).limit(50)


@query("SELECT o_custkey AS customer, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def group_concat_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Graphs(quads(spark, sf_dir, "orders")).bgp(Pattern("?o", "customer", "?c", "orders"), Pattern("?o", "priority", "?p", "orders"))
    return rows.groupBy(F.substring_index("c", ":", -1).cast("long").alias("customer")).agg(group_concat("p").alias("priorities"))


@query("SELECT o_orderkey AS order_key, o_orderstatus AS status, round(o_totalprice, 2) AS confidence FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'P'")
def statement_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of quoted statements joined on subject, predicate and object."""
    orders = table(spark, sf_dir, "orders")
    notes = orders.select(F.concat(F.lit("urn:order:"), F.col("o_orderkey").cast("string")).alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("o"), F.lit("confidence").alias("ap"), F.col("o_totalprice").alias("ao"))
    told = annotated(quads(spark, sf_dir, "orders").where("p = 'status' AND o = 'P'"), notes).where("ap = 'confidence' AND ao > 100000")
    return told.select(F.substring_index("s", ":", -1).cast("long").alias("order_key"), F.col("o").alias("status"), F.round("ao", 2).alias("confidence"))


@query("SELECT count(*) AS triples FROM (SELECT DISTINCT s, p, o FROM (SELECT n_nationkey AS s, 'name' AS p, n_name AS o FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation))")
def default_graph_is_a_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads(spark, sf_dir, "nation")
    twice = q.unionByName(q.withColumn("g", F.lit("copy")))
    return Graphs(twice).default_graph().agg(F.count("*").alias("triples"))


@query("SELECT 'urn:customer:' || c_custkey AS s, 'lives_in' AS p, r_name AS o, 'derived' AS g FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def construct_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graphs(quads(spark, sf_dir, "customer", "nation", "region"))
    rows = graph.bgp(Pattern("?c", "nation", "?n", "customer"), Pattern("?n", "region", "?r", "nation"), Pattern("?r", "name", "?place", "region"))
    return graph.construct(rows, Pattern("?c", "lives_in", "?place", "derived"))


@query("SELECT count(*) AS n FROM nation WHERE n_name = 'NATION_1' AND n_regionkey = 1")
def variable_graph_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both patterns must hold in the same graph."""
    graph = Graphs(quads(spark, sf_dir, "nation", "region"))
    rows = graph.bgp(Pattern("?x", "name", "NATION_1", "?g"), Pattern("?x", "region", "urn:region:1", "?g"))
    return rows.agg(F.count("*").alias("n"))


@query("SELECT DISTINCT ON (c_nationkey) c_nationkey AS nation, c_name AS richest FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_name")
def one_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = top_k(table(spark, sf_dir, "customer"), 1, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_name")])
    return rows.select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("richest"))
