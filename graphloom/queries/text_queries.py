"""Queries given as text, run by the parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans import sparql
from graphloom.plans.algebra import Graphs
from graphloom.queries.graph import quads
from graphloom.queries.registry import query, table


@query("""SELECT n_name AS place, r_name AS link, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND starts_with(r_name, 'A')
          WHERE contains(lower(c_mktsegment), 'build') OR c_mktsegment = 'MACHINERY' GROUP BY 1, 2 HAVING count(*) > 3 ORDER BY n DESC, place LIMIT 20""")
def sparql_optional_group(spark: SparkSession, sf_dir: str, store: Callable[[DataFrame], Graphs] = Graphs) -> DataFrame:
    return sparql.run(
        """
        PREFIX x: <>
        SELECT ?place ?link (COUNT(DISTINCT ?c) AS ?n) WHERE {
          GRAPH <customer> { ?c <nation> ?nation ; <segment> ?segment . FILTER(CONTAINS(LCASE(?segment), "build") || ?segment = "MACHINERY") }
          GRAPH <nation> { ?nation <name> ?place }
          OPTIONAL { GRAPH <nation> { ?nation <region> ?r } GRAPH <region> { ?r <name> ?link } FILTER(STRSTARTS(STR(?link), "A")) }
        } GROUP BY ?place ?link HAVING (COUNT(DISTINCT ?c) > 3) ORDER BY DESC(?n) ?place LIMIT 20
        """,
        store(quads(spark, sf_dir, "customer", "nation", "region")),
    )


@query("""WITH d AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer) SELECT 'NATION_' || a.n AS a, 'NATION_' || b.n AS b, count(*) AS shared FROM d a JOIN d b ON a.s = b.s
          AND ('NATION_' || a.n) < ('NATION_' || b.n) GROUP BY 1, 2 HAVING count(*) >= 5""")
def sparql_subselect_self_join(spark: SparkSession, sf_dir: str, store: Callable[[DataFrame], Graphs] = Graphs) -> DataFrame:
    side = "{ SELECT DISTINCT (?name AS ?%s) ?s WHERE { GRAPH <customer> { ?c <nation> ?n ; <segment> ?s } GRAPH <nation> { ?n <name> ?name } } }"
    return sparql.run(
        f"SELECT ?a ?b (COUNT(*) AS ?shared) WHERE {{ {side % 'a'} {side % 'b'} FILTER(STR(?a) < STR(?b)) }} GROUP BY ?a ?b HAVING (COUNT(*) >= 5)",
        store(quads(spark, sf_dir, "customer", "nation")),
    )


@query("""SELECT o_orderpriority AS priority, CASE WHEN starts_with(o_orderpriority, '1') THEN 'now' WHEN starts_with(o_orderpriority, '2') THEN 'soon' ELSE 'later' END AS kind, round(avg(year(o_orderdate)), 4) AS year
          FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND year(o_orderdate) >= 1997 GROUP BY 1, 2""")
def sparql_values_bind_if(spark: SparkSession, sf_dir: str, store: Callable[[DataFrame], Graphs] = Graphs) -> DataFrame:
    found = sparql.run(
        """SELECT ?priority ?kind (AVG(?y) AS ?year) WHERE { VALUES ?priority { "1-URGENT" "2-HIGH" "5-LOW" }
             GRAPH <orders> { ?o <priority> ?priority ; <year> ?y } FILTER(?y >= 1997)
             BIND(IF(STRSTARTS(?priority, "1"), "now", IF(STRSTARTS(?priority, "2"), "soon", "later")) AS ?kind) } GROUP BY ?priority ?kind""",
        store(quads(spark, sf_dir, "orders")),
    )
    return found.withColumn("year", F.round("year", 4))


@query("SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_totalprice > 450000")
def sparql_annotations(spark: SparkSession, sf_dir: str, store: Callable[[DataFrame], Graphs] = Graphs) -> DataFrame:
    notes = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("urn:order:"), F.col("o_orderkey")).alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("o"), F.lit("price").alias("ap"), F.col("o_totalprice").cast("string").alias("ao")
    )
    found = sparql.run("SELECT ?s ?status WHERE { GRAPH <orders> { ?s <status> ?status } << ?s <status> ?status >> <price> ?v FILTER(?v > 450000) }", store(quads(spark, sf_dir, "orders")), notes)
    return found.select(F.substring_index("s", ":", -1).cast("long").alias("k"), "status")
