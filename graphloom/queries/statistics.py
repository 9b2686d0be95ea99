"""Similarity, search, term statistics and evaluation on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import quality, search, similarity
from graphloom.operators.pipeline_tables import build_quads, valence_by_activity
from graphloom.operators.topk_join import topk_edges
from graphloom.queries.graph import _SIMILAR, _edges
from graphloom.queries.registry import query, table
from graphloom.queries.texts import _TOKENS


@query(f"WITH {_SIMILAR} SELECT src, dst, score FROM edges")
def cosine_topk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"WITH {_SIMILAR} SELECT src, dst, score FROM edges")
def topk_edges_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges by cells and bounds: a vector visits only cells that can hold one of its nearest."""
    return topk_edges(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 5, 0.2, cell_rows=250)


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 3)
    SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, v), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score FROM embeddings, q WHERE vec_id <> 3 ORDER BY score DESC, vec_id LIMIT 10""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    q = rows.where("vec_id = 3").select("embedding").first()
    return similarity.nearest(rows, list(q["embedding"]) if q else [], "vec_id", "embedding", 10, skip=3)


@query("""WITH p AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_sum(list_transform(list_zip(r.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score
    FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
    SELECT query_id, vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def knn_topk_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours of all rows whose id is divisible by 20, among all other rows."""
    return similarity.nearest_of_all(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the coarse quantiser; recall is measured in the tests."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return similarity.nearest_of_all(rows, "vec_id", "embedding", 10, cells=similarity.assign_cells(rows, "vec_id", "embedding"))


@query(f"""WITH {_SIMILAR} SELECT round(quantile_cont(score, 0.5), 5) AS p50, round(quantile_cont(score, 0.75), 5) AS p75, round(quantile_cont(score, 0.9), 5) AS p90, round(quantile_cont(score, 0.95), 5) AS p95,
    round(quantile_cont(score, 0.99), 5) AS p99, round(avg(score), 5) AS mean, round(avg(CASE WHEN score >= 0.3 THEN 1 ELSE 0 END), 5) AS share, count(*) AS n FROM edges""")
def similarity_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = similarity.score_profile(_edges(spark, sf_dir), "score", 0.3)
    return row.select(*[F.round(c, 5).alias(c) for c in row.columns if c != "n"], "n")


@query(f"""WITH w AS (SELECT lang AS g, term FROM {_TOKENS}), c AS (SELECT g, term, count(*) AS c1 FROM w GROUP BY 1, 2),
    s AS (SELECT g, term, c1, sum(c1) OVER (PARTITION BY term) - c1 AS c2, sum(c1) OVER (PARTITION BY g) AS n1, sum(c1) OVER () - sum(c1) OVER (PARTITION BY g) AS n2 FROM c),
    z AS (SELECT g, term, c1, c2, round((ln((c1 + 0.5) / (n1 - c1 + 0.5)) - ln((c2 + 0.5) / (n2 - c2 + 0.5))) / sqrt(1 / (c1 + 0.5) + 1 / (c2 + 0.5)), 4) AS score FROM s WHERE c1 >= 25)
    SELECT g AS "group", term, score, c1 AS in_count, CAST(c2 AS BIGINT) AS rest_count FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, term DESC) AS r FROM z) WHERE r <= 50""")
def log_odds_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.surprising_terms(table(spark, sf_dir, "documents"), "lang", "text")


_TERMS = ["erea", "onea"]


@query(f"""WITH i AS (SELECT doc_id, term, count(*) AS tf FROM {_TOKENS} AND term IN ('erea', 'onea') GROUP BY 1, 2),
    d AS (SELECT term, count(*) AS df FROM i GROUP BY 1), n AS (SELECT count(*) AS total FROM documents)
    SELECT doc_id, round(sum(tf * ln(1 + total / df)), 6) AS score FROM i JOIN d USING (term), n GROUP BY 1 HAVING count(*) = 2""")
def inverted_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.search(search.inverted_index(docs, "doc_id", "text", only=_TERMS), _TERMS, "doc_id", docs.count())


@query(f"""WITH i AS (SELECT doc_id, term, count(*) AS tf FROM {_TOKENS} GROUP BY 1, 2), w(wanted) AS (VALUES ('erthion'), ('thean')),
    h AS (SELECT wanted, doc_id, sum(tf) AS tf FROM i JOIN w ON term = wanted OR levenshtein(term, wanted) <= 1 GROUP BY 1, 2),
    d AS (SELECT wanted, count(*) AS df FROM h GROUP BY 1), n AS (SELECT count(*) AS total FROM documents)
    SELECT doc_id, round(sum(tf * ln(1 + total / df)), 6) AS score FROM h JOIN d USING (wanted), n GROUP BY 1 HAVING count(*) = 2""")
def typo_tolerant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.search(search.inverted_index(docs, "doc_id", "text"), ["erthion", "thean"], "doc_id", docs.count(), typos=1)


@query(f"WITH h AS (SELECT DISTINCT doc_id FROM {_TOKENS} AND term = 'erea') SELECT source, count(DISTINCT doc_id) AS hits FROM h JOIN documents USING (doc_id) GROUP BY 1")
def word_period_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = search.inverted_index(docs, "doc_id", "text", only=["erea"])
    return search.distribution(hits, docs.select("doc_id", "source"), "doc_id", "source")


_VERDICT = "CASE o_orderstatus WHEN 'F' THEN 'correct' WHEN 'O' THEN 'incorrect' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Unsure ' ELSE '' END END"


@query(f"""SELECT o_orderpriority, count(*) FILTER (v = 'correct') AS correct, count(*) FILTER (v = 'incorrect') AS incorrect, count(*) FILTER (v = 'unsure') AS unsure, count(*) FILTER (v = '') AS blank,
    round(count(*) FILTER (v = 'correct') / nullif(count(*) FILTER (v IN ('correct', 'incorrect')), 0), 6) AS "precision" FROM (SELECT *, lower(trim({_VERDICT})) AS v FROM orders) GROUP BY 1""")
def precision_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "orders").withColumn("verdict", F.expr(_VERDICT))
    return quality.precision(judged, "verdict", "o_orderpriority").withColumn("precision", F.round("precision", 6))


@query("""WITH p AS (SELECT o_orderpriority AS d, CASE WHEN o_orderkey % 3 = 0 THEN 'c' ELSE 'i' END AS a, CASE WHEN o_orderkey % 4 = 0 THEN 'c' ELSE 'i' END AS b FROM orders),
    m AS (SELECT d, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po, avg(CASE WHEN a = 'c' THEN 1.0 ELSE 0 END) AS ac, avg(CASE WHEN b = 'c' THEN 1.0 ELSE 0 END) AS bc FROM p GROUP BY 1)
    SELECT d AS dimension, n, round(po, 6) AS agreed, round((po - (ac * bc + (1 - ac) * (1 - bc))) / (1 - (ac * bc + (1 - ac) * (1 - bc))), 6) AS kappa FROM m""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = lambda k: F.when(F.pmod("o_orderkey", F.lit(k)) == 0, "c").otherwise("i")
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dimension"), mark(3).alias("a"), mark(4).alias("b"))
    return quality.cohen_kappa(pairs, "a", "b", "dimension").select("dimension", "n", F.round("agreed", 6).alias("agreed"), F.round("kappa", 6).alias("kappa"))


@query("""SELECT c_mktsegment AS dimension, count(*) FILTER (c_custkey % 2 = 0) AS gold_present, count(*) FILTER (c_custkey % 6 = 0) AS both_present,
    round(count(*) FILTER (c_custkey % 6 = 0) / nullif(count(*) FILTER (c_custkey % 2 = 0), 0), 6) AS recall FROM customer GROUP BY 1""")
def recall_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda k: F.when(F.pmod("c_custkey", F.lit(k)) == 0, "x").otherwise(" ")
    pairs = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dimension"), some(2).alias("gold"), some(3).alias("found"))
    return quality.presence_recall(pairs, "gold", "found", "dimension").withColumn("recall", F.round("recall", 6))


@query("""WITH c AS (SELECT c_mktsegment AS s, count(*) AS n, sum(count(*)) OVER () AS t FROM customer GROUP BY 1), q AS (SELECT s, n, round_even(100.0 * n / t, 0) AS q FROM c),
    f AS (SELECT s, q + CASE WHEN row_number() OVER (ORDER BY n DESC, s) = 1 THEN 100 - sum(q) OVER () ELSE 0 END AS q FROM q) SELECT s AS segment, CAST(q AS BIGINT) AS sampled FROM f""")
def stratified_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.stratified_sample(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 100, 20)
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("sampled"))


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@query("""SELECT c_mktsegment AS segment, round(100.0 * count(*) FILTER (c_acctbal < 0) / count(*), 4) AS below, round(min(c_acctbal), 2) AS least, round(max(c_acctbal), 2) AS most FROM customer GROUP BY 1""")
def conditional_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = 100.0 * F.count_if(F.col("c_acctbal") < 0) / F.count("*")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(below, 4).alias("below"), F.round(F.min("c_acctbal"), 2).alias("least"), F.round(F.max("c_acctbal"), 2).alias("most"))


_EVENT = {"click": ("deported to the camp", "fear"), "purchase": ("moved to town", "joy; grief"), "error": ("arrested", "Unclear"), "signup": ("hidden in a house", "hope"), "view": ("walked on", "sadness")}


@query("""WITH t(event_type, activity, v, a) AS (VALUES ('click', 'deportation', -0.9, 0.8), ('purchase', 'migration', 0.9, 0.75), ('purchase', 'migration', -0.9, 0.7), ('error', 'arrest', 0.0, 0.5), ('signup', 'escape', 0.6, 0.6), ('signup', 'hiding', 0.6, 0.6))
    SELECT activity, count(*) AS events, round(avg(v), 6) AS avg_valence, round(avg(a), 6) AS avg_arousal FROM events JOIN t USING (event_type) GROUP BY 1""")
def valence_per_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events to labels, emotions and quads, and back by a join of two graphs: the flagship."""
    case = lambda k: "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{v[k]}'" for t, v in _EVENT.items()) + " END"
    rows = table(spark, sf_dir, "events").selectExpr("cast(event_id AS string) AS utterance_hash", "'' AS who", f"{case(0)} AS what", "'not stated' AS `where`", "'1942' AS `when`", f"{case(1)} AS emotion")
    found = valence_by_activity(build_quads(rows, only=["has_activity", "emotion", "valence", "arousal"]))
    return found.select("activity", "events", F.round("avg_valence", 6).alias("avg_valence"), F.round("avg_arousal", 6).alias("avg_arousal"))


_PLACE = "CASE c_custkey % 5 WHEN 0 THEN 'x-germany' WHEN 1 THEN 'new-zealand-town' WHEN 2 THEN 'y-poland-ussr' WHEN 3 THEN 'nowhere' ELSE 'z-ussr' END"
_TARGET = "CASE WHEN c_custkey % 7 = 0 THEN 'https://sws.geonames.org/' || c_nationkey || '/' WHEN c_custkey % 7 = 1 THEN 'https://example.org/1' ELSE 'https://www.wikidata.org/entity/Q' || c_nationkey END"


@query(f"""WITH l AS (SELECT c_custkey, c_custkey % 5 AS k, c_custkey % 7 AS a, c_nationkey % 4 AS f FROM customer)
    SELECT c_custkey, CASE k WHEN 0 THEN 'germany' WHEN 1 THEN 'new-zealand' WHEN 3 THEN NULL ELSE 'ussr' END AS token,
    CASE WHEN a = 1 THEN 'unsure' WHEN f = 3 THEN 'unsure' WHEN k = 3 THEN 'unsure' WHEN f = 2 THEN 'unsure' WHEN f = 0 AND k = 0 THEN 'correct' WHEN f = 1 AND k IN (2, 4) THEN 'correct' WHEN k IN (2, 4) THEN 'unsure' ELSE 'incorrect' END AS judgment FROM l""")
def judge_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.alignment import judge_links

    links = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PLACE} AS slug", f"{_TARGET} AS target")
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 3")
    held = F.expr("CASE n_nationkey % 4 WHEN 0 THEN array('Q183') WHEN 1 THEN array('Q212') ELSE cast(array() AS array<string>) END").alias("countries")
    facts = nations.select(F.concat(F.lit("Q"), F.col("n_nationkey")).alias("target_id"), held).unionByName(nations.select(F.col("n_nationkey").cast("string").alias("target_id"), held))
    countries = {"germany": "Q183", "new-zealand": "Q664", "poland": "Q36", "ussr": "Q15180"}
    return judge_links(links, facts, countries, {"ussr": ["Q159", "Q212"]}, ["ussr"]).select("c_custkey", "token", "judgment")
