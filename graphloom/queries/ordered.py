"""Ordered analytics, set operations and sources on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import coref, dump, entities, ordered, quality
from graphloom.operators.pipeline_tables import summary
from graphloom.queries.registry import query, table
from graphloom.sinks.writers import latest, not_done
from graphloom.sources.tables import responses, topics
from graphloom.streaming.stateful import paced, request_counts



def _turns() -> list:
    """Order of a conversation's rows; made when asked, as columns need a session."""
    return [F.asc_nulls_last("turn"), F.asc("role"), F.asc("text")]


_ORDER = "turn NULLS LAST, role, text"


@query(f"""SELECT conv_id, turn, md5(text) AS t, coalesce(last_value(nullif(role, 'assistant') IGNORE NULLS)
           OVER (PARTITION BY conv_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING), 'assistant') AS speaker FROM conversations""")
def ffill_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = ordered.fill_forward(table(spark, sf_dir, "conversations"), "role", ["conv_id"], _turns(), "assistant", "speaker")
    return filled.select("conv_id", "turn", F.md5("text").alias("t"), "speaker")


@query(f"""SELECT conv_id, turn, md5(text) AS t, coalesce(last_value(nullif(role, 'assistant') IGNORE NULLS)
           OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, {_ORDER} ROWS UNBOUNDED PRECEDING), 'assistant') AS speaker FROM conversations""")
def ffill_speakers_over_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys with a third of all rows each, filled in ranges of their rows."""
    rows = table(spark, sf_dir, "conversations").withColumn("tape", F.pmod("conv_id", F.lit(3)))
    filled = ordered.fill_forward(rows, "role", ["tape"], [F.asc("conv_id"), *_turns()], "assistant", "speaker", ranges=max(12, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return filled.select("conv_id", "turn", F.md5("text").alias("t"), "speaker")


_STICKY = "CASE WHEN role = 'user' THEN 'not stated' WHEN role = 'system' THEN '' ELSE role END"


@query(f"""WITH w AS (SELECT *, {_STICKY} AS v FROM conversations),
    f AS (SELECT conv_id, turn, md5(text) AS t, v, last_value(CASE WHEN v NOT IN ('', 'not stated') THEN v END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS l FROM w)
    SELECT conv_id, turn, t, v AS place_original, coalesce(l, 'not stated') AS place,
           CASE WHEN v NOT IN ('', 'not stated') THEN 'original' WHEN l IS NOT NULL THEN 'context_sticky' ELSE 'unresolved' END AS place_method FROM f""")
def sticky_fill_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("role") == "user", "not stated").when(F.col("role") == "system", "").otherwise(F.col("role"))
    rows = ordered.sticky_fill(table(spark, sf_dir, "conversations").withColumn("place", place), "place", ["conv_id"], _turns())
    return rows.select("conv_id", "turn", F.md5("text").alias("t"), "place_original", "place", "place_method")


@query()
def coref_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions made from roles; the state machine has no SQL form (brute-force tests in tests/)."""
    who = F.when(F.col("role") == "user", "my father").when(F.pmod("turn", F.lit(3)) == 1, "he").otherwise("they")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("t"), who.alias("who"), F.concat(F.lit("S"), F.col("conv_id")).alias("survivor"), F.lit("M").alias("gender"))
    return coref.resolve_mentions(rows, "conv_id", ["turn", "t"], "who", "survivor", "gender")


@query("SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.top_k(table(spark, sf_dir, "orders"), 3, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "rank")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS rolling FROM events")
def rolling_mean_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.rolling_mean(table(spark, sf_dir, "events"), "value", ["user_id"], [F.asc("ts"), F.asc("event_id")])
    return rows.select("event_id", F.round("rolling", 6).alias("rolling"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey AS first_order, o_orderpriority AS label FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def first_seen_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.first_seen(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return rows.select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("o_orderpriority").alias("label"))


@query("SELECT conv_id || '_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1) AS utterance_id, role FROM conversations")
def segment_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.ordinal(table(spark, sf_dir, "conversations"), ["conv_id"], _turns())
    return rows.select(F.concat_ws("_", "conv_id", "ordinal").alias("utterance_id"), "role")


@query("""SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY p_partkey) = 1 THEN s ELSE s || '-' || p_partkey END AS unique_slug
          FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS s FROM part)""")
def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))
    return ordered.distinct_slugs(rows, "slug", "p_partkey").select("p_partkey", "unique_slug")


@query("""WITH n AS (SELECT p_partkey, p_name, lower(p_name) AS key FROM part), f AS (SELECT key, min(p_partkey) AS k FROM n GROUP BY 1)
          SELECT n.p_partkey, 'urn:graph:person:' || replace(lower(x.p_name), ' ', '-') AS iri, x.p_name AS label FROM n JOIN f USING (key) JOIN part x ON x.p_partkey = f.k""")
def resolve_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities.resolve_people(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"])
    return found.select("p_partkey", "iri", "label")


@query("""SELECT p_partkey, CASE WHEN p_name LIKE 'red %' THEN 'urn:term:' || split_part(p_name, ' ', 2) ELSE 'urn:graph:place:' || replace(p_name, ' ', '-') END AS iri,
                 CASE WHEN p_name LIKE 'red %' THEN 'skos_exact' ELSE 'local_mint' END AS method,
                 CASE WHEN p_name LIKE 'red %' THEN 'https://www.wikidata.org/entity/' || split_part(p_name, ' ', 2) END AS link FROM part""")
def resolve_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    tail = F.substring_index("p_name", " ", -1)
    reds = parts.where(F.col("p_name").startswith("red ")).select(text.canon_key(F.col("p_name")).alias("key"), tail.alias("term_id"), F.concat(F.lit("urn:term:"), tail).alias("iri"), F.col("p_name").alias("label")).distinct()
    links = reds.select("term_id", F.array(F.concat(F.lit("https://www.wikidata.org/entity/"), F.col("term_id"))).alias("exact_matches"), F.array().cast("array<string>").alias("close_matches"), F.lit(0.9).alias("confidence"))
    found = entities.resolve_places(parts, "p_name", reds, links)
    return found.select("p_partkey", "iri", "method", F.element_at("wikidata", 1).alias("link"))


@query("""SELECT p_partkey, CASE WHEN length(p_type) % 2 = 1 THEN 't-' || lower(p_type) END AS term_id, CASE WHEN length(p_type) % 2 = 1 THEN 'urn:term:' || lower(p_type) ELSE 'urn:graph:concept:' || lower(p_type) END AS iri FROM part""")
def link_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lower("p_type")
    terms = table(spark, sf_dir, "part").where("length(p_type) % 2 = 1").select(key.alias("key"), F.concat(F.lit("t-"), key).alias("term_id"), F.concat(F.lit("urn:term:"), key).alias("iri")).distinct()
    return entities.link_concepts(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", terms).select("p_partkey", "term_id", "iri")


@query("""SELECT r_regionkey AS segment_number, concept, CAST(length(r_name) + d AS DOUBLE) AS weight FROM region, (VALUES ('alpha', 0), ('beta', 1)) AS c(concept, d)""")
def unpivot_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("r_name")
    wide = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("segment_number"), n.cast("string").alias("alpha (N12)"), (n + 1).cast("string").alias("beta (N7)"), F.lit("none").alias("gamma"))
    return topics(wide, "segment_number", "test").select("segment_number", "concept", "weight")


@query("""WITH s AS (SELECT o_custkey AS i, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS at, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    k AS (SELECT DISTINCT i, n, unnest([1, 2, 3, 4]) AS k FROM s)
    SELECT k.i AS customer, k.k AS part, s.o_orderkey AS order_key FROM k JOIN s ON s.i = k.i AND s.at = floor((k.k - 1) * (k.n / 4.0)) WHERE floor((k.k - 1) * (k.n / 4.0)) < least(floor(k.k * (k.n / 4.0)), k.n)""")
def bucket_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = ordered.ordinal(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_key")), ["customer"], [F.asc("order_key")])
    parts = segments.select("customer").distinct().select("customer", F.explode(F.array(*[F.lit(k) for k in range(1, 5)])).alias("part"))
    return entities.place_topics(parts, segments, "customer", "part", "ordinal").select("customer", "part", "order_key")


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def integrity_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orphans(table(spark, sf_dir, "customer"), table(spark, sf_dir, "events"), "c_custkey", "user_id")


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT user_id FROM events")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def anti_join_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return not_done(rows, rows.where("event_type = 'error' AND value > 100"), "user_id").select("event_id")


@query("SELECT o_custkey, o_orderkey AS newest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("newest"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'a, b' ELSE event_type END AS who, 'not stated' AS what, CASE WHEN event_id % 4 = 2 THEN 'Unclear' ELSE 'fear' END AS emotion
          FROM events WHERE event_id % 4 <> 3""")
def json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, objects with `events`, list values, missing fields, malformed text and items that are no objects."""
    kind = F.col("event_type")
    one = F.concat(F.lit('{"who": "'), kind, F.lit('", "emotion": "fear"}'))
    raw = (
        F.when(F.pmod("event_id", F.lit(4)) == 0, F.concat(F.lit("["), one, F.lit(", 7]")))
        .when(F.pmod("event_id", F.lit(4)) == 1, F.lit('{"events": [{"who": ["a", "b"], "what": null, "emotion": "fear"}]}'))
        .when(F.pmod("event_id", F.lit(4)) == 2, F.concat(F.lit('[{"who": "'), kind, F.lit('"}]')))
        .otherwise("{broken")
    )
    return responses(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", ["event_id"]).select("event_id", "who", "what", "emotion")


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
          AND abs(date_diff('microsecond', a.ts, b.ts)) <= 30000000""")
def proximity_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range predicate by equi-join on time buckets and their neighbours."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at")).withColumn("bucket", F.floor(F.col("at") / 30_000_000))
    near = rows.select(F.col("event_id").alias("b"), "user_id", F.col("at").alias("bt"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    pairs = rows.join(near, ["user_id", "bucket"]).where((F.col("event_id") < F.col("b")) & (F.abs(F.col("at") - F.col("bt")) <= 30_000_000))
    return pairs.select(F.col("event_id").alias("a"), "b")


@query("""SELECT CAST(epoch(time_bucket(INTERVAL '60 seconds', ts)) AS BIGINT) AS start, user_id, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY 1, 2""")
def tumbling_60s_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return request_counts(rows, "at", "user_id", 60, 1).select(F.unix_seconds("start").alias("start"), "user_id", "n", "limited")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING) AS recent FROM events),
    b AS (SELECT *, avg(CASE WHEN k <= 3 THEN value END) OVER (PARTITION BY user_id) AS base FROM n)
    SELECT event_id, round(recent, 6) AS recent, k > 3 AND round(recent, 6) >= round(1.5 * base, 6) AS slow FROM b""")
def response_time_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paced(table(spark, sf_dir, "events"), "event_id", "value", "user_id")
    return rows.select("event_id", F.round("recent", 6).alias("recent"), "slow")


@query("""SELECT conv_id AS interview_id, max(turn) AS max_part_number, sum(length(text)) AS total_chars, string_agg(DISTINCT role, ', ' ORDER BY role) AS all_speakers,
          count(DISTINCT turn) AS parts_count FROM conversations GROUP BY 1""")
def interview_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("interview_id"), F.col("turn").alias("part_number"), F.col("role").alias("speakers"), text.word_count(F.col("text")).alias("word_count"),
        F.length("text").alias("char_count"), F.lit(1.0).alias("duration_minutes"),
    )
    return summary(rows).select("interview_id", "max_part_number", "total_chars", "all_speakers", "parts_count")


@query("""SELECT conv_id AS interview_id, sum(len(regexp_extract_all(text, '[^\\s\\x{0085}\\p{Z}]+'))) AS total_words, round(sum((turn + 1) * 0.025), 6) AS minutes FROM conversations GROUP BY 1""")
def interview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("interview_id"), F.col("turn").alias("part_number"), F.col("role").alias("speakers"), text.word_count(F.col("text")).alias("word_count"),
        F.length("text").alias("char_count"), ((F.col("turn") + 1) * 1500 / 60000).alias("duration_minutes"),
    )
    return summary(rows).select("interview_id", "total_words", F.round("total_duration_minutes", 6).alias("minutes"))


_LINES = """SELECT '<urn:customer:' || c_custkey || '> <urn:p:' || CASE WHEN c_nationkey % 3 = 0 THEN 'concept' ELSE 'name' END || '> "' || c_name || '" <urn:g:' || CASE WHEN c_nationkey % 5 = 0 THEN 'concepts' ELSE 'people' END || '> .' AS line FROM customer"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("c_nationkey") % 3 == 0, "concept").otherwise("name")
    g = F.when(F.col("c_nationkey") % 5 == 0, "concepts").otherwise("people")
    line = F.concat(F.lit("<urn:customer:"), F.col("c_custkey"), F.lit("> <urn:p:"), p, F.lit('> "'), F.col("c_name"), F.lit('" <urn:g:'), g, F.lit("> ."))
    return table(spark, sf_dir, "customer").select(line.alias("line"))


@query(f"WITH l AS ({_LINES}) SELECT replace(line, '<urn:customer:1>', '<urn:person:one>') AS line FROM l WHERE NOT contains(line, '<urn:g:concepts>')")
def drop_and_rewrite_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("<urn:customer:1>", "<urn:person:one>")], "old string, new string")
    return dump.rewrite_iris(dump.drop_lines(_lines(spark, sf_dir), "<urn:g:concepts>"), mapping, r"<urn:customer:\d+>")


@query(f"WITH l AS ({_LINES}) SELECT regexp_extract(line, '(<[^<>]*>) \\.$', 1) AS g, count(*) AS n FROM l GROUP BY 1")
def graph_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy(dump.graph_of(F.col("line")).alias("g")).agg(F.count("*").alias("n"))


@query(rf"""WITH l AS ({_LINES}) SELECT regexp_replace(line, '^<urn:customer:(\d+)> <urn:p:name> "[^"]*"', '<urn:customer:\1> <urn:p:name> "Interview \1"') AS line FROM l""")
def pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.pseudonymise(_lines(spark, sf_dir), "urn:p:name", "urn:customer:")


@query("""SELECT 'urn:part:' || s AS s, upper(left(a, 1)) || substr(a, 2) || ' ' || upper(left(b, 1)) || substr(b, 2) AS label
          FROM (SELECT DISTINCT replace(p_name, ' ', '-') AS s, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part WHERE p_name NOT LIKE 'red %')""")
def complete_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("urn:part:"), text.slug(F.col("p_name"))).alias("s"), "p_name").distinct()
    term = F.struct(F.lit("literal").alias("kind"), F.col("p_name").alias("value"), F.lit(None).cast("string").alias("datatype"), F.lit("en").alias("lang"))
    q = parts.select("s", F.when(F.col("p_name").startswith("red "), "rdfs:label").otherwise("note").alias("p"), term.alias("o"), F.lit("g").alias("g"))
    return dump.complete_labels(q, "Part", "rdfs:label", "urn:part:", "g").where("p = 'rdfs:label'").select("s", F.col("o.value").alias("label"))
