"""Text, lexicon and time functions on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import lexicon, temporal, text
from graphloom.plans.algebra import as_quads
from graphloom.queries.registry import query, table
from graphloom.sinks.writers import quad_lines
from graphloom.sources.graphs import parse_quads


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, left(md5(p_name), 12) AS id, left(sha1(p_name), 24) AS doc FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" ("), F.col("p_brand"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(name).alias("slug"), text.stable_id(F.col("p_name")).alias("id"), F.left(F.sha1("p_name"), F.lit(24)).alias("doc"))


@query("SELECT p_partkey, lower(p_name) AS key FROM part")
def canon_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.upper("p_name"), F.lit("  (near "), F.col("p_brand"), F.lit(");,."))
    return table(spark, sf_dir, "part").select("p_partkey", text.canon_key(said).alias("key"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '|' || p_brand WHEN p_partkey % 3 = 1 THEN 'Smith, John|' || p_name ELSE p_name || '|' || p_type END AS people FROM part""")
def split_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("p_partkey", F.lit(3))
    field = (
        F.when(k == 0, F.concat(F.lit("I; "), F.col("p_name"), F.lit(", "), F.col("p_brand")))
        .when(k == 1, F.concat(F.lit("Smith, John; not stated| "), F.col("p_name")))
        .otherwise(F.concat(F.col("p_name"), F.lit(" |Narrator|  "), F.col("p_type")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_people(field), "|").alias("people"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '|' || p_type ELSE '' END AS places FROM part")
def split_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.concat("p_name", F.lit(" ; not stated | "), F.col("p_type"))).otherwise("Not stated")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_locations(field), "|").alias("places"))


_COLOURS = {"warm": [r"\bred\b", r"\bhot\b"], "cool": [r"\bblue\b"], "size": [r"\bsmall\b", r"\blarge\b"], "round": [r"\bring\b", r"\bgear\b"]}


@query("""SELECT p_partkey, concat_ws('|', CASE WHEN regexp_matches(p_name, '\\b(red|hot)\\b') THEN 'warm' END, CASE WHEN regexp_matches(p_name, '\\bblue\\b') THEN 'cool' END,
          CASE WHEN regexp_matches(p_name, '\\b(small|large)\\b') THEN 'size' END, CASE WHEN regexp_matches(p_name, '\\b(ring|gear)\\b') THEN 'round' END) AS labels FROM part""")
def lexicon_multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(lexicon.classify(F.col("p_name"), _COLOURS), "|").alias("labels"))


_WHAT = "CASE p_partkey % 6 WHEN 0 THEN 'deported to the camp by train' WHEN 1 THEN 'hiding in the forest' WHEN 2 THEN 'moved to ' || p_name WHEN 3 THEN 'born in the war, death' WHEN 4 THEN 'testified about ' || p_name ELSE p_name END"


@query("""SELECT p_partkey, activities, modes, historical FROM part
    JOIN (VALUES (0, 'deportation', 'train', 'Shoah_Deportations'), (1, 'escape', '', ''), (2, 'migration', '', ''), (3, 'family_life|selection', '', ''), (4, 'testimony', '', ''), (5, '', '', '')) AS v(k, activities, modes, historical)
      ON p_partkey % 6 = k""")
def classify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    what = F.expr(_WHAT)
    join = lambda words: F.array_join(lexicon.classify(what, words), "|")
    return table(spark, sf_dir, "part").select("p_partkey", join(lexicon.ACTIVITIES).alias("activities"), join(lexicon.MODES).alias("modes"), join(lexicon.HISTORICAL).alias("historical"))


@query("""SELECT p_partkey, v AS valence, a AS arousal, c AS category FROM part JOIN (VALUES (0, -0.9, 0.8, 'negative_high_arousal'), (1, 0.6, 0.6, 'positive'), (2, 0.0, 0.5, 'neutral'), (3, -0.8, 0.5, 'negative_low_arousal')) AS t(k, v, a, c)
          ON p_partkey % 4 = k""")
def vad_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Fear' WHEN 1 THEN 'hopelessness' WHEN 2 THEN 'Unclear' ELSE 'deep  sadness' END")
    rows = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    score = lexicon.lexicon_score(F.col("label"), lexicon.VAD, lexicon.VAD_DEFAULT)
    return rows.withColumn("s", score).select("p_partkey", F.col("s.v0").alias("valence"), F.col("s.v1").alias("arousal"), lexicon.emotion_category(F.col("label")).alias("category"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'crying|long_pause' WHEN 1 THEN '' ELSE 'laughing' END AS markers FROM documents")
def marker_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("CASE doc_id % 3 WHEN 0 THEN 'x [LONG  PAUSE] y [CRYING] z [CRYING]' WHEN 1 THEN 'x [LAUGHTER] [crying]' ELSE '[LAUGH] and [LAUGHING]' END")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lexicon.markers(said), "|").alias("markers"))


@query("""WITH y AS (SELECT o_orderkey, o_orderkey % 6 AS k, year(o_orderdate) AS y FROM orders)
    SELECT o_orderkey, CASE WHEN k < 5 THEN y - CASE WHEN k = 2 THEN 3 ELSE 0 END WHEN k = 5 THEN NULL END AS start_year,
           CASE WHEN k < 5 THEN y + CASE WHEN k = 3 THEN 2 ELSE 0 END ELSE 1939 END AS end_year,
           CASE k WHEN 0 THEN 'month' WHEN 1 THEN 'month' WHEN 2 THEN 'year_range' WHEN 3 THEN 'year_range' WHEN 4 THEN 'year' ELSE 'relative' END AS "precision",
           CASE WHEN k = 5 THEN 'pre_war' END AS period FROM y""")
def temporal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, k = F.year("o_orderdate"), F.pmod("o_orderkey", F.lit(6))
    said = (
        F.when(k == 0, F.concat(F.lit("on March 15, "), y)).when(k == 1, F.concat(F.lit("may "), y)).when(k == 2, F.concat(y - 3, F.lit(" to "), y))
        .when(k == 3, F.concat(F.lit("in "), y, F.lit(" and again in "), y + 2)).when(k == 4, F.concat(F.lit("around "), y)).otherwise("long before the war")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", temporal.parse_when(said).alias("t"))
    return rows.select("o_orderkey", F.col("t.start_year").cast("long").alias("start_year"), F.col("t.end_year").cast("long").alias("end_year"), "t.precision", "t.period")


@query("""WITH m AS (SELECT o_orderkey, 1930 + (o_orderkey % 50) / 2.0 AS mid FROM orders)
    SELECT o_orderkey, CASE WHEN mid < 1933 THEN 'pre_nazi' WHEN mid < 1939 THEN 'nazi_rise' WHEN mid < 1942 THEN 'early_war' WHEN mid <= 1945 THEN 'late_war_holocaust'
           WHEN mid <= 1950 THEN 'immediate_postwar' ELSE 'later_life' END AS bucket FROM m""")
def temporal_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit(1930)
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.bucket(start, start + F.pmod("o_orderkey", F.lit(50))).alias("bucket"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOKENS = f"""(SELECT doc_id, lang, replace(t, '''', '') AS raw, trim(replace(t, '''', ''), '-') AS term
    FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]{{2,}}')) AS t FROM documents))
    WHERE length(term) >= 3 AND term NOT IN ({_STOP})"""


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {_TOKENS} GROUP BY 1")
def tokenise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("""SELECT p_partkey, upper(left(a, 1)) || substr(a, 2) || ' ' || upper(left(b, 1)) || substr(b, 2) AS label, printf('%02d:%02d', p_partkey * 1234 // 60000, (p_partkey * 1234 % 60000) // 1000) AS clock, p_size AS size
          FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def labels_clocks_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = text.to_int(F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    return table(spark, sf_dir, "part").select("p_partkey", text.humanise(text.slug(F.col("p_name"))).alias("label"), text.clock(F.col("p_partkey") * 1234).alias("clock"), size.alias("size"))


@query("SELECT p_partkey, replace(p_name, 'ring', '<mark>ring</mark>') AS marked, p_name || ' | ' || p_brand AS both FROM part")
def highlight_and_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.highlight(F.col("p_name"), "RING").alias("marked"), text.combined(F.col("p_name"), F.lit(" "), F.lit(None).cast("string"), F.concat(F.col("p_brand"), F.lit(" "))).alias("both")
    )


@query("SELECT conv_id, turn, md5(text) AS t, role AS label FROM conversations")
def speaker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit(" "), F.col("role"), F.lit(" : hello"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("t"), text.speaker_label(said).alias("label"))


@query("SELECT 'urn:doc:' || doc_id AS s, md5(text) AS o, lang FROM documents")
def nquads_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as escaped literals with language tags and parsed again."""
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    o = F.struct(F.lit("literal").alias("kind"), F.col("text").alias("value"), none.alias("datatype"), F.col("lang").alias("lang"))
    made = docs.select(F.concat(F.lit("urn:doc:"), F.col("doc_id")).alias("s"), F.lit("urn:p:text").alias("p"), o.alias("o"), F.lit("urn:g:texts").alias("g"))
    return parse_quads(quad_lines(made)).where("ok").select("s", F.md5("o.value").alias("o"), "o.lang")


@query("SELECT g, count(*) AS n FROM (SELECT 'people' AS g FROM customer UNION ALL SELECT 'people' FROM customer UNION ALL SELECT 'people' FROM customer) GROUP BY 1")
def typed_table_to_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    columns = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "balance": F.col("c_acctbal"), "none": F.lit(None).cast("string")}
    return as_quads(rows, F.concat(F.lit("urn:customer:"), F.col("c_custkey")), "people", columns).groupBy("g").agg(F.count("*").alias("n"))
