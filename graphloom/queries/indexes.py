"""Written indexes, opened again: vectors in cells, texts with positions, dictionary and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import ordered, text_index
from graphloom.operators.cell_index import open_cell_index, write_cell_index
from graphloom.queries.registry import query, table
from graphloom.session import scratch

_NEAREST = """WITH p AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_sum(list_transform(list_zip(r.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score
    FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
    SELECT query_id, vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


def _cells(spark: SparkSession, sf_dir: str):
    """Written, then opened by its path alone."""
    path = scratch(spark)
    write_cell_index(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", path)
    return open_cell_index(spark, path)


@query(_NEAREST)
def cell_index_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written cell index, searched in all cells: exact, for all ids divisible by 20."""
    index = _cells(spark, sf_dir)
    return index.search_all(10, probes=len(index.centroids))


@query()
def cell_index_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the cells that the index says are enough; recall is measured in the tests."""
    return _cells(spark, sf_dir).search_all(10)


_WORDS = """(SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), '''', ''), '[a-z][a-z-]+[a-z]') AS l FROM documents))"""


@query(f"""WITH t AS {_WORDS}, p AS (SELECT a.doc_id, count(*) AS times FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.pos + 1 = b.pos WHERE a.term = 'the' AND b.term = 'and' GROUP BY 1),
    m AS (SELECT doc_id, pos, term, lag(pos) OVER w AS b_pos, lag(term) OVER w AS b_term, 0 AS pair FROM t WHERE term IN ('the', 'and') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
          UNION ALL SELECT doc_id, pos, term, lag(pos) OVER w, lag(term) OVER w, 1 FROM t WHERE term IN ('and', 'that') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    s AS (SELECT doc_id, pair, least(8, min(CASE WHEN term <> b_term THEN pos - b_pos + CASE WHEN term = CASE pair WHEN 0 THEN 'the' ELSE 'and' END THEN 1 ELSE 0 END END)) AS far, count(DISTINCT term) AS sides FROM m GROUP BY 1, 2),
    d AS (SELECT doc_id, CAST(sum(far) AS BIGINT) AS distance FROM s WHERE sides = 2 GROUP BY 1 HAVING count(*) = 2)
    SELECT doc_id, times, distance, rank() OVER (ORDER BY distance NULLS LAST, times DESC NULLS LAST) AS place FROM p FULL JOIN d USING (doc_id)""")
def positional_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the phrase `the and`, and all with `the`, `and`, `that`, the nearest together first."""
    path = scratch(spark)
    text_index.upsert(spark, path, table(spark, sf_dir, "documents"), "doc_id", "text")
    index = text_index.open_index(spark, path)
    found = index.phrase(["the", "and"]).join(index.proximity(["the", "and", "that"]), "key", "full")
    # a place is one more than how many texts have a better (distance, times) pair; pairs are few
    pair = [F.coalesce("distance", F.lit(1 << 40)).alias("d"), (-F.coalesce("times", F.lit(-1))).alias("t")]
    held = scratch(spark)  # places are counted from what was found, without another search
    found.select("key", "times", "distance", F.struct(*pair).alias("pair")).write.parquet(held)
    each = spark.read.parquet(held)
    many = each.groupBy("pair").agg(F.count("*").alias("n"))
    places = ordered.running_total(many, "pair", "n", "before")
    return each.join(places, "pair").select(F.col("key").alias("doc_id"), "times", "distance", (F.col("before") + 1).alias("place"))


_TYPOS = f"""WITH i AS (SELECT doc_id, term, count(*) AS tf FROM {_WORDS} GROUP BY 1, 2), w(wanted) AS (VALUES ('erthion'), ('thean')),
    h AS (SELECT wanted, doc_id, sum(tf) AS tf FROM i JOIN w ON term = wanted OR levenshtein(term, wanted) <= 1 GROUP BY 1, 2),
    d AS (SELECT wanted, count(*) AS df FROM h GROUP BY 1), n AS (SELECT count(*) AS total FROM documents),
    a AS (SELECT 'typos' AS kind, doc_id, round(sum(tf * ln(1 + total / df)), 6) AS score FROM h JOIN d USING (wanted), n GROUP BY 2 HAVING count(*) = 2),
    hp AS (SELECT CASE WHEN term = 'that' THEN 'that' ELSE 'anth' END AS wanted, doc_id, sum(tf) AS tf FROM i WHERE term = 'that' OR starts_with(term, 'anth') GROUP BY 1, 2),
    dp AS (SELECT wanted, count(*) AS df FROM hp GROUP BY 1)
    SELECT * FROM a UNION ALL SELECT 'prefix', doc_id, round(sum(tf * ln(1 + total / df)), 6) FROM hp JOIN dp USING (wanted), n GROUP BY 2 HAVING count(*) = 2"""


@query(_TYPOS)
def dictionary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with one typo by the written dictionary, and a last word of which only the beginning is there."""
    path, docs = scratch(spark), table(spark, sf_dir, "documents")
    index = text_index.upsert(spark, path, docs, "doc_id", "text")
    total = docs.count()
    typos = index.ranked(index.near_words(["erthion", "thean"]), 2, total)
    prefix = index.ranked(index.words(["that"]).union(index.with_prefix("anth")), 2, total)
    out = [F.col("key").alias("doc_id"), "score"]
    return typos.select(F.lit("typos").alias("kind"), *out).union(prefix.select(F.lit("prefix").alias("kind"), *out))


@query(f"""WITH i AS (SELECT doc_id, term, count(*) AS tf FROM {_WORDS} WHERE term IN ('erea', 'onea') GROUP BY 1, 2),
    d AS (SELECT term, count(*) AS df FROM i GROUP BY 1), n AS (SELECT count(*) AS total FROM documents),
    r AS (SELECT doc_id, round(sum(tf * ln(1 + total / df)), 6) AS score FROM i JOIN d USING (term), n GROUP BY 1 HAVING count(*) = 2)
    SELECT 'segments' AS state, * FROM r UNION ALL SELECT 'merged', * FROM r""")
def incremental_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches written one after the other, one of them twice, with texts that later batches replace or take back; then merged."""
    path, docs = scratch(spark), table(spark, sf_dir, "documents").select("doc_id", "text")
    total, third = docs.count(), F.pmod("doc_id", F.lit(3))
    stale = docs.where(third == 1).withColumn("text", F.lit("erea onea erea"))
    extra = docs.where(third == 0).select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("onea erea").alias("text"))
    text_index.upsert(spark, path, docs.where(third == 2).union(stale).union(extra), "doc_id", "text", "first")
    for _ in range(2):
        text_index.upsert(spark, path, docs.where(third != 2), "doc_id", "text", "second", delete=extra)
    index = text_index.open_index(spark, path)
    segments = index.ranked(index.words(["erea", "onea"]), 2, total)
    index = text_index.merge(spark, path)
    merged = index.ranked(index.words(["erea", "onea"]), 2, total)
    out = [F.col("key").alias("doc_id"), "score"]
    return segments.select(F.lit("segments").alias("state"), *out).union(merged.select(F.lit("merged").alias("state"), *out))


#: Every third part is called as the suffixed slug of another: `a-2` before number 2 of `a` comes, or after it.
_CLASH = "CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a-' || (p_partkey + 2) ELSE 'a-' || (p_partkey - 2) END"


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS n, row_number() OVER (ORDER BY p_partkey) AS k, {_CLASH} AS s FROM part),
    t AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS n, NULL::VARCHAR AS slug, []::VARCHAR[] AS taken
          UNION ALL SELECT k, n, slug, list_append(taken, slug) FROM (SELECT p.k, p.n, t.taken, CASE WHEN NOT list_contains(t.taken, s) THEN s
              WHEN NOT list_contains(t.taken, s || '-' || p.n) THEN s || '-' || p.n ELSE s || '-' || p.n || '-' || p.n END AS slug FROM t JOIN p ON p.k = t.k + 1))
    SELECT n AS p_partkey, slug AS unique_slug FROM t WHERE k > 0""")
def slugs_that_collide_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs that equal other slugs with a number behind them; as the rule by ascending number gives them."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CLASH).alias("slug"))
    return ordered.distinct_slugs(rows, "slug", "p_partkey").select("p_partkey", "unique_slug")
