"""Block and allow rules for URLs, by DataFrame functions alone.

Each URL is expanded into host-suffix x path-prefix expressions, but only into suffixes
with as many labels and prefixes with as many characters as some rule has.  Expressions
and rules meet in an equi-join on the first four bytes of their SHA-256 digests; a match
counts once the full digests are equal.  The longest rule wins; of rules as long, the
one with the longer host, and of the same rule given twice, block.

The rules are broadcast only if they are counted and few (`broadcast_rules`); beyond
that the join shuffles distinct expressions, so a host with a third of all pages sends
each of its expressions once a task rather than once a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.frames import free_name

RULES = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())]
)


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; null or no `://`: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) given as a list; host without, path with its leading `/`."""
    return spark.createDataFrame(rules, RULES)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = 200_000) -> DataFrame:
    """pages with host, path, rule (host + path of the rule that decides, or null), verdict.

    A rule fits its host and all subdomains, for paths that start with the rule's.  Null
    urls and urls without `://` have an empty host and path and get the default; repeated
    rows are each judged; an empty table stays empty; rules with a null in any column or an
    empty host raise nothing and fit nothing; urls and rules of any length are read whole.
    Columns of `pages` named like a result (host, path, rule, verdict) are replaced, all
    others stay.
    """
    text = F.concat("host", "path")
    known = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull() & (F.length("host") > 0))
        .groupBy("host", "path")
        .agg(F.when(F.max(F.col("verdict") == "block"), "block").otherwise(F.max("verdict")).alias("verdict"))
        .select("verdict", "host", "path", F.sha2(text, 256).alias("digest"), F.length("host").alias("n_host"))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    shape = known.agg(
        F.collect_set(F.size(F.split("host", r"\.", -1))), F.collect_set(F.length("path")), F.count("*")
    ).first()  # sets of integers, at most as many as the longest rule has characters, and a count
    labels, lengths, n_rules = sorted(shape[0] or []), sorted(shape[1] or []), shape[2]
    base = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if not n_rules:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    parts = F.split("host", r"\.", -1)
    fixed = lambda numbers: F.transform(F.split(F.lit(",".join(map(str, numbers))), ","), lambda n: n.cast("int"))  # noqa: E731  folded to a literal
    hosts = F.transform(F.filter(fixed(labels), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    paths = F.transform(F.filter(fixed(lengths), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))

    # Each place (host, path) is judged once; the partial aggregate thins a hot one before the shuffle.
    at_host, at_path, won = (free_name(base.columns, c) for c in ("at_host", "at_path", "won"))
    place = base.groupBy(F.col("host").alias("at_host"), F.col("path").alias("at_path")).agg(F.lit(1).alias("_one")).drop("_one")
    here = {"host": F.col("at_host"), "path": F.col("at_path")}
    split_at = (
        place.withColumns(here)
        .select("at_host", "at_path", "path", F.explode(hosts).alias("x"))
        .select("at_host", "at_path", F.col("x").alias("x_host"), F.explode(paths).alias("y"))
        .select("at_host", "at_path", "x_host", F.sha2(F.concat("x_host", "y"), 256).alias("x_digest"))
        .withColumn("x_short", F.substring("x_digest", 1, 8))
    )
    small = F.broadcast(known) if n_rules <= broadcast_rules else known
    confirmed = (F.col("x_short") == F.col("short")) & (F.col("x_digest") == F.col("digest")) & (F.col("x_host") == F.col("host"))
    rule = F.concat("host", "path")
    best = F.max_by(F.struct(rule.alias("rule"), "verdict"), F.struct(F.length(rule).alias("chars"), F.col("n_host"))).alias(won)
    found = split_at.join(small, confirmed).groupBy(F.col("at_host").alias(at_host), F.col("at_path").alias(at_path)).agg(best)
    judged = base.drop("rule", "verdict").join(found, (F.col("host") == F.col(at_host)) & (F.col("path") == F.col(at_path)), "left")
    return judged.withColumns({"rule": F.col(f"{won}.rule"), "verdict": F.coalesce(f"{won}.verdict", F.lit(default))}).drop(won, at_host, at_path)
