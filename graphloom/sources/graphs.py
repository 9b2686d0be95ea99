"""Line-based graph files: quads and Turtle vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import canon_key, nt_unescape
from graphloom.operators.carry import carried_forward

#: Possessive loops keep long literals off the matcher's stack.
#: Subject, predicate, object (IRI, literal with type or tag, blank node), graph.
QUAD = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<([^>]*)>|@([A-Za-z-]+))?|(_:\S+))\s+<([^>]*)>\s*\.\s*$'


def parse_quads(lines: DataFrame, line: str = "value") -> DataFrame:
    """s, p, o, g, ok: parsed lines; blank lines and comments are skipped, others that don't parse have ok = false."""
    rows = lines.where((F.trim(line) != "") & ~F.ltrim(F.col(line)).startswith("#"))
    # the pattern runs once a line; a line has no line feed, so one can part the groups
    rows = rows.withColumn("_parts", F.split(F.regexp_replace(line, QUAD, "\n".join(f"${k}" for k in range(1, 9))), "\n", -1))
    ok = F.size("_parts") == 8
    part = lambda k: F.when(ok, F.get("_parts", F.lit(k - 1))).otherwise("")
    none = lambda c: F.nullif(c, F.lit(""))
    kind = F.when(part(3) != "", "iri").when(part(7) != "", "blank").otherwise("literal")
    o = F.struct(
        kind.alias("kind"), F.when(part(3) != "", part(3)).when(part(7) != "", part(7)).otherwise(nt_unescape(part(4))).alias("value"), none(part(5)).alias("datatype"), none(part(6)).alias("lang")
    )
    return rows.select(F.btrim(part(1), F.lit("<>")).alias("s"), part(2).alias("p"), o.alias("o"), part(8).alias("g"), ok.alias("ok"))


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    return parse_quads(spark.read.text(path))


def _statements(lines: DataFrame, number: str, line: str) -> DataFrame:
    """Lines with the subject that is in force, by number within a file; a large file is spread over ranges of its lines."""
    start = F.regexp_extract(line, r"^(\S+)\s+a?\s", 1)
    subject = F.when(F.col(line).rlike(r"^\S"), F.nullif(start, F.lit("")))
    return carried_forward(lines, subject, ["file"], [F.asc(number)], "subject")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, number, line of each line of each text file.

    Files are read in splits; a line's number is (first byte of its split, place in it), which
    sorts the lines of a file but isn't gapless.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("number"), F.col("value").alias("line"))


def thesaurus(lines: DataFrame) -> DataFrame:
    """term_id, iri, label, broader, key from lines of a SKOS vocabulary; the first label of a term counts."""
    told = _statements(lines, "number", "line")
    label = F.nullif(F.regexp_extract("line", r'prefLabel\s+"([^"\\]*+(?:\\.[^"\\]*+)*+)"@en', 1), F.lit(""))
    broader = F.nullif(F.regexp_extract("line", r"skos:broader\s+(\S+)", 1), F.lit(""))
    place = F.struct("file", "number")
    rows = told.select("subject", "file", "number", label.alias("label"), broader.alias("broader")).where("subject IS NOT NULL")
    terms = rows.groupBy("subject").agg(F.min_by("label", F.when(F.col("label").isNotNull(), place)).alias("label"), F.min_by("broader", F.when(F.col("broader").isNotNull(), place)).alias("broader"))
    iri = F.btrim("subject", F.lit("<>"))
    return terms.where("label IS NOT NULL").select(F.regexp_extract(iri, r"([^/:#]+)$", 1).alias("term_id"), iri.alias("iri"), nt_unescape(F.col("label")).alias("label"), "broader").withColumn("key", canon_key(F.col("label"), " ;,"))


def code_pairs(lines: DataFrame) -> DataFrame:
    """slug, code: each place of an alignment vocabulary with each Q number that it is matched to, once."""
    told = _statements(lines, "number", "line").where("subject IS NOT NULL")
    codes = F.explode(F.regexp_extract_all("line", F.lit(r"wikidata\.org/(?:entity|wiki)/(Q\d+)"), F.lit(1)))
    slug = F.regexp_extract(F.btrim("subject", F.lit("<>")), r"([^/:#]+)$", 1)
    return told.where(F.col("line").contains("exactMatch")).select(slug.alias("slug"), codes.alias("code")).distinct()


def alignment(lines: DataFrame) -> DataFrame:
    """term_id, exact_matches, close_matches, confidence (the last one told)."""
    told = _statements(lines, "number", "line")
    iris = lambda p: F.when(F.col("line").contains(p), F.regexp_extract_all("line", F.lit(r"<(https?://[^>]+)>"), F.lit(1)))
    confidence = F.regexp_extract("line", r'confidence\s+"?([0-9.]+)', 1).try_cast("double")
    rows = told.select("subject", F.struct("file", "number").alias("at"), iris("exactMatch").alias("e"), iris("closeMatch").alias("c"), confidence.alias("x"))
    flat = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", c)))), lambda s: s[c]))
    term = F.regexp_extract(F.btrim("subject", F.lit("<>")), r"([^/:#]+)$", 1).alias("term_id")
    return rows.where("subject IS NOT NULL").groupBy(term).agg(flat("e").alias("exact_matches"), flat("c").alias("close_matches"), F.max_by("x", F.when(F.col("x").isNotNull(), F.col("at"))).alias("confidence"))
