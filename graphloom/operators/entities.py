"""Dimensions from mentions: people, places, concepts; topics on segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import canon_key, normalise, slug
from graphloom.operators.ordered import first_seen


def resolve_people(mentions: DataFrame, name: str, order: list[str], base: str = "urn:graph:person:") -> DataFrame:
    """mentions with key, iri and label; of a key's names the first seen makes iri and label."""
    keyed = mentions.withColumn("key", canon_key(F.col(name)))
    first = first_seen(keyed, "key", [name], order).select(
        "key", F.concat(F.lit(base), slug(F.col(name))).alias("iri"), normalise(F.col(name)).alias("label")
    )
    return keyed.join(first, "key")


def resolve_places(mentions: DataFrame, name: str, terms: DataFrame, alignment: DataFrame, base: str = "urn:graph:place:") -> DataFrame:
    """mentions with iri, label, method (skos_exact or local_mint), wikidata, geonames, confidence.

    terms(key, term_id, iri, label) and alignment(term_id, exact_matches, close_matches,
    confidence) are dimensions; a mention without a key is dropped.
    """
    links = F.concat(F.coalesce("exact_matches", F.array().cast("array<string>")), F.coalesce("close_matches", F.array().cast("array<string>")))
    known = terms.join(alignment, "term_id", "left").select(
        F.col("key"),
        F.col("term_id"),
        F.col("iri").alias("_iri"),
        F.col("label").alias("_label"),
        F.filter(links, lambda u: u.contains("wikidata.org")).alias("wikidata"),
        F.filter(links, lambda u: u.contains("geonames.org")).alias("geonames"),
        F.col("confidence"),
    )
    keyed = mentions.withColumn("key", canon_key(F.col(name))).where("key <> ''")
    hit = F.col("term_id").isNotNull()
    return keyed.join(known, "key", "left").select(
        *mentions.columns,
        F.when(hit, F.col("_iri")).otherwise(F.concat(F.lit(base), slug(F.col(name)))).alias("iri"),
        F.when(hit, F.coalesce(F.nullif("_label", F.lit("")), F.col(name))).otherwise(normalise(F.col(name))).alias("label"),
        F.when(hit, "skos_exact").otherwise("local_mint").alias("method"),
        "wikidata",
        "geonames",
        "confidence",
    )


def link_concepts(mentions: DataFrame, label: str, terms: DataFrame, base: str = "urn:graph:concept:") -> DataFrame:
    """mentions with the thesaurus term of their label (key without `.` stripping) or a local concept."""
    keyed = mentions.withColumn("key", canon_key(F.col(label), " ;,"))
    known = terms.select("key", F.col("term_id"), F.col("iri").alias("_iri"))
    return keyed.join(known, "key", "left").select(
        *mentions.columns,
        "term_id",
        F.coalesce("_iri", F.concat(F.lit(base), slug(F.col(label), fallback=F.lit("concept")))).alias("iri"),
        F.when(F.col("term_id").isNotNull(), "linked").otherwise("local").alias("method"),
    )


def place_topics(topics: DataFrame, segments: DataFrame, interview: str, part: str, ordinal: str) -> DataFrame:
    """Topic parts laid on the segments of their interview, by the first segment of each slice.

    With n segments and m the greatest part number, part k covers the ordinals from
    int((k-1) n/m) up to min(int(k n/m), n); empty slices are dropped.
    """
    sizes = segments.groupBy(interview).agg(F.count("*").alias("_n"))
    most = topics.groupBy(interview).agg(F.max(part).alias("_m"))
    cut = topics.join(most, interview).join(sizes, interview)
    step = F.col("_n") / F.col("_m")
    cut = cut.withColumns({"_from": F.floor((F.col(part) - 1) * step), "_to": F.least(F.floor(F.col(part) * step), F.col("_n"))}).where("_from < _to")
    here = segments.withColumnsRenamed({interview: "_i", ordinal: "_at"})
    return cut.join(here, (F.col(interview) == F.col("_i")) & (F.col("_from") == F.col("_at"))).drop("_n", "_m", "_from", "_to", "_i", "_at")


def enriched(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """base with the columns of extra by key, and `matched`; a column that both have keeps the base's value on a miss.

    Of several extra rows of a key any one is taken.
    """
    one = extra.dropDuplicates([key])
    both = [c for c in one.columns if c != key and c in base.columns]
    told = one.withColumnsRenamed({c: f"_new_{c}" for c in both}).withColumn("_hit", F.lit(True))
    found = base.join(told, key, "left")
    found = found.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in both} | {"matched": F.coalesce("_hit", F.lit(False))})
    return found.drop("_hit", *[f"_new_{c}" for c in both])
