"""Judging links of places to authorities by country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_token(slug: Column, known: list[str]) -> Column:
    """The token of a slug that names a country: the last known single one, else the last known pair; null if none."""
    parts = F.split(F.lower(slug), "-")
    n = F.size(parts)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws("-", F.get(parts, i - 1), F.get(parts, i)))
    names = F.array(*[F.lit(k) for k in known])
    found = F.filter(F.concat(F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")), parts), lambda t: F.array_contains(names, t))
    return F.get(found, F.size(found) - 1)


def authority(iri: Column) -> Column:
    """wikidata, geonames or other, by the address."""
    return F.when(iri.contains("wikidata.org/"), "wikidata").when(iri.contains("geonames.org/"), "geonames").otherwise("other")


def authority_id(iri: Column) -> Column:
    """The Q number or the geonames number at the end of an address; null if there is none."""
    q = F.regexp_extract(iri, r"/(Q\d+)$", 1)
    number = F.regexp_extract(iri, r"/(\d+)/?$", 1)
    return F.nullif(F.when(authority(iri) == "wikidata", q).when(authority(iri) == "geonames", number).otherwise(F.lit("")), F.lit(""))


def browse_url(iri: Column) -> Column:
    """The address of a page for people."""
    page = F.concat(F.lit("https://www.geonames.org/"), authority_id(iri))
    return F.when(authority(iri) == "wikidata", F.replace(iri, F.lit("/entity/"), F.lit("/wiki/"))).when(page.isNotNull() & (authority(iri) == "geonames"), page).otherwise(iri)


def judge_links(links: DataFrame, facts: DataFrame, countries: dict[str, str], successors: dict[str, list[str]], historical: list[str], slug: str = "slug", target: str = "target") -> DataFrame:
    """links with token, judgment (correct, incorrect, unsure) and note.

    facts(target_id, countries: array of country ids) is what the authorities say.
    countries: token -> country id; successors: token -> ids also right; historical: tokens
    whose mismatches only a person can judge.  All three are configuration.
    """
    token = F.col("token")
    pick = lambda table: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]) if isinstance(v, list) else F.lit(v))]), token)
    rows = links.withColumns({"token": last_token(F.col(slug), list(countries)), "target_id": authority_id(F.col(target)), "_kind": authority(F.col(target))})
    rows = rows.join(facts.select("target_id", F.col("countries").alias("_has")), "target_id", "left")
    rows = rows.withColumns({"_want": pick(countries), "_also": pick(successors) if successors else F.lit(None).cast("array<string>")})
    has = F.col("_has")
    steps = [
        (F.col("_kind") == "other", "unsure", "unknown authority"),
        (has.isNull(), "unsure", "nothing known of the target"),
        (F.col("_want").isNull(), "unsure", "no known country in the slug"),
        (F.size(has) == 0, "unsure", "target without country"),
        (F.array_contains(has, F.col("_want")), "correct", "same country"),
        (F.coalesce(F.arrays_overlap(has, F.col("_also")), F.lit(False)), "correct", "successor state"),
        (token.isin(historical), "unsure", "historical borders"),
    ]
    verdict, note = F.when(steps[0][0], steps[0][1]), F.when(steps[0][0], steps[0][2])
    for test, v, n in steps[1:]:
        verdict, note = verdict.when(test, v), note.when(test, n)
    return rows.withColumns({"judgment": verdict.otherwise("incorrect"), "note": note.otherwise("other country")}).drop("_kind", "_has", "_want", "_also", "target_id")


def crosswalk(mine: DataFrame, theirs: DataFrame, links: str, code: str = "code", pattern: str = r"(Q\d+)$") -> DataFrame:
    """Rows of two vocabularies that go with one code: a column of `mine`, the end of a link in `theirs`.

    The codes are taken out of the links, so that the join is one of equal keys.
    """
    found = theirs.withColumn("_link", F.explode(links)).withColumn(code, F.nullif(F.regexp_extract("_link", pattern, 1), F.lit(""))).where(F.col(code).isNotNull())
    return mine.join(found.drop("_link", links).distinct(), code)
