"""Expressions of time: years, precision, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import is_nothing

# What a year and a month look like, and two years as a range.
_YEAR = r"1[89]\d{2}|20\d{2}"
_MONTH = r"(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_PAIR = rf"({_YEAR})\s*[-–to]+\s*({_YEAR})"
# Relative expressions (in order) and the years they stand for.
RELATIVE = {
    "pre_war": ([r"\bbefore the war\b", r"\bpre[- ]?war\b", r"\bbefore 1939\b"], None, 1939),
    "during_war": ([r"\bduring the war\b", r"\bwar years?\b", r"\bwartime\b"], 1939, 1945),
    "post_war": ([r"\bafter the war\b", r"\bpost[- ]?war\b", r"\bafter liberation\b"], 1945, None),
    "childhood": ([r"\bas a child\b", r"\bchildhood\b", r"\bwhen .* young\b"], None, None),
}
# Upper edges of the midpoint, whether the edge belongs to the bucket, and the name.
EDGES = [
    (1933, False, "pre_nazi"),
    (1939, False, "nazi_rise"),
    (1942, False, "early_war"),
    (1945, True, "late_war_holocaust"),
    (1950, True, "immediate_postwar"),
]
LAST_BUCKET = "later_life"


def parse_when(x: Column) -> Column:
    """Struct start_year, end_year, precision, period; null if nothing is recognised.

    Tried in order: day or month with a year, a range of two years, years, relative words.
    """
    text = F.trim(x)

    def found(start: Column, end: Column, precision: Column | str, period: str | None = None) -> Column:
        kind = precision if isinstance(precision, Column) else F.lit(precision)
        return F.struct(
            start.cast("int").alias("start_year"), end.cast("int").alias("end_year"), kind.alias("precision"), F.lit(period).cast("string").alias("period")
        )

    day, month = rf"{_MONTH}\s+\d{{1,2}},?\s+({_YEAR})", rf"{_MONTH}\s+({_YEAR})"
    pair = _PAIR
    one = lambda p, k=1: F.regexp_extract(text, p, k).try_cast("int")
    years = F.transform(F.regexp_extract_all(text, F.lit(rf"\b({_YEAR})\b"), F.lit(1)), lambda y: y.cast("int"))
    a, b = one(pair), one(pair, 2)
    result = (
        F.when(is_nothing(x), F.lit(None))
        .when(text.rlike(day), found(one(day), one(day), "month"))
        .when(text.rlike(month), found(one(month), one(month), "month"))
        .when(text.rlike(pair), found(F.least(a, b), F.greatest(a, b), "year_range"))
        .when(F.size(years) > 0, found(F.array_min(years), F.array_max(years), F.when(F.size(years) == 1, "year").otherwise("year_range")))
    )
    for period, (patterns, start, end) in RELATIVE.items():
        result = result.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), found(F.lit(start), F.lit(end), "relative", period))
    return result


def bucket(start: Column, end: Column, period: Column | None = None, edges: list = EDGES, last: str = LAST_BUCKET) -> Column:
    """The period if there is one, else a bucket by the midpoint of the years; null if one is missing."""
    mid = (start + end) / 2
    pick = F.when(period.isNotNull(), period).when(mid.isNull(), F.lit(None)) if period is not None else F.when(mid.isNull(), F.lit(None))
    for edge, closed, name in edges:
        pick = pick.when(mid <= edge if closed else mid < edge, F.lit(name))
    return pick.otherwise(F.lit(last))
