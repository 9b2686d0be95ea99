"""Literal fixtures of the column functions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import lexicon, stats, temporal, text, vectors


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "make,value,want",
    [
        (text.slug, "Baia Mare (Romania)", "baia-mare-romania"),
        (text.canon_key, "Lviv  (Poland);", "lviv"),
        (text.split_people, "I; my family", ["my family"]),
        (text.split_people, "Smith, John; Anna", ["Smith, John", "Anna"]),
        (text.split_people, "anna, ben", ["anna", "ben"]),
        (text.split_people, "Anna, Ben", ["Anna, Ben"]),
        (text.split_people, None, []),
        (text.split_people, "Not stated", []),
        (text.split_locations, "Lviv|not stated", ["Lviv"]),
        (text.nt_escape, 'a\tb\n"\\', 'a\\tb\\n\\"\\\\'),
        (text.humanise, "miskolc-hungary", "Miskolc Hungary"),
        (text.humanise, "term-12", "term-12"),
        (text.coerce, "  NaN ", ""),
        (text.coerce, None, ""),
        (text.coerce, "a\u00a0 b", "a b"),
        (text.to_int, "12.0", 12),
        (text.to_int, "x", None),
        (text.speaker_label, " INT: yes", "INT"),
        (text.tokens, "Don't think, the well-known's Ab", ["dont", "think", "well-knowns"]),
        (lexicon.markers, "x [CRYING] y [LAUGHTER]", ["crying"]),
        (lexicon.emotion_category, "hopelessness", "positive"),
        (lexicon.emotion_category, "disgust", "neutral"),
        (lexicon.split_emotions, "fear; not stated, joy", ["fear", "joy"]),
    ],
)
def test_literals(spark, make, value, want):
    assert one(spark, make(F.col("x")), value) == want


@pytest.mark.parametrize(
    "what,labels",
    [
        ("deported to the camp by train", ["deportation"]),
        ("hiding in the forest", ["escape"]),
        ("forced labour in the factory", []),
        ("moved to Berlin", ["migration"]),
        ("testified about these events", ["testimony"]),
        ("death", ["selection"]),
    ],
)
def test_activities(spark, what, labels):
    assert one(spark, lexicon.classify(F.col("x"), lexicon.ACTIVITIES), what) == labels


def test_vad(spark):
    score = lambda x: tuple(one(spark, lexicon.lexicon_score(F.col("x"), lexicon.VAD, lexicon.VAD_DEFAULT), x))
    assert score("fear") == (-0.9, 0.8, 0.85)
    assert score("hopelessness") == (0.6, 0.6, 0.6)
    assert score("Unclear") == (0.0, 0.5, 0.5)


@pytest.mark.parametrize(
    "said,want",
    [
        ("1942-1945", (1942, 1945, "year_range", None)),
        ("before the war", (None, 1939, "relative", "pre_war")),
        ("later", None),
        ("not stated", None),
        ("March 15, 1942", (1942, 1942, "month", None)),
        ("May 1944", (1944, 1944, "month", None)),
        ("1940 and 1943", (1940, 1943, "year_range", None)),
        ("as a child", (None, None, "relative", "childhood")),
    ],
)
def test_when(spark, said, want):
    got = one(spark, temporal.parse_when(F.col("x")), said)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "mid,want",
    [(1932.5, "pre_nazi"), (1933, "nazi_rise"), (1939, "early_war"), (1942, "late_war_holocaust"), (1945, "late_war_holocaust"), (1950, "immediate_postwar"), (1951, "later_life")],
)
def test_buckets(spark, mid, want):
    assert one(spark, temporal.bucket(F.lit(mid), F.lit(mid))) == want


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00")), max_size=20))
def test_escape_round_trip(spark, said):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, x string")
    back = rows.select("k", text.nt_unescape(text.nt_escape(F.col("x"))).alias("y")).collect()
    assert {r["k"]: r["y"] for r in back} == dict(enumerate(said))


def test_unicode_escapes(spark):
    assert one(spark, text.nt_unescape(F.col("x")), "\\u00e9 \\U0001F600 \\u4e2d\\\\n") == "é 😀 中\\n"


def test_log_odds_and_kappa(spark):
    assert one(spark, stats.log_odds_z(F.lit(10), F.lit(100), F.lit(10), F.lit(100))) == 0.0
    assert one(spark, stats.kappa(F.lit(0.75), F.lit(0.5))) == 0.5
    assert one(spark, stats.kappa(F.lit(1.0), F.lit(1.0))) == 1.0


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.normalised(v)) == [0.6, 0.8]
    assert one(spark, vectors.normalised(zero)) == [0.0, 0.0]
    assert one(spark, vectors.cosine(v, zero)) == 0.0
