"""Schemas of the tables and graph terms."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"i": T.IntegerType, "l": T.LongType, "s": T.StringType, "d": T.DoubleType}
    return T.StructType([T.StructField(n, kinds[k]()) for n, k in (x.split(":") for x in spec.split())])


UTTERANCES = _struct(
    "interview_id:i part_number:i filename:s text:s start_timestamp:l end_timestamp:l speakers:s word_count:i char_count:i duration_ms:l duration_minutes:d"
)
EVENTS = _struct("utterance_id:s utterance_hash:s interview_id:i who:s what:s where:s when:s emotion:s")
TERM = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "datatype", "lang")])
QUADS = T.StructType(
    [T.StructField("s", T.StringType()), T.StructField("p", T.StringType()), T.StructField("o", TERM), T.StructField("g", T.StringType())]
)
EDGES = _struct("src:s dst:s score:d")
