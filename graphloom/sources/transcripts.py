"""XML transcripts: one utterance a paragraph, in document order."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import file_numbers, word_count

_SPEAKER = re.compile(r"\s*([A-Za-z]{1,10})\s*:")
_ROWS = "filename string, ordinal int, text string, start_timestamp long, end_timestamp long, speakers string"


def _named(node: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in node.iter() if isinstance(x.tag, str) and x.tag.rsplit("}", 1)[-1] == name)


def _whole(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def paragraphs(xml: bytes) -> list[tuple[str, int | None, int | None, str | None]]:
    """(text, first and last time, speakers) of each paragraph with text; [] if the XML is broken."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out = []
    for p in _named(root, "p"):
        spans = list(_named(p, "span"))
        if spans:
            parts = [t.strip("\n") for s in spans for t in (s.text, s.tail) if t and t.strip("\n")]
        else:
            whole = " ".join(t.strip() for t in p.itertext() if t and t.strip())
            parts = [whole] if whole else []
        text = " ".join(parts).strip()
        if text:
            times = [t for t in (_whole(s.get("m")) for s in spans) if t is not None]
            labels = sorted({m.group(1) for m in map(_SPEAKER.match, parts) if m})
            out.append((text, min(times, default=None), max(times, default=None), ", ".join(labels) or None))
    return out


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances of all *.xml below a folder; a broken file gives none."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(folder))


def parsed(files: DataFrame) -> DataFrame:
    """Utterances of files (path, content).

    Numbers come from names like `123.1.xml` (else null); durations from the times.
    """
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f, k, *p) for f, xml in zip(part["filename"], part["content"], strict=True) for k, p in enumerate(paragraphs(xml))]
            frame = pd.DataFrame(rows, columns=["filename", "ordinal", "text", "start_timestamp", "end_timestamp", "speakers"])
            yield frame.astype({"start_timestamp": "Int64", "end_timestamp": "Int64"})

    interview, number = file_numbers(F.col("filename"))
    duration = F.col("end_timestamp") - F.col("start_timestamp")
    return named.mapInPandas(run, _ROWS).select(
        interview.alias("interview_id"), number.alias("part_number"), "filename", "ordinal", "text", "start_timestamp", "end_timestamp", "speakers",
        word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"), duration.alias("duration_ms"), (duration / 60000).alias("duration_minutes"),
    )
