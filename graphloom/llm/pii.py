"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them.

The values that the base patterns find (an address, a number) are the protected entities.
A term that the corpus shows beside an entity far more often than chance tells who or what it
is, even where the value itself is taken out.  Estimates, over the whole corpus:

- a context is what lies within `window` words to either side of a mention; equal contexts
  of an entity, as in copies of a passage, are one observation;
- p(t | e): the share of the contexts of e that have t; p(t): the chance that as many words
  anywhere have t, from its number of occurrences among all words;
- PMI(e; t) = log2 p(t | e) / p(t), and the information of the entity itself is
  IC(e) = -log2 of its share of all stretches of that length.

PMI / IC is the part of the entity that t gives away: 1 if t is only found with e.  A term
seen in at least `support` contexts of an entity whose part is at least `remove` is removed
wherever it stands, at least `generalise`: replaced by its kind.

Three passes over the texts (mentions; counts of candidates; occurrences), each a narrow map.
What is broadcast are two Bloom filters of fixed size; they only spare rows that can't matter,
and equi-joins on the terms themselves decide.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from graphloom.llm import arrays as A
from graphloom.llm.frames import checkpointed, free_name, quoted, small_batches
from graphloom.llm.linear import WORDLIKE

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the method adds, in their order after the base ones.
ADDED = ("generalised", "removed")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# a match starts where a run of digits does, and runs are never given back: linear in the text
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")

#: Bits of a Bloom filter are kept in blocks of as many as one bitmap holds.
BLOCK_BITS, BLOCKS, PROBES = 1 << 15, 512, 4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain would match, leftmost and not overlapping, in linear time."""
    last = 0
    at = text.find("@")
    while at >= 0:
        part = text[last:at]
        start = last + len(part.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, start)
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, by start, then kind as listed."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _DIGITS.sub("", m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(value: str, kind: int) -> str:
    """An entity's name: what stays the same however the value is written."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else _DIGITS.sub('', value)}"


def byte_places(raw: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Byte offsets of code point offsets (len(text) included)."""
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.append(heads, len(raw))[chars]


def terms(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the terms of one text: runs of ASCII letters, digits and non-ASCII, A-Z lower-cased."""
    start, end, _ = A.words(raw, np.array([0, len(raw)]), WORDLIKE)
    return start, end, A.word_hashes(A.LOWER[raw], start, end)


def _term(raw: np.ndarray, start: int, end: int) -> str:
    return A.LOWER[raw[start:end]].tobytes().decode("utf-8", "replace")


def contexts(text: str, window: int) -> Iterator[tuple[str, list[str]]]:
    """(entity, distinct sorted terms of its context) of each mention; terms inside base values are none."""
    spans = base_spans(text)
    if not spans:
        return
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    lo, hi = (byte_places(raw, np.array([s[k] for s in spans])) for k in (0, 2))
    start, end, _ = terms(raw)
    free = ~A.covered(lo, hi, len(raw))
    keep = free[start] & free[end - 1] if len(start) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    for (s, kind, e), a, b in zip(spans, lo, hi, strict=True):
        left, right = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
        near = [*range(max(0, left - window), left), *range(right, min(len(start), right + window))]
        yield entity(text[s:e], kind), sorted({_term(raw, start[k], end[k]) for k in near})


@dataclass
class Bloom:
    """A filter of fixed size over term hashes; it has false positives only."""

    bits: np.ndarray  # bytes, BLOCKS * BLOCK_BITS bits

    @staticmethod
    def places(hashes: np.ndarray) -> np.ndarray:
        """PROBES bit numbers of each hash, one row a probe."""
        return np.stack([(A.salted(hashes, 90 + k) % A.U64(BLOCKS * BLOCK_BITS)).astype(np.int64) for k in range(PROBES)])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def bloom(names: DataFrame) -> Bloom:
    """The filter of the terms in column t: bitmaps by block, made where the terms lie; 2 MB come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = A.flat(b.column("t"))
            hashes = A.word_hashes(data, off[:-1], off[1:]) if len(data) else np.zeros(0, np.uint64)
            at = np.unique(Bloom.places(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK_BITS), pa.array(at % BLOCK_BITS)], names=["block", "bit"])

    blocks = names.select("t").mapInArrow(run, "block long, bit long").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(BLOCKS * BLOCK_BITS // 8, np.uint8)
    size = BLOCK_BITS // 8
    for r in blocks.collect():  # at most BLOCKS rows of 4 KB
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(bytes(r["map"]).ljust(size, b"\0"), np.uint8)
    return Bloom(out)


def disclosing_terms(docs: DataFrame, text: str = "text", window: int = 8, support: int = 3, remove: float = 0.9, generalise: float = 0.75) -> DataFrame:
    """(t, part, action): terms that reveal a protected entity, action 0 generalise or 1 remove.

    part is the largest share of an entity's information that the term gives away.  A corpus
    without words or entities has none.
    """
    small_batches(docs.sparkSession)

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, what, near = [], [], []
            for t in b.column("text"):
                for e, found in contexts(t.as_py() or "", window):
                    key = hashlib.blake2b("\x00".join(found).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                    who.append(e)
                    what.append(key)
                    near.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(what, pa.string()), pa.array(near, pa.list_(pa.string()))], names=["e", "context", "near"])

    texts = docs.select(F.col(text).alias("text"))
    seen = checkpointed(texts.mapInArrow(mentions, "e string, context string, near array<string>").distinct())
    n_e = seen.groupBy("e").agg(F.count("*").alias("n_e"))
    n_et = seen.select("e", F.explode("near").alias("t")).groupBy("e", "t").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    pairs = checkpointed(n_et.join(n_e, "e"))
    wanted = bloom(pairs.select("t").distinct())

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, held = 0, {}
            for _, _, d, o in A.chunks(*A.flat(b.column("text"))):
                start, end, _ = A.words(d, o, WORDLIKE)
                hashes = A.word_hashes(A.LOWER[d], start, end)
                total += len(start)
                some = np.flatnonzero(wanted.has(hashes))
                _, at, n = np.unique(hashes[some], return_index=True, return_counts=True)
                for k, times in zip(some[at], n, strict=True):
                    t = _term(d, start[k], end[k])
                    held[t] = held.get(t, 0) + int(times)
            yield pa.RecordBatch.from_arrays([pa.array([None, *held], pa.string()), pa.array([total, *held.values()], pa.int64())], names=["t", "n"])

    counted = checkpointed(texts.mapInArrow(counts, "t string, n long").groupBy("t").agg(F.sum("n").alias("f")))
    words = counted.where("t IS NULL").agg(F.coalesce(F.max("f"), F.lit(0))).first()[0]
    if not words:
        return pairs.select("t", F.lit(0.0).alias("part"), F.lit(0).alias("action")).limit(0)
    span = 2 * window
    chance = -F.expm1(span * F.log1p(-F.least(F.col("f") / words, F.lit(1 - 1e-9))))
    pmi = F.log2(F.col("n_et") / F.col("n_e") / chance)
    own = F.greatest(log2(max(words, 2)) - F.log2(F.col("n_e") * span), F.lit(1.0))
    part = pairs.join(counted.where("t IS NOT NULL"), "t").groupBy("t").agg(F.max(pmi / own).alias("part"))
    return part.where(F.col("part") >= generalise).select("t", "part", (F.col("part") >= remove).cast("int").alias("action"))


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("kind", LongType()), StructField("end", LongType())]))
_HITS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("t", StringType())]))


def personal_spans(docs: DataFrame, keep: list[str] | None = None, text: str = "text", window: int = 8, support: int = 3, remove: float = 0.9, generalise: float = 0.75) -> DataFrame:
    """The columns `keep` of docs (default: all) with _base and _added: arrays of (start, kind, end).

    Places are in code points, kinds numbered as in KINDS + ADDED; _base has the base patterns'
    matches by start and kind, _added the occurrences, outside of those, of the terms of
    `disclosing_terms`.  Null and empty texts have neither; very long ones are read whole, in
    time linear in them; rows that repeat are judged alike; an empty table stays empty.
    Columns of docs called _base, _added or _hits are replaced, others kept whatever their names.
    """
    small_batches(docs.sparkSession)
    rules = checkpointed(disclosing_terms(docs, text, window, support, remove, generalise))
    wanted = bloom(rules)
    some = bool(wanted.bits.any())
    columns = [c for c in keep or docs.columns if c not in ("_base", "_added", "_hits")]
    read = docs.select(*quoted([*(c for c in columns if c != text), text]))
    row = free_name([*columns, "_base", "_added", "_hits"], "_row")
    shape = StructType([*(docs.schema[c] for c in columns), StructField("_base", _SPANS), StructField("_hits", _HITS)])
    kinds = [f.type for f in to_arrow_schema(shape)][-2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, hits = [], []
            for cell in b.column(text):
                value = cell.as_py() or ""
                spans = base_spans(value)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                hits.append(list(_occurrences(value, spans, wanted)) if some and value else [])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(base, kinds[0]), pa.array(hits, kinds[1])], names=[*columns, "_base", "_hits"])

    # only rows that have any term of the filter meet the rules, term by term
    found = checkpointed(read.mapInArrow(run, shape).withColumn(row, F.monotonically_increasing_id()))
    with_any, none = F.size("_hits") > 0, F.array().cast(_SPANS)
    hits = found.where(with_any).select(row, F.explode("_hits").alias("h")).select(row, "h.*").join(rules.select("t", "action"), "t")
    span = F.struct("start", (F.col("action") + len(KINDS)).cast("long").alias("kind"), "end")
    added = hits.groupBy(row).agg(F.sort_array(F.collect_list(span)).alias("_added"))
    out = [*quoted(columns), "_base", "_added"]
    plain = found.where(~with_any).withColumn("_added", none)
    return plain.select(*out).union(found.where(with_any).join(added, row, "left").withColumn("_added", F.coalesce("_added", none)).select(*out))


def _occurrences(value: str, spans: list[tuple[int, int, int]], wanted: Bloom) -> Iterator[dict]:
    """Terms of the filter in a text, outside its base spans."""
    raw = np.frombuffer(value.encode("utf-8", "surrogatepass"), np.uint8)
    start, end, hashes = terms(raw)
    pick = np.flatnonzero(wanted.has(hashes))
    if not len(pick):
        return
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    bare = ~A.covered(np.array([s for s, _, _ in spans], np.int64), np.array([e for _, _, e in spans], np.int64), int(chars[-1]))
    for k in pick:
        s, e = int(chars[start[k]]), int(chars[end[k]])
        if bare[s] and bare[e - 1]:
            yield {"start": s, "end": e, "t": _term(raw, start[k], end[k])}


def sanitised(docs: DataFrame, text: str = "text", **rules) -> DataFrame:
    """docs with the texts sanitised: base values become `[EMAIL]` and so on, generalised terms their kind, removed ones nothing.

    Overlapping spans are replaced as one, by what the first of them becomes.
    """
    out = personal_spans(docs, None, text, **rules)
    columns = [c for c in out.columns if c not in ("_base", "_added")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for cell, base, added in zip(*(b.column(c).to_pylist() for c in (text, "_base", "_added")), strict=True):
                parts, at = [], 0
                for s in sorted([*base, *added], key=lambda x: (x["start"], x["kind"])):
                    if s["start"] >= at:
                        parts += [cell[at : s["start"]], _instead(cell[s["start"] : s["end"]], s["kind"])]
                    at = max(at, s["end"])
                texts.append(None if cell is None else "".join(parts) + cell[at:])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else b.column(c) for c in columns], names=columns)

    schema = StructType([StructField(c, StringType()) if c == text else out.schema[c] for c in columns])
    return out.mapInArrow(run, schema)


def _instead(term: str, kind: int) -> str:
    if kind < len(KINDS):
        return f"[{KINDS[kind].upper()}]"
    if ADDED[kind - len(KINDS)] == "removed":
        return ""
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[TERM]"


def span_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of these spans, and all spans as text."""
    found = personal_spans(docs.select(doc_id, text), [doc_id], text, **rules)
    names = F.array(*(F.lit(k) for k in (*KINDS, *ADDED)))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"].cast("int")), x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.expr(f"filter(_base, x -> x.kind = {k})")).cast("long").alias(f"n_{KINDS[k]}") for k in range(len(KINDS))]
    every = F.array_sort(F.concat("_base", "_added"))
    return found.select(F.col(doc_id).alias("doc_id"), *counts, F.sha2(told("_base"), 256).alias("base_sha256"), told(every).alias("spans"))
