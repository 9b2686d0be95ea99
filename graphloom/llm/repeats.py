"""Finding all repeated passages of a corpus: the frame around two exact resolvers.

A window is `length` consecutive tokens (words or bytes) of one document.  Its anchor is
its leftmost gram of least hash, so equal windows have equal anchors at equal offsets and
only equal anchors need to meet:

1. each task sends every distinct anchor once a bucket of documents; anchors that occur
   twice anywhere go back to the buckets that have them (no row per occurrence, so a
   passage in a third of all documents costs one entry a bucket);
2. each bucket sends, for repeated anchors, each distinct run of windows around them once,
   with its tokens, its earliest place and its number of places;
3. a resolver decides exactly which windows of these runs repeat, and where first;
4. each bucket applies the answers to its documents.

The texts are shuffled once (steps 2 and 4 read the same exchange) and no step holds more
than a bucket or a share of the distinct runs.

A common anchor in many surroundings has as many distinct runs.  Those of an anchor found in
more than WIDE buckets are therefore cut into parts by how far before the anchor a window
starts; the windows of a part have more than the anchor in common, and that core takes the
anchor's place.  Beyond WIDEST buckets the parts are smaller, for words single windows, so
that surroundings that differ meet in different places.  Both ends know from step 1 which
anchors these are, and no window is left out.

Runs travel with their text: bytes, or words with one space behind each.  Equal runs are told
by 64-bit hashes of anchor and content and compared byte by byte wherever two are taken for
one; should they differ, the job ends with an ArithmeticError and another `salt` gives other
hashes.  Resolvers compare the text too, so no word is taken for another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, LongType, StringType, StructField, StructType

from graphloom.llm import arrays as A
from graphloom.llm.frames import buckets, free_name, small_batches

FIRST = np.iinfo(np.int64).min
#: Runs of anchors in more buckets than this are cut into halves, and into finer parts.
WIDE, WIDEST = 64, 1024
#: Bytes of text in a bucket, about, where documents are long.
BUCKET_BYTES = 32 << 20


@dataclass(frozen=True)
class Tokens:
    """How a text is cut: words or bytes, `length` of them a window, `gram` an anchor."""

    words: bool
    length: int
    gram: int
    fine: int = 1  # windows in a part of the runs of the commonest anchors
    salt: int = 0

    @property
    def table(self) -> np.ndarray:
        """Values of the bytes."""
        return A.salted(A.BYTE, self.salt) if self.salt else A.BYTE

    def steps(self, level: np.ndarray) -> np.ndarray:
        """Windows in a part at levels 0 (whole runs: 0), 1 (halves) and 2."""
        return np.array([0, (self.length - self.gram + 2) // 2, self.fine])[level]


@dataclass
class Runs:
    """Distinct runs of windows with one anchor, as they meet in a resolver."""

    anchor: np.ndarray  # hash of the anchor
    content: np.ndarray  # hash of the run's tokens and the anchor's place in it
    shift: np.ndarray  # tokens before the anchor
    windows: np.ndarray  # number of windows
    doc: np.ndarray  # earliest place: document and first token
    start: np.ndarray
    count: np.ndarray  # number of places
    text: np.ndarray  # bytes of all runs, one after the other
    begin: np.ndarray  # n + 1, in bytes


#: (run, first window, end window, document, start): these windows are removed wherever they start later than the place.
Answers = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Resolver = Callable[[Runs, int], Answers]


def packed(*arrays: np.ndarray) -> bytes:
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)


def unpacked(raw: bytes) -> list[np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for part in raw[4:at].decode().split(";"):
        kind, size = part.split(",")
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += out[-1].nbytes
    return out


def joined(blobs: list[bytes], kinds: str) -> list[np.ndarray]:
    """The arrays of several blobs, end to end."""
    parts = [unpacked(b) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds.split())]


@dataclass
class Cut:
    """Anchored runs of a chunk of documents; places are token numbers in the chunk."""

    first: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    start: np.ndarray
    last: np.ndarray
    hash: np.ndarray
    values: np.ndarray
    prefix: A.Prefix
    span: tuple[np.ndarray, np.ndarray] | None

    def spelt(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's tokens as text, words with one space behind each, and where each begins (n + 1)."""
        if self.span is None:
            return data, np.arange(len(data) + 1)
        start, end = self.span
        _, at = A.spread(start, end + 1)
        text = np.append(data, np.uint8(0x20))[at]
        edge = np.concatenate([[0], np.cumsum(end - start + 1)])
        if len(start):
            text[edge[1:] - 1] = 0x20
        return text, edge

    def only(self, which: np.ndarray) -> Cut:
        """These runs alone."""
        return Cut(self.first, self.doc[which], self.at[which], self.start[which], self.last[which], self.hash[which], self.values, self.prefix, self.span)

    def content(self, take: np.ndarray, length: int) -> np.ndarray:
        s, e, p = self.start[take], self.last[take] + length, self.at[take]
        return A.mix(self.prefix.of(s, e) + (p - s).astype(A.U64) * A.U64(0xC2B2AE3D27D4EB4F))


def cut(data: np.ndarray, off: np.ndarray, by: Tokens) -> Cut:
    span = None
    if by.words:
        start, end, first = A.words(data, off)
        values, span = A.word_hashes(data, start, end, by.table), (start, end)
    else:
        values, first = by.table[data], off
    size = np.diff(first)
    n_windows = np.maximum(size - by.length + 1, 0)
    some = n_windows > 0
    _, grams = A.spread(first[:-1][some], first[:-1][some] + size[some] - by.gram + 1)
    prefix = A.Prefix(values)
    hashes = prefix.of(grams, grams + by.gram)
    a, s, e = A.minimizers(hashes, n_windows[some], by.length - by.gram + 1)
    at = grams[a]
    return Cut(first, np.searchsorted(first, at, "right") - 1, at, grams[s], grams[e], hashes[a], values, prefix, span)


def divided(c: Cut, steps: np.ndarray, length: int) -> Cut:
    """c, with the runs of which `steps` isn't 0 in parts of so many windows.

    The windows of a part start from k * step to (k + 1) * step - 1 tokens before the anchor;
    the hash of the tokens that all of them cover stands for the anchor's.
    """
    some = np.flatnonzero(steps)
    if not len(some):
        return c
    at, step, whole = c.at[some], steps[some], steps == 0
    owner, part = A.spread((at - c.last[some]) // step, (at - c.start[some]) // step + 1)
    at, step = at[owner], step[owner]
    start = np.maximum(c.start[some][owner], at - (part + 1) * step + 1)
    last = np.minimum(c.last[some][owner], at - part * step)
    core = A.mix(c.prefix.of(at - part * step, at + length + 1 - (part + 1) * step) + (part + 1).astype(A.U64) * A.U64(0x94D049BB133111EB))
    both = lambda old, new: np.concatenate([old[whole], new])
    return Cut(c.first, both(c.doc, c.doc[some][owner]), both(c.at, at), both(c.start, start), both(c.last, last), both(c.hash, core), c.values, c.prefix, c.span)


def _found(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in `known` (sorted) each hash is, and whether it is there."""
    place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    return place, known[place] == hashes if len(known) else np.zeros(len(hashes), bool)


def gathered(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The slices [begin, end), one after the other."""
    return np.concatenate([np.zeros(0, text.dtype), *(text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True))])


def _same_text(text: np.ndarray, begin: np.ndarray, end: np.ndarray, order: np.ndarray, head: np.ndarray) -> None:
    """Compares the runs that are taken for one: `order` lists runs (begin, end), `head` where each distinct one begins in it."""
    times = np.diff(np.append(head, len(order)))
    first = np.repeat(order[head], times)
    again = first != order
    raw = memoryview(np.ascontiguousarray(text)).cast("B")
    for one, other in zip(first[again].tolist(), order[again].tolist(), strict=True):
        if raw[begin[one] : end[one]].tobytes() != raw[begin[other] : end[other]].tobytes():
            raise ArithmeticError("different runs have equal hashes; choose another salt")


def _by_target(target: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(target, kind="stable")
    edge = np.searchsorted(target[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edge)):
        pick = order[edge[k] : edge[k + 1]]
        yield int(k), packed(*(a[pick] for a in arrays))


def _rows(name: str, pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], names=[name, "blob"])


def _table(name: str, pairs: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_rows(name, pairs)])


def _distinct(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by keys (the first counts most), and where each distinct key begins in it."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(fresh)


def repeated_windows(docs: DataFrame, by: Tokens, resolve: Resolver, apply: Callable, schema: StructType, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """apply(rows, chunk bytes, chunk offsets, cut, covered tokens) for all documents; see the module.

    `rows` is an Arrow table with the columns of docs; apply returns a batch of `schema`.

    Null and empty texts have no tokens; a null id counts as the least; ids that aren't whole
    numbers are in the order of their 64-bit hashes; rows with equal ids are different
    documents at equal places, so none of them is earlier than another.
    """
    small_batches(docs.sparkSession)
    given = F.col(doc_id)
    key = F.coalesce(given.cast("long") if isinstance(docs.schema[doc_id].dataType, IntegralType) else F.when(given.isNotNull(), F.xxhash64(given)), F.lit(FIRST))
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    n_bucket, n_target = max(buckets(total), -(-size // BUCKET_BYTES)), buckets(total, 10_000)
    key_name, bucket_name = (free_name(docs.columns, c) for c in ("_key", "_bucket"))
    # a row's bucket is told by its content, as it is asked twice; rows without text are never asked and lie anywhere
    bare = F.coalesce(F.octet_length(text), F.lit(0)) == 0
    place = F.when(bare, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(key, F.col(text)))
    rows = docs.select("*", key.alias(key_name), F.pmod(place, F.lit(n_bucket)).cast("int").alias(bucket_name))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held])
            b = np.concatenate([x for _, x in held])
            order, begin = _distinct((h, b))
            many = np.diff(np.append(begin, len(h))) > 1
            h, b = h[order][begin], b[order][begin]
            held.clear()
            return _rows("target", list(_by_target((h % A.U64(n_target)).astype(np.int64), n_target, h, b << 1 | many)))

        for batch in batches:
            bucket = batch.column(bucket_name).to_numpy(zero_copy_only=False)
            for i, j, d, o in A.chunks(*A.flat(batch.column(text))):
                c = cut(d, o, by)
                held.append((c.hash, bucket[i:j][c.doc].astype(np.int32)))
                size += len(c.hash)
                if size > max(1 << 20, 64 * n_target):
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def repeated(table: pa.Table) -> pa.Table:
        h, b = joined(table.column("blob").to_pylist(), "u8 i4")
        order = np.argsort(h, kind="stable")
        h, b = h[order], b[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(h)))
        many = (size > 1) | (np.maximum.reduceat(b & 1, begin) > 0) if len(h) else np.zeros(0, bool)
        keep = np.repeat(many, size)
        h, b = h[keep], b[keep] >> 1
        order, begin = _distinct((h, b))
        h, b = h[order][begin], b[order][begin]
        in_buckets = np.repeat(n := np.diff(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))), n) if len(h) else b
        level = ((in_buckets > WIDE).astype(np.uint8) + (in_buckets > WIDEST)).astype(np.uint8)
        out = [(k, raw, wide) for wide in (0, 1) for k, raw in _by_target(b[(level > 0) == wide], n_bucket, h[(level > 0) == wide], level[(level > 0) == wide])]
        return pa.table({"bucket": pa.array([k for k, _, _ in out], pa.int32()), "blob": pa.array([raw for _, raw, _ in out], pa.binary()), "wide": pa.array([w for _, _, w in out], pa.int32())})

    def runs(left: pa.Table, right: pa.Table) -> pa.Table:
        known, level = joined(right.column("blob").to_pylist(), "u8 u1")
        known, pick = np.unique(known, return_index=True)
        if not len(left) or not len(known):
            return _table("target", [])
        steps, keys = by.steps(level[pick]), left.column(key_name).to_numpy()
        found = []
        for i, j, d, o in A.chunks(*A.flat(left.column(text))):
            c = cut(d, o, by)
            place, hit = _found(c.hash, known)
            c = c.only(hit)
            c = divided(c, steps[place[hit]], by.length)
            content = c.content(np.arange(len(c.hash)), by.length)
            doc, start = keys[i:j][c.doc], c.start - c.first[c.doc]
            order, begin = _distinct((c.hash, content))
            # the earliest place of each distinct run, and the number of places
            rank = np.lexsort((start, doc, content, c.hash))
            count = np.diff(np.append(begin, len(order)))
            spelt, edge = c.spelt(d)
            low, high = edge[c.start], edge[c.last + by.length]
            _same_text(spelt, low, high, rank, begin)
            pick = rank[begin]
            n_windows = (c.last - c.start)[pick] + 1
            found.append((c.hash[pick], content[pick], (c.at - c.start)[pick], n_windows, doc[pick], start[pick], count, gathered(spelt, low[pick], high[pick]), (high - low)[pick]))
        parts = [np.concatenate([f[k] for f in found]) for k in range(9)]
        merged = _merge(Runs(*parts[:8], np.concatenate([[0], np.cumsum(parts[8])])))
        target = (merged.anchor % A.U64(n_target)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        edge = np.searchsorted(target[order], np.arange(n_target + 1))
        bucket = left.column(bucket_name)[0].as_py()
        out = []
        for k in np.flatnonzero(np.diff(edge)):
            pick = order[edge[k] : edge[k + 1]]
            m = merged
            out.append((int(k), packed(
                m.anchor[pick], m.content[pick], m.shift[pick].astype(np.int16), m.windows[pick].astype(np.int16), m.doc[pick], m.start[pick].astype(np.int64),
                m.count[pick].astype(np.int64), gathered(m.text, m.begin[pick], m.begin[pick + 1]), np.diff(m.begin)[pick].astype(np.int32), np.full(len(pick), bucket, np.int32),
            )))
        return _table("target", out)

    def resolved(table: pa.Table) -> pa.Table:
        anchor, content, shift, windows, doc, start, count, text, size, bucket = joined(table.column("blob").to_pylist(), "u8 u8 i2 i2 i8 i8 i8 u1 i4 i4")
        begin = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
        every = Runs(anchor, content, shift.astype(np.int64), windows.astype(np.int64), doc, start, count, text, begin)
        one = _merge(every)
        which, lo, hi, at_doc, at_start = resolve(one, by.length)
        # back to every bucket that has the run
        order, begin = _distinct((anchor, content))  # the same order as _merge
        size = np.diff(np.append(begin, len(order)))
        owner, place = A.spread(begin[which], begin[which] + size[which])
        to = bucket[order][place]
        return _table("bucket", list(_by_target(
            to, n_bucket, one.anchor[which][owner], one.content[which][owner], lo[owner].astype(np.int16), hi[owner].astype(np.int16), at_doc[owner], at_start[owner].astype(np.int64)
        )))

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = right.column("wide").to_pylist()
        answers, common = ([b for b, k in zip(right.column("blob").to_pylist(), kinds, strict=True) if k == kind] for kind in (0, 1))
        wide, level = joined(common, "u8 u1")
        wide, pick = np.unique(wide, return_index=True)
        steps = by.steps(level[pick])
        anchor, content, lo, hi, at_doc, at_start = joined(answers, "u8 u8 i2 i2 i8 i8")
        order = np.lexsort((content, anchor))
        anchor, content, lo, hi, at_doc, at_start = (x[order] for x in (anchor, content, lo, hi, at_doc, at_start))
        name = A.mix(anchor) ^ content
        order = np.argsort(name, kind="stable")
        name, anchor, content, lo, hi, at_doc, at_start = (x[order] for x in (name, anchor, content, lo, hi, at_doc, at_start))
        known = np.unique(anchor)
        keys, out = left.column(key_name).to_numpy(), []
        given = left.select([c for c in left.column_names if c not in (key_name, bucket_name)])
        for i, j, d, o in A.chunks(*A.flat(left.column(text))):
            c = cut(d, o, by)
            n_token = len(c.values)
            mask = np.zeros(n_token, bool)
            if len(known) and len(c.hash):
                if len(wide):
                    place, hit = _found(c.hash, wide)
                    c = divided(c, np.where(hit, steps[place], 0), by.length)
                hit = np.flatnonzero(_found(c.hash, known)[1])
                mine = c.content(hit, by.length)
                want = A.mix(c.hash[hit]) ^ mine
                a, b = np.searchsorted(name, want, "left"), np.searchsorted(name, want, "right")
                who, ans = A.spread(a, b)
                run = hit[who]
                doc, start = keys[i:j][c.doc[run]], c.start[run] - c.first[c.doc[run]]
                later = (content[ans] == mine[who]) & ((at_doc[ans] < doc) | ((at_doc[ans] == doc) & (at_start[ans] < start)))
                run, ans = run[later], ans[later]
                mask = A.covered(c.start[run] + lo[ans], c.start[run] + hi[ans] - 1 + by.length, n_token)
            out.append(apply(given.slice(i, j - i), d, o, c, mask))
        return pa.Table.from_batches(out) if out else empty.empty_table()

    empty = to_arrow_schema(schema)
    dealt = rows.groupBy(bucket_name)
    sent = rows.select(bucket_name, text).mapInArrow(anchors, "target int, blob binary")
    back = sent.groupBy("target").applyInArrow(repeated, "bucket int, blob binary, wide int")
    met = dealt.cogroup(back.groupBy("bucket")).applyInArrow(runs, "target int, blob binary")
    told = met.groupBy("target").applyInArrow(resolved, "bucket int, blob binary")
    told = told.withColumn("wide", F.lit(0)).union(back.where("wide = 1"))
    return dealt.cogroup(told.groupBy("bucket")).applyInArrow(finished, schema)


def _merge(r: Runs) -> Runs:
    """Equal runs once: the earliest place, the number of all places; sorted by anchor and content."""
    order, begin = _distinct((r.anchor, r.content))
    if not len(order):
        return r
    _same_text(r.text, r.begin[:-1], r.begin[1:], order, begin)
    first = np.lexsort((r.start, r.doc, r.content, r.anchor))[begin]
    count = np.add.reduceat(r.count[order], begin)
    low, high = r.begin[first], r.begin[first + 1]
    text = gathered(r.text, low, high)
    return Runs(r.anchor[first], r.content[first], r.shift[first], r.windows[first], r.doc[first], r.start[first], count, text, np.concatenate([[0], np.cumsum(high - low)]))


def grouped(r: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Number of the anchor's group of each run, and its size; runs are sorted by anchor."""
    fresh = np.concatenate([[True], r.anchor[1:] != r.anchor[:-1]]) if len(r.anchor) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    return group, np.bincount(group)[group] if len(group) else group


def digest_schema(docs: DataFrame, doc_id: str, *counts: str) -> StructType:
    """doc_id, counts, kept_sha256."""
    return StructType([StructField("doc_id", docs.schema[doc_id].dataType), *(StructField(c, LongType()) for c in counts), StructField("kept_sha256", StringType())])


def kept_digests(data: np.ndarray, off: np.ndarray, keep: np.ndarray) -> list[str]:
    """SHA-256 of each document's kept bytes."""
    left = np.concatenate([[0], np.cumsum(keep)])[off]
    raw = data[keep].tobytes()
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(left[:-1], left[1:], strict=True)]
