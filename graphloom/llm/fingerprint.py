"""Document fingerprints by consistent weighted sampling.

A document is the multiset of its word shingles.  For sample k a term of weight w draws
r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), all fixed by the term; t = floor(ln w / r + b)
and ln a = ln c - r (t - b + 1).  The term of least a, with its t, is the sample; two
documents agree in a sample with the probability of their generalised Jaccard similarity.
The draws come from two tables of seeded samples, indexed by independent parts of the
term's hash, so that a term costs two look-ups a sample; the sample kept is a hash of the
whole term and t, so distinct terms stay distinct.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A
from graphloom.llm.frames import buckets, small_batches, widened

SAMPLES, SHINGLE, SLOTS = 64, 5, 15


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_11)
    shape = (1 << SLOTS, SAMPLES)
    c, r, b = rng.gamma(2.0, 1.0, shape), rng.gamma(2.0, 1.0, shape), rng.random(shape)
    f = lambda x: np.ascontiguousarray(x, np.float32)
    return f(np.log(c)), f(r), f(b), f(r * (1 - b))


def signatures(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """One row of SAMPLES 16-bit samples a text; texts without words: zeros."""
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = A.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    start, end, first = A.words(data, off)
    terms, begin = A.shingles(A.word_hashes(data, start, end), first, shingle)
    log_c, rate, shift, plain = _draws()
    column = np.arange(SAMPLES)
    for d in range(len(texts)):
        mine = terms[begin[d] : begin[d + 1]]
        if not len(mine):
            continue
        term, count = np.unique(mine, return_counts=True)
        best = np.full(SAMPLES, np.inf, np.float32)
        for at in range(0, len(term), 2048):
            x, w = term[at : at + 2048], count[at : at + 2048]
            i = (x & A.U64((1 << SLOTS) - 1)).astype(np.int64)
            j = (x >> A.U64(64 - SLOTS)).astype(np.int64)
            a = log_c[i] - plain[j]
            many = np.flatnonzero(w > 1)
            t = None
            if len(many):
                r, b = rate[j[many]], shift[j[many]]
                t = np.floor(np.log(w[many]).astype(np.float32)[:, None] / r + b)
                a[many] = log_c[i[many]] - r * (t - b + 1)
            low = a.min(axis=0)
            row, col = np.nonzero(a == low)
            which = np.zeros(SAMPLES, np.int64)
            which[col[::-1]] = row[::-1]  # the first of equals
            step = np.zeros(SAMPLES, np.int64)
            if t is not None:
                place = np.searchsorted(many, which)
                hit = (place < len(many)) & (many[np.minimum(place, len(many) - 1)] == which)
                step[hit] = t[place[hit], column[hit]]
            won = low < best
            best[won] = low[won]
            kept = A.mix(x[which] + A.mix((step.astype(A.U64) << A.U64(8)) + column.astype(A.U64)))
            out[d][won] = (kept >> A.U64(48)).astype(np.uint16)[won]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, an estimate of generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def _hex(x: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in x]


def fingerprint_documents(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint string; null and empty texts: all zeros; no shuffle.

    A column already called `out` is replaced.
    """
    kept = docs.drop(out)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column(text)]
            found = [s for i in range(0, len(texts), 256) for s in _hex(signatures(texts[i : i + 256]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, widened(kept, out, "string"))


def _by_hash(rows: DataFrame, hot: dict[int, int]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The rows, those of hot ids with their texts' hash and counted where they are equal; and
    where the ranges of hot ids begin: the least hash of each of so many parts that has any.

    `hot` says how many ranges an id fills, so it is no longer than the list of ranges.
    """
    known = F.broadcast(rows.sparkSession.createDataFrame([(k, m + 1) for k, m in sorted(hot.items())], "key long, parts int"))
    named = rows.withColumn("h", F.xxhash64("text")).join(known, "key")
    part = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("parts"))
    begin = named.groupBy("key", part.alias("part")).agg(F.min("h").alias("h")).collect()
    columns = ["doc_id", "key", "h", "text"]
    counted = named.groupBy(*columns).agg(F.count("*").alias("n"))
    single = rows.join(known, "key", "left_anti").select("doc_id", "key", F.lit(0).cast("long").alias("h"), "text", F.lit(1).cast("long").alias("n"))
    return single.union(counted), [(r["key"], r["h"]) for r in begin]


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", each: int = 2000) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    Documents are dealt to ranges of ids whose bounds are ids of the table; the document at
    a bound also goes, as the last, to the range before, so that each range has its next
    document and nothing is gathered in one place.  Texts travel compressed, once.

    Ranges hold `each` documents or, of more than its square, the square root of their number,
    so that neither the bounds nor a task grow in proportion; a task holds about 1 MB of text
    at a time, and a longer document whole.

    An id that fills a range by itself (null ids, say) is cut into ranges of its texts' hashes,
    and rows of such an id with equal texts are counted before they are dealt: the next
    document of each of them but the last is an equal one.

    Ids are whole numbers.  Null texts are empty; null ids come last; rows of one id follow
    each other in a fixed order of their texts.  The next document of the last is the first
    (of a single document: itself).  An empty table gives no rows; other columns are not
    looked at.
    """
    small_batches(docs.sparkSession)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, least = rows.agg(F.count("*"), F.min("key")).first()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    count = buckets(n, max(each, isqrt(n)))
    shares = [k / count for k in range(1, count)]
    found = Counter(rows.agg(F.percentile_approx("key", shares, max(20_000, 10 * count))).first()[0])
    # an id of m bounds fills about m ranges
    hot = {k: m for k, m in found.items() if m > 1 and n > each}
    cuts = [(k, 0) for k in {least, *found} if k not in hot]
    if hot:
        rows, parts = _by_hash(rows, hot)
        cuts += parts
    else:
        rows = rows.withColumns({"h": F.lit(0).cast("long"), "n": F.lit(1).cast("long")})
    bounds = np.array(sorted(cuts), [("key", np.int64), ("h", np.int64)])
    # where each id's bounds begin, and the place of a hash among the bounds of a hot id
    first, lead = np.unique(bounds["key"], return_index=True)
    last = np.append(lead[1:], len(bounds))

    def place(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The range of each row: the last bound that isn't behind it."""
        own = np.searchsorted(first, keys, "right") - 1
        at = last[own] - 1  # of an id without a bound: the last of the bound before
        for k in np.unique(own[(first[own] == keys) & (last[own] - lead[own] > 1)]).tolist():
            of = (own == k) & (keys == first[k])
            at[of] = lead[k] + np.searchsorted(bounds["h"][lead[k] : last[k]], hashes[of], "right") - 1
        return at

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            zipped = pa.array([pack.compress((x.as_py() or "").encode()) for x in batch.column("text")], pa.binary())
            hashes = batch.column("h").to_numpy()
            at = place(keys, hashes)
            take = [np.arange(len(keys)), np.flatnonzero((bounds["key"][at] == keys) & (bounds["h"][at] == hashes))]
            row = np.concatenate(take)
            bucket = np.concatenate([at, (at[take[1]] - 1) % len(bounds)])
            tail = np.concatenate([np.zeros(len(keys), bool), np.ones(len(take[1]), bool)])
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), pa.array(tail), *(batch.column(c).take(index) for c in ("key", "h", "doc_id", "n")), zipped.take(index)],
                names=["bucket", "tail", "key", "h", "doc_id", "n", "zipped"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held: list[tuple] = []  # (bucket, tail, id, text, rows) in order; the last waits for its next

        def flush() -> Iterator[pa.RecordBatch]:
            kept = [k for k in range(len(held) - 1) if not held[k][1]]
            if not kept:
                return
            # of equal rows all but the last come before an equal one
            steps = [(k, k, held[k][4] - 1) for k in kept if held[k][4] > 1] + [(k, k + 1, 1) for k in kept]
            todo, follow = (np.array([x[c] for x in steps]) for c in (0, 1))
            texts = [x[3] for x in held]
            own = signatures([t.encode() for t in texts])
            edited = []
            for k, behind, _ in steps:
                half = len(texts[k]) // 2
                edited.append((texts[k][: len(texts[k]) - half] + texts[behind][:half]).encode())
            new = signatures(edited)
            done = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[k][2] for k in todo], id_type),
                    pa.array([len(texts[k]) for k in todo], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array(_hex(own[todo])),
                    pa.array(_hex(new)),
                    pa.array(likeness(own[todo], new)),
                    pa.array(likeness(own[todo], own[follow])),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            yield done
            for k, (_, _, times) in enumerate(steps):
                for more in range(times - 1, 0, -1000):
                    yield done.take(pa.array([k] * min(more, 1000)))

        size, id_type = 0, pa.int64()
        for batch in batches:
            id_type = batch.column("doc_id").type
            unpack = zstandard.ZstdDecompressor()
            for b, tail, i, many, z in zip(*(batch.column(c) for c in ("bucket", "tail", "doc_id", "n", "zipped")), strict=True):
                b, tail = b.as_py(), tail.as_py()
                if tail and held and held[-1][1] and held[-1][0] == b:
                    continue  # rows of one id at a bound: the first of them is next
                held.append((b, tail, i.as_py(), unpack.decompress(z.as_py()).decode(), many.as_py()))
                size += len(held[-1][3])
                if size > A.CHUNK:
                    yield from flush()
                    held[:] = held[-1:]
                    size = len(held[-1][3])
        yield from flush()

    dealt = rows.mapInArrow(deal, f"bucket int, tail boolean, key long, h long, doc_id {kind}, n long, zipped binary")
    order = dealt.repartition(count, "bucket").sortWithinPartitions("bucket", "tail", "key", "h", "zipped")
    return order.mapInArrow(run, schema)
