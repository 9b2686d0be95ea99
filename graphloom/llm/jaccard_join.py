"""Exact Jaccard similarity join of word-shingle sets by universe partition and pigeonhole.

Sets are banded by size.  In a band, shingles are hashed to m segments, a little more than
the H + 1 that two sets of Jaccard similarity t can't all differ in (H: their largest
symmetric difference).  So of any H + 1 non-empty segments of a set one is whole in every
partner.  A set indexes its non-empty segments in its own band and in those of larger
partners, and probes with those of its own band; empty ones, which would match half the
band, are never keys.  A set with fewer than H + 1 non-empty ones also gives the
one-deletion neighbourhoods of its segments, whose two allowed differences make up for them
(two such sets can only miss each other there); one for which even that is too little gives
each shingle.

Equal sets count once from the first task on.  Keys that few sets share give all pairs
with a probe; a key that many share gives pairs with one pivot, so that a large group of
near copies costs pairs in its size.  Allocation by cost: any H + 1 probes of a set are
enough, so as many common keys as it has probes beyond those are left out, wherever all
links verified so far leave a key's sets in different components.  Only sets with more such
keys than that stay open.  They are compared with all that share those keys, cut into blocks
bounded in sets and shingles: two blocks meet in a task, their intersections are a matrix
product, and the task returns as many ties as it joins components, never the links.  No
link is lost and no group's pairs are written.  Every link is verified on the whole sets.

Sets go by 63-bit names; a second, independent hash of every set is compared within each
name, and if two sets ever shared one, all names are made again with another salt.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import arrays as A
from graphloom.llm.frames import buckets, checkpointed, components, small_batches, tidied
from graphloom.llm.repeats import _by_target, _rows, joined, packed

#: A key with more pairs than this uses a pivot first.
PIVOT_PAIRS = 12
#: Sets and shingles in a block, about, and shingles in one step of the matrix product.
BLOCK, BLOCK_SHINGLES, STEP = 2048, 1 << 20, 1024
#: Ratio of one bin of sizes.
BIN = 1.02
#: Buckets that one copy of a text is sent for.
SENDS = 64
#: Parts of a hot group's rows in a join by its key.
SALTS = 32


class Bands:
    """Size bands for similarity at least num/den, with H and m of each."""

    def __init__(self, num: int, den: int, largest: int, ratio: float = 1.6):
        self.num, self.den = num, den
        low = [1]
        while low[-1] <= largest * den // num + 1:
            low.append(max(low[-1] + 1, int(low[-1] * ratio)))
        self.low = np.array(low[:-1], np.int64)
        high = np.array(low[1:], np.int64) - 1
        self.h = 2 * high * (den - num) // (den + num)
        self.m = np.array([ceil((h + 1) * 1.2) + 2 for h in self.h], np.int64)

    def own(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def last(self, size: np.ndarray) -> np.ndarray:
        """The last band that has a possible partner: of size at most size * den / num."""
        return np.searchsorted(self.low, size * self.den // self.num, "right") - 1


def document_sets(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document and where they begin (n + 1)."""
    data = A.LOWER[data]
    start, end, first = A.words(data, off)
    h, begin = A.shingles(A.word_hashes(data, start, end), first, shingle)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(begin))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(off)))


def set_ids(h: np.ndarray, begin: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name of each set, even (the last bit is free); 0 for empty sets."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(A.salted(h, 21 + 1000 * salt), dtype=np.uint64)])
    n = np.diff(begin)
    name = A.mix((sums[begin[1:]] - sums[begin[:-1]]) + n.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return np.where(n > 0, np.maximum(name & ~np.uint64(1), np.uint64(2)), np.uint64(0))


def size_bins(size: np.ndarray) -> np.ndarray:
    """Number, modulo 256, of the logarithmic bin of each size; sets of one key differ by far less than 128 bins."""
    return (np.floor(np.log(np.maximum(size, 1)) / np.log(BIN)).astype(np.int64) % 256).astype(np.uint8)


def signatures(h: np.ndarray, begin: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, flag) of all sets in all their bands; flag: 0 for keys that are only indexed,
    else 1 and how many of the set's probes may be left out (at most 254)."""
    size = np.diff(begin)
    own, last = bands.own(size), bands.last(size)
    some = np.flatnonzero(size)
    who, band = A.spread(own[some], last[some] + 1)
    who = some[who]  # one entry a set and band
    entry, at = A.spread(begin[who], begin[who + 1])
    x, b = h[at], band[entry]
    seg = ((A.mix(x + A.mix(b.astype(np.uint64) + np.uint64(77))) >> np.uint64(20)) % bands.m[b].astype(np.uint64)).astype(np.int64)
    order = np.argsort(entry * int(bands.m.max() + 1) + seg, kind="stable")
    entry, seg, value = entry[order], seg[order], A.salted(x[order], 22)
    fresh = np.ones(len(entry), bool)
    fresh[1:] = (entry[1:] != entry[:-1]) | (seg[1:] != seg[:-1])
    head = np.flatnonzero(fresh)
    n_seg = np.diff(np.append(head, len(entry)))
    total = np.add.reduceat(value, head) if len(head) else value
    e, s = entry[head], seg[head]
    place = A.mix(band[e].astype(np.uint64) * np.uint64(0x100000001B3) + s.astype(np.uint64) + np.uint64(5))
    key = A.mix(total + place)
    need = bands.h[band] + 1
    full = np.bincount(e, minlength=len(who))
    flag = np.where(band[e] == own[who[e]], np.clip(full - need, 0, 254)[e] + 1, 0).astype(np.uint8)
    out_set, out_key, out_flag = [who[e]], [key], [flag]
    short = full < need
    if short.any():
        part = np.cumsum(fresh) - 1  # segment of each element
        pick = np.flatnonzero(short[entry] & (n_seg[part] > 1))
        out_set.append(who[entry[pick]])
        out_key.append(A.salted(A.mix(total[part[pick]] - value[pick] + place[part[pick]]), 23))
        own_key = np.flatnonzero(short[e])
        out_set.append(who[e[own_key]])
        out_key.append(A.salted(key[own_key], 23))
        twice = np.bincount(e, n_seg > 1, len(who)).astype(np.int64)
        none = short & (full + twice < need)
        pick = np.flatnonzero(none[entry])
        out_set.append(who[entry[pick]])
        out_key.append(A.salted(value[pick] + band[entry[pick]].astype(np.uint64), 24))
        out_flag += [np.ones(len(k), np.uint8) for k in out_key[1:]]
    return np.concatenate(out_set), np.concatenate(out_key), np.concatenate(out_flag)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of the sets of `left` (rows) and `right` (columns), exact."""
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    value = np.concatenate([*left, *right, np.zeros(0, np.uint64)])
    _, number = np.unique(value, return_inverse=True)
    sides = [np.bincount(number[pick], minlength=int(number.max(initial=-1)) + 1) > 0 for pick in (owner < len(left), owner >= len(left))]
    both = sides[0] & sides[1]  # others are in no intersection
    place = np.cumsum(both) - 1
    keep = both[number]
    number, owner = place[number[keep]], owner[keep]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(both.sum()), STEP):
        a, b = np.searchsorted(number, [at, at + STEP])
        hit = np.zeros((len(left) + len(right), STEP), np.float32)
        hit[owner[a:b], number[a:b] - at] = 1
        out += hit[: len(left)] @ hit[len(left) :].T
    return out


def merged_components(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component, the least one that it becomes part of) of rows `left` and columns `right`
    after joining those that `close` links; only such as move."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    row, col = at[: len(left)], at[len(left) :]
    label = np.arange(len(names))
    some = np.flatnonzero(close.any(axis=1))
    close, row = close[some], row[some]
    while True:
        before = label
        own, far = label[row], np.full(len(col), len(names))
        for k in range(0, len(row), 256):  # bounds what is copied
            part = close[k : k + 256]
            own[k : k + 256] = np.minimum(own[k : k + 256], np.where(part, label[col], len(names)).min(axis=1))
            far = np.minimum(far, np.where(part, own[k : k + 256, None], len(names)).min(axis=0))
        label = label.copy()
        np.minimum.at(label, row, own)
        np.minimum.at(label, before[row], own)
        np.minimum.at(label, col, far)
        np.minimum.at(label, before[col], far)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _sets(members: DataFrame) -> DataFrame:
    """Distinct sets: name (id), least document, size; `two` if the name stands for two sets."""
    same = F.min("check") != F.max("check")
    return members.where("n_shingles > 0").groupBy(F.col("set_id").alias("id")).agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("size"), same.alias("two"))


def _salted(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Join of many rows a key with one row a key, the rows of a hot key dealt to SALTS parts."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", salt).join(spread, [key, "_salt"]).drop("_salt")


def similarity_classes(docs: DataFrame, num: int = 80, den: int = 100, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).

    Two documents link when den * |intersection| >= num * |union| of their distinct shingles
    of lower-cased (A-Z) words; fewer words than a shingle make one shingle.  Documents
    without words or text (null) link with nothing.  Rows that repeat an id or a null id
    are documents of their own; a component of null ids only has a null component_id.  Very
    long texts are read whole, alone in their chunk.  Other columns are not looked at, so
    their names can't clash; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    total = rows.count()
    n_bucket, n_target = buckets(total), buckets(total, 5000)

    def named(salt: int) -> DataFrame:
        """Each document's set: its name, size and, under `check`, a second hash; with the first of each name in a task its compressed text."""

        def member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            press, seen = zstandard.ZstdCompressor(level=3), set()
            for batch in batches:
                names, checks, sizes, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
                for _, _, d, o in A.chunks(*A.flat(batch.column("text"))):
                    h, begin = document_sets(d, o, shingle)
                    names.append(set_ids(h, begin, salt))
                    checks.append(set_ids(h, begin, salt + 500))
                    sizes.append(np.diff(begin))
                    for k, n in enumerate(names[-1].tolist()):
                        texts.append(press.compress(d[o[k] : o[k + 1]].tobytes()) if n and n not in seen else None)
                        seen.add(n)
                    if len(seen) > 1_000_000:
                        seen.clear()
                name = np.concatenate(names)
                bucket = (name % np.uint64(n_bucket)).astype(np.int32)
                columns = [batch.column("doc_id"), pa.array(name.view(np.int64)), pa.array(np.concatenate(checks).view(np.int64)), pa.array(np.concatenate(sizes)), pa.array(bucket), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set_id", "check", "n_shingles", "bucket", "zipped"])

        return checkpointed(rows.mapInArrow(member, f"doc_id {kind}, set_id long, check long, n_shingles long, bucket int, zipped binary"))

    salt = 0
    members = named(salt)
    while not (sets := checkpointed(_sets(members))).where("two").isEmpty():
        salt += 1
        members = named(salt)
    largest = sets.agg(F.max("size")).first()[0] or 1
    bands = Bands(num, den, int(largest))
    most_bins = ceil(log(den / num) / log(BIN))  # sets in bins further apart can't link

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            key, name, flag, bins = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            high = key >> np.uint64(24)  # 40 bits beside the target's
            target = ((key & np.uint64(0xFFFFFF)) % np.uint64(n_target)).astype(np.int64)
            pairs = list(_by_target(target, n_target, (high & np.uint64(0xFFFFFFFF)).astype(np.uint32), (high >> np.uint64(32)).astype(np.uint8), name, flag, bins))
            return _rows("target", pairs)

        for batch in batches:
            for _, _, d, o in A.chunks(*A.flat(batch.column("text"))):
                h, begin = document_sets(d, o, shingle)
                names = set_ids(h, begin, salt)
                new = [k for k, n in enumerate(names.tolist()) if n and n not in seen and not seen.add(n)]
                if len(seen) > 1_000_000:
                    seen.clear()
                new_at = np.array(new, np.int64)
                _, at = A.spread(begin[new_at], begin[new_at + 1])
                sizes = np.diff(begin)[new_at]
                who, key, flag = signatures(h[at], np.concatenate([[0], np.cumsum(sizes)]), bands)
                held.append((key, names[new_at][who], flag, size_bins(sizes)[who]))
                size += len(key)
                if size > max(1 << 21, 64 * n_target):
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def candidates(table: pa.Table) -> pa.Table:
        low, high, ids, flag, bins = joined(table.column("blob").to_pylist(), "u4 u1 u8 u1 u1")
        key = high.astype(np.uint64) << np.uint64(32) | low
        order = np.lexsort((flag, ids, key))
        key, ids, flag, bins = key[order], ids[order], flag[order], bins[order]
        keep = np.ones(len(key), bool)  # of a set that comes from several tasks, the last: as probe if any is
        keep[:-1] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids, flag, bins = key[keep], ids[keep], flag[keep], bins[keep]
        probe = flag > 0
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(key)))
        n_probe = np.add.reduceat(probe.astype(np.int64), head) if len(head) else size
        live = (size > 1) & (n_probe > 0)
        many = live & (n_probe * (size - 1) > PIVOT_PAIRS)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # places of pairs
        small = np.flatnonzero(live & ~many)
        owner, left = A.spread(head[small], head[small] + size[small])
        owner, left = owner[probe[left]], left[probe[left]]
        again, right = A.spread(head[small][owner], (head + size)[small][owner])
        a.append(left[again])
        b.append(right)
        big = np.flatnonzero(many)
        owner, at = A.spread(head[big], head[big] + size[big])
        a.append(head[big][owner])
        b.append(at)
        x, y = np.concatenate(a), np.concatenate(b)
        apart = (bins[x] - bins[y]).astype(np.int8)  # numbers of bins are known modulo 256
        near = np.abs(apart.astype(np.int64)) <= most_bins
        x, y = ids[x[near]], ids[y[near]]
        pair = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)])[x != y], axis=0)
        x, y = np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])
        kinds = [(k, raw, 0) for k, raw in _by_target((x % np.uint64(n_bucket)).astype(np.int64), n_bucket, x, y)]
        if len(big):
            group = (key[head[big]][owner] << np.uint64(16)) ^ np.uint64(int(table.column("target")[0].as_py()))
            kinds.append((0, packed(group, ids[at], flag[at]), 1))
        return pa.table({"bucket": pa.array([k for k, _, _ in kinds], pa.int32()), "blob": pa.array([r for _, r, _ in kinds], pa.binary()), "kind": pa.array([q for _, _, q in kinds], pa.int32())})

    found = checkpointed(rows.mapInArrow(index, "target int, blob binary").groupBy("target").applyInArrow(candidates, "bucket int, blob binary, kind int"))

    texts = members.where("zipped IS NOT NULL").select("bucket", "set_id", "zipped").groupBy("bucket")

    def unzipped(raws: list[bytes]) -> list[np.ndarray]:
        """The sets of the texts, in bounded chunks."""
        out, open_ = [], zstandard.ZstdDecompressor()
        part: list[bytes] = []

        def flush() -> None:
            off = np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int64)
            h, begin = document_sets(np.frombuffer(b"".join(part), np.uint8), off, shingle)
            out.extend(h[begin[k] : begin[k + 1]] for k in range(len(part)))
            part.clear()

        for raw in raws:
            part.append(open_.decompress(raw))
            if sum(map(len, part)) > A.CHUNK:
                flush()
        if part:
            flush()
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) of those pairs (bucket of the first, blob) that link."""

        def ask(table: pa.Table) -> pa.Table:
            x, y = joined(table.column("blob").to_pylist(), "u8 u8")
            pair = np.unique(np.column_stack([x, y]), axis=0)
            x, y = np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])
            to = (y % np.uint64(n_bucket)).astype(np.int64)
            want = np.unique(np.column_stack([x, to.astype(np.uint64)]), axis=0)
            out = [(int(table.column("bucket")[0].as_py()), packed(np.ascontiguousarray(want[:, 0]), np.ascontiguousarray(want[:, 1])), 0)]
            out += [(k, raw, 1) for k, raw in _by_target(to, n_bucket, x, y)]
            return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()), "blob": pa.array([o[1] for o in out], pa.binary()), "kind": pa.array([o[2] for o in out], pa.int32())})

        asked = pairs.groupBy("bucket").applyInArrow(ask, "bucket int, blob binary, kind int")

        def send(left: pa.Table, right: pa.Table) -> pa.Table:
            name, to = joined(right.column("blob").to_pylist(), "u8 u8")
            ids = left.column("set_id").to_numpy().view(np.uint64) if len(left) else np.zeros(0, np.uint64)
            order = np.argsort(ids, kind="stable")
            at = order[np.searchsorted(ids[order], name)] if len(name) else np.zeros(0, np.int64)
            raw = left.column("zipped")
            # one copy for as many as SENDS buckets; the copies themselves are made one at a time, by explode
            turn = np.lexsort((to, name))
            name, to, at = name[turn], to[turn].astype(np.int32), at[turn]
            begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
            ends = np.append(begin, len(name))
            owner, _ = A.spread(np.zeros(len(begin), np.int64), -(-np.diff(ends) // SENDS))
            part = np.arange(len(owner)) - np.searchsorted(owner, owner)
            low = begin[owner] + part * SENDS
            high = np.minimum(low + SENDS, ends[owner + 1])
            blobs = [packed(name[a : a + 1], np.frombuffer(raw[int(at[a])].as_py(), np.uint8)) for a in low]
            return pa.table({"to": pa.array([to[a:b] for a, b in zip(low, high, strict=True)], pa.list_(pa.int32())), "blob": pa.array(blobs, pa.binary())})

        sent = texts.cogroup(asked.where("kind = 0").groupBy("bucket")).applyInArrow(send, "to array<int>, blob binary")
        sent = sent.select(F.explode("to").alias("bucket"), "blob", F.lit(2).alias("kind"))

        def test(left: pa.Table, right: pa.Table) -> pa.Table:
            what = np.array(right.column("kind").to_pylist(), np.int64)
            blobs = right.column("blob").to_pylist()
            x, y = joined([b for b, k in zip(blobs, what, strict=True) if k == 1], "u8 u8")
            came = [joined([b], "u8 u1") for b, k in zip(blobs, what, strict=True) if k == 2]
            guests = dict(zip([int(name[0]) for name, _ in came], unzipped([raw.tobytes() for _, raw in came]), strict=True))
            ids = left.column("set_id").to_numpy().view(np.uint64) if len(left) else np.zeros(0, np.uint64)
            hosts, at = np.unique(ids, return_index=True)
            need = np.unique(y)
            raws = left.column("zipped")
            host_sets = dict(zip(need.tolist(), unzipped([raws[int(i)].as_py() for i in at[np.searchsorted(hosts, need)]]), strict=True)) if len(need) else {}
            order = np.argsort(x, kind="stable")
            keep = []
            for k in order.tolist():
                mine, other = guests[int(x[k])], host_sets[int(y[k])]
                if min(len(mine), len(other)) * den < num * max(len(mine), len(other)):
                    continue
                place = np.searchsorted(mine, other)
                both = int((mine[np.minimum(place, len(mine) - 1)] == other).sum())
                if den * both >= num * (len(mine) + len(other) - both):
                    keep.append(k)
            return pa.table({"a": pa.array(x[keep].view(np.int64)), "b": pa.array(y[keep].view(np.int64))})

        told = asked.where("kind = 1").union(sent)
        return checkpointed(texts.cogroup(told.groupBy("bucket")).applyInArrow(test, "a long, b long"))

    def across(unsettled: DataFrame) -> DataFrame:
        """(a, b): ties between components, as between the open sets of a cluster and all its sets.

        unsettled(id, component, first, open, size): a cluster is what shares keys with one first
        set, so the keys of a large group of near copies make one cluster, and chance keys don't chain.
        """
        parts = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
        chosen = F.col("open").cast("long")
        grid = unsettled.groupBy("first").agg(parts(F.sum(chosen), F.sum(chosen * F.col("size"))).alias("rows"), parts(F.count("*"), F.sum("size")).alias("columns"))
        placed = _salted(unsettled, grid, "first").withColumn("h", F.xxhash64("id"))
        row, column = F.pmod("h", F.col("rows")).cast("int"), F.pmod("h", F.col("columns")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = placed.where("open").withColumns({"i": row, "j": every("columns"), "side": F.lit(0)})
        right = placed.where("rows > 0").withColumns({"j": column, "i": every("rows"), "side": F.lit(1)})
        asks = left.unionByName(right).select("id", "component", F.xxhash64("first", "i", "j").alias("task"), "side")
        keyed = asks.mapInArrow(keyed_by_bucket, "bucket int, id long, component long, task long, side int")

        def deliver(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, at = np.unique(left.column("set_id").to_numpy() if len(left) else np.zeros(0, np.int64), return_index=True)
            want = right.column("id").to_numpy() if len(right) else np.zeros(0, np.int64)
            take = pa.array(at[np.searchsorted(ids, want)]) if len(want) else pa.array([], pa.int64())
            return right.drop_columns(["bucket"]).append_column("zipped", left.column("zipped").take(take))

        sent = texts.cogroup(keyed.groupBy("bucket")).applyInArrow(deliver, "id long, component long, task long, side int, zipped binary")

        def compare(table: pa.Table) -> pa.Table:
            ids, comp, side = (table.column(c).to_numpy() for c in ("id", "component", "side"))
            own = unzipped(table.column("zipped").to_pylist())
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            size = np.array([len(x) for x in own], np.int64)
            both = shared_counts([own[k] for k in left], [own[k] for k in right])
            close = np.empty(both.shape, bool)
            for k in range(0, len(left), 256):  # (num + den) * shared >= num * (sum of sizes), in whole numbers
                part = both[k : k + 256].astype(np.int64)
                close[k : k + 256] = (num + den) * part >= num * (size[left[k : k + 256]][:, None] + size[right][None, :])
            moved, to = merged_components(close, comp[left], comp[right])
            order = np.argsort(comp, kind="stable")
            name = lambda c: ids[order[np.searchsorted(comp[order], c)]]  # noqa: E731  one set of the component
            return pa.table({"a": name(moved), "b": name(to)})

        return checkpointed(sent.groupBy("task").applyInArrow(compare, "a long, b long"))

    def keyed_by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = (b.column("id").to_numpy().view(np.uint64) % np.uint64(n_bucket)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *b.columns], names=["bucket", *b.schema.names])

    tidied(docs.sparkSession)
    edges = verified(found.where("kind = 0").select("bucket", "blob"))
    tidied(docs.sparkSession)
    label = components(sets, edges)

    shared = found.where("kind = 1")
    if not shared.isEmpty():

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column("blob").to_pylist():
                    group, name, flag = joined([raw], "u8 u8 u1")
                    yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), pa.array(name.view(np.int64)), pa.array(flag.astype(np.int32))], names=["group", "id", "flag"])

        label = checkpointed(label)
        inside = shared.select("blob").mapInArrow(opened, "group long, id long, flag int").join(label, "id")
        mixed = inside.groupBy("group").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("id").alias("first"), F.count("*").alias("many")).where("x <> y")
        bad = checkpointed(_salted(inside, mixed.select("group", "first", "many"), "group"))
        # a set leaves out the commonest of these keys, flag - 1 of them (of a short set, flag 1: none)
        own = Window.partitionBy("id", "flag")
        ranked = bad.where("flag > 0").select("group", "id", "flag", "first", F.row_number().over(own.orderBy(F.desc("many"), "group")).alias("rank"))
        asked = checkpointed(ranked.where("rank >= flag").select("group", "id", "first", F.lit(True).alias("open")))
        if not asked.isEmpty():
            # keys that share open sets share a cluster: twice, the least name among the keys of its open sets
            cluster = asked.withColumnRenamed("first", "cluster")
            for _ in range(2):
                by_set = cluster.groupBy("id").agg(F.min("cluster").alias("cluster"))
                by_key = cluster.select("group", "id").join(by_set, "id").groupBy("group").agg(F.min("cluster").alias("cluster"))
                cluster = cluster.select("group", "id").join(by_key, "group")
            near = _salted(bad.drop("first"), by_key.withColumnRenamed("cluster", "first"), "group").join(asked.drop("first"), ["group", "id"], "left")
            near = near.groupBy("id", "first").agg(F.first("component").alias("component"), F.coalesce(F.max("open"), F.lit(False)).alias("open"))
            label = components(sets, edges.union(across(checkpointed(near.join(sets.select("id", "size"), "id")))))
    least = sets.join(label, "id").select("id", "component", "least")
    root = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(root, "component").select(F.col("id").alias("set_id"), "component_id")
    return (
        members.where("n_shingles > 0").join(named, "set_id").select("doc_id", "n_shingles", "component_id")
        .union(members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )
