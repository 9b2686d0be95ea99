"""Links between embeddings by an epsilon grid order join, exact.

Cosine at least t of two unit vectors means a distance of at most eps = sqrt(2 - 2t).  The
vectors are projected on leading principal directions, where distances can only shrink,
and sorted by the grid cells of side eps that they fall into.  The sequence is cut into
blocks; pairs of intervals of blocks are joined recursively, those whose boxes are further
apart than eps are skipped, and within two blocks the same goes on down to small leaves.
In two leaves, pairs are skipped whose cosine can't reach t: that of their projections and
the most that the rests can add, the product of their lengths.  Only pairs that pass this
bound are compared in all dimensions, in double precision; where rounding could decide,
by exactly rounded sums.

Equal vectors count once, however many they are; a pair of blocks returns, for each
vector, its number of links and one tie to its local component, never its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A
from graphloom.llm.frames import checkpointed, components, small_batches

LEAF = 256
#: Numbers in a block at most, but for one leaf: long vectors make blocks shorter.
BLOCK_VALUES = 1 << 22
#: More blocks than this make blocks larger instead: their boxes go to every task.
MOST_BOXES = 1 << 17
#: Rows of block pairs that are broadcast at most; more are joined by a shuffle.
FEW_PAIRS = 200_000
#: Two cosines closer than this are told apart by exactly rounded sums.
UNSURE = 1e-11


def principal_directions(sample: np.ndarray, most: int) -> np.ndarray:
    """Orthonormal leading directions (columns) of the sample's second moments."""
    moments = sample.T @ sample
    _, vectors = np.linalg.eigh(moments)
    return np.ascontiguousarray(vectors[:, ::-1][:, :most])


def box_distance(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(np.sqrt((gap * gap).sum()))


def near_intervals(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray, eps: float, same: bool) -> list[tuple[int, int]]:
    """Pairs (i, j) of intervals of two sequences (i <= j if they are the same) that may be
    within eps, by recursion over halves of the sequences."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(low), 0, len(low2))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d or (same and a >= d):
            continue
        if box_distance(low[a:b].min(axis=0), high[a:b].max(axis=0), low2[c:d].min(axis=0), high2[c:d].max(axis=0)) > eps:
            continue
        if b - a == 1 and d - c == 1:
            out.append((a, c))
            continue
        m, k = (a + b + 1) // 2, (c + d + 1) // 2
        stack += [(x, y, z, w) for x, y in ((a, m), (m, b)) for z, w in ((c, k), (k, d)) if x < y and z < w]
    return out


class Block:
    """Vectors with what the join needs of them: unit vectors, projections with the length of
    the rest behind them, and how many rows each stands for."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray, many: np.ndarray):
        self.raw, self.many = raw, many
        self.unit = raw.astype(np.float64)
        self.unit /= np.abs(self.unit).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        self.unit /= np.linalg.norm(self.unit, axis=1, keepdims=True)
        self.shade = self.unit @ axes
        rest = np.sqrt(np.maximum(0, 1 - (self.shade**2).sum(axis=1)))
        self.bound = np.column_stack([self.shade, rest + 1e-9])

    def __len__(self) -> int:
        return len(self.raw)


def at_least(x: np.ndarray, y: np.ndarray, t: float) -> bool:
    """Whether the cosine of two vectors is at least t, by exactly rounded sums."""
    x, y = (v.astype(np.float64) / 2.0 ** floor(np.log2(np.abs(v).max())) for v in (x, y))
    dot, xx, yy = (fsum((u * v).tolist()) for u, v in ((x, y), (x, x), (y, y)))
    return dot / (sqrt(xx) * sqrt(yy)) >= t


def close_pairs(x: Block, y: Block, a: int, b: int, c: int, d: int, t: float) -> tuple[np.ndarray, int]:
    """Which of rows a to b of x and c to d of y have a cosine of at least t; and how many pairs
    were compared in all dimensions."""
    may = x.bound[a:b] @ y.bound[c:d].T >= t - 1e-9
    seen = int(may.sum())
    cosine = np.full(may.shape, -2.0)
    if seen * 16 < may.size:
        i, j = np.nonzero(may)
        cosine[i, j] = np.einsum("ij,ij->i", x.unit[a + i], y.unit[c + j])
    else:
        cosine = x.unit[a:b] @ y.unit[c:d].T
        seen = may.size
    close = cosine >= t
    for i, j in zip(*np.nonzero(np.abs(cosine - t) < UNSURE), strict=True):
        close[i, j] = at_least(x.raw[a + i], y.raw[c + j], t)
    return close, seen


def join_blocks(x: Block, y: Block, t: float, eps: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the rows of x to the rows of y, weighed by how many rows each stands for; for
    each row the least row of its local component; and how many pairs there are, how many are
    in leaves that may be near, and how many were compared in all dimensions.

    Rows of y are numbered after those of x; if the blocks are the same, y is x.
    """
    n = len(x)
    total = n if same else n + len(y)
    links, root = np.zeros(total, np.int64), np.arange(total)
    work = np.array([n * (n - 1) // 2 if same else n * len(y), 0, 0])

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    cuts_x, cuts_y = np.arange(0, n, LEAF), np.arange(0, len(y), LEAF)
    low_x, high_x = np.minimum.reduceat(x.shade, cuts_x), np.maximum.reduceat(x.shade, cuts_x)
    low_y, high_y = np.minimum.reduceat(y.shade, cuts_y), np.maximum.reduceat(y.shade, cuts_y)
    shift = 0 if same else n
    for i, j in near_intervals(low_x, high_x, low_y, high_y, eps, same):
        a, c = i * LEAF, j * LEAF
        b, d = min(a + LEAF, n), min(c + LEAF, len(y))
        close, seen = close_pairs(x, y, a, b, c, d, t)
        work += [0, (b - a) * (d - c), seen]
        if same and i == j:
            np.fill_diagonal(close, False)
        if not close.any():
            continue
        links[a:b] += close @ y.many[c:d]
        if not (same and i == j):
            links[shift + c : shift + d] += close.T @ x.many[a:b]
        # local components of this leaf pair: least row label over links, to a fixed point
        rows, cols = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
        part = close[np.ix_(rows, cols)]
        name = np.arange(len(rows))
        while True:
            col = np.where(part, name[:, None], len(rows)).min(axis=0)
            new = np.minimum(name, np.where(part, col[None, :], len(rows)).min(axis=1))
            if (new == name).all():
                break
            name = new
        ties = [(a + rows[k], a + rows[name[k]]) for k in range(len(rows)) if name[k] != k]
        ties += [(shift + c + cols[k], a + rows[col[k]]) for k in range(len(cols))]
        for u, v in ties:
            u, v = find(int(u)), find(int(v))
            if u != v:
                root[max(u, v)] = min(u, v)
    return links, np.array([find(k) for k in range(total)], np.int64), work


KEY = "k struct<a:long,b:long>"


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", directions: int = 20, block: int = 16_384, sample: int = 4000) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; see the module.

    Null, empty and zero vectors and such with a null or non-finite component link with
    nothing, nor do vectors of different lengths.  Rows of one id are vectors of their own;
    rows with a null id link with nothing and have a null component and kept = false.  Equal
    vectors are told by 128-bit hashes.  The principal directions come from a bounded sample;
    they decide what is skipped quickly, never what links.  Blocks hold about `block` vectors,
    fewer of long ones (BLOCK_VALUES), more once there are MOST_BOXES of them.  Other columns are not looked at; an empty table
    gives no rows.
    """
    small_batches(vectors.sparkSession)
    e = F.col("e")
    kind = vectors.schema[vec_id].dataType.simpleString()
    plain = vectors.schema[embedding].dataType.simpleString() in ("array<float>", "array<double>")
    raw = vectors.select(F.col(vec_id).alias("vec_id"), (F.col(embedding) if plain else F.transform(F.col(embedding), lambda v: v.cast("double"))).alias("e"))
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    valid = F.coalesce(F.col("vec_id").isNotNull() & finite, F.lit(False))
    key = F.struct(F.xxhash64("e").alias("a"), F.xxhash64(F.lit(1), "e").alias("b"))
    rows = raw.select("vec_id", "e", valid.alias("ok"), key.alias("k"))
    classes = rows.where("ok").groupBy("k").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min_by("e", "vec_id").alias("e"))
    classes = checkpointed(classes.withColumn("dim", F.size("e")))
    parts = [
        _join_dimension(classes.where(F.col("dim") == r["dim"]), r["n"], threshold, directions, block, sample)
        for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()  # one row a vector length
    ]
    found = vectors.sparkSession.createDataFrame([], f"{KEY}, links long, tie struct<a:long,b:long>")
    for p in parts:
        found = found.union(p)
    found = checkpointed(found)
    label = components(classes.select(F.col("k").alias("id")), found.select(F.col("k").alias("a"), F.col("tie").alias("b")))
    named = classes.select("k", "least", "n").join(label.withColumnRenamed("id", "k"), "k")
    root = named.groupBy("component").agg(F.min("least").alias("component_id"))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    known = (
        named.join(root, "component").join(links, "k", "left").select("k", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    )
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast(kind).alias("component_id"))
    linked = rows.where("ok").select("vec_id", "k").join(known, "k").select("vec_id", F.col("links").alias("n_links"), "component_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _join_dimension(classes: DataFrame, n: int, t: float, directions: int, block: int, sample: int) -> DataFrame:
    """(k, links, tie) from every pair of near blocks of vectors of one length."""
    eps = sqrt(max(0.0, 2 - 2 * t)) + 1e-9
    some = np.array([r["e"] for r in classes.orderBy("k").select("e").limit(sample).collect()], np.float64)  # bounded by `sample`
    some /= np.abs(some).max(axis=1, keepdims=True)
    some /= np.linalg.norm(some, axis=1, keepdims=True)
    axes = principal_directions(some, min(directions, some.shape[1]))
    d = axes.shape[1]
    cells = ceil(2 / eps) + 2
    deep = min(d, floor(46 / np.log2(cells)))

    def places(keys: np.ndarray, shade: np.ndarray) -> np.ndarray:
        """Grid order: the number of the cell, then 16 bits of the key, which split a hot cell."""
        cell = np.clip(np.floor((shade[:, :deep] + 1) / eps), 0, cells - 1).astype(np.int64)
        place = np.zeros(len(shade), np.int64)
        for k in range(deep):
            place = place * cells + cell[:, k]
        return place << 16 | (A.mix(keys.view(np.uint64)) >> np.uint64(48)).astype(np.int64)

    def placed(b: pa.RecordBatch) -> tuple[Block, np.ndarray]:
        own = Block(_matrix(b.column("e")), axes, b.column("n").to_numpy())
        return own, places(b.column("k").field("a").to_numpy(), own.shade)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(placed(b)[1])], names=["place"])

    vectors = classes.select("k", "n", "e")
    block = min(block, max(LEAF, BLOCK_VALUES // len(some[0])))
    count = min(MOST_BOXES, max(1, -(-n // block)))
    shares = [q / count for q in range(1, count)] or [0.5]
    cut = vectors.mapInArrow(ordered, "place long").agg(F.percentile_approx("place", shares, max(20_000, 10 * count))).first()[0]
    edges = np.array(sorted(set(cut)) if count > 1 else [], np.int64)

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for b in batches:
            own, place = placed(b)
            for at in np.unique(to := np.searchsorted(edges, place, "right")).tolist():
                part = own.shade[to == at]
                low[at] = np.minimum(low.get(at, np.inf), part.min(axis=0))
                high[at] = np.maximum(high.get(at, -np.inf), part.max(axis=0))
        keys = sorted(low)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([low[k].tolist() for k in keys], pa.list_(pa.float64())), pa.array([high[k].tolist() for k in keys], pa.list_(pa.float64()))], names=["block", "low", "high"])

    # One box a block reaches the driver: at most MOST_BOXES.
    box = vectors.mapInArrow(boxed, "block int, low array<double>, high array<double>")
    sides = [F.min(F.col("low")[k]).alias(f"l{k}") for k in range(d)] + [F.max(F.col("high")[k]).alias(f"h{k}") for k in range(d)]
    boxes = box.groupBy("block").agg(*sides).orderBy("block").collect()
    names = np.array([r["block"] for r in boxes], np.int32)
    low = np.array([[r[f"l{k}"] for k in range(d)] for r in boxes]) - 1e-9
    high = np.array([[r[f"h{k}"] for k in range(d)] for r in boxes]) + 1e-9

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, i, j): the block takes part in the pair i, j; pairs that may be near only."""
        for b in batches:
            for k in b.column("id").to_pylist():
                other = [j for _, j in near_intervals(low[k : k + 1], high[k : k + 1], low[k:], high[k:], eps, False)]
                i, j = np.full(len(other), names[k]), names[k:][other]
                goes, stays = np.concatenate([i, j[j != names[k]]]), np.concatenate([np.arange(len(i)), np.flatnonzero(j != names[k])])
                yield pa.RecordBatch.from_arrays([pa.array(goes), pa.array(i[stays]), pa.array(j[stays])], names=["block", "i", "j"])

    partner = checkpointed(classes.sparkSession.range(len(names)).mapInArrow(met, "block int, i int, j int"))
    if partner.count() <= FEW_PAIRS:
        partner = F.broadcast(partner)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("block", pa.array(np.searchsorted(edges, placed(b)[1], "right").astype(np.int32)))

    kind = classes.schema["e"].dataType.simpleString()
    sent = vectors.mapInArrow(dealt, f"{KEY}, n long, e {kind}, block int").join(partner, "block")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        at, key = table.column("block").to_numpy(), table.column("k").combine_chunks()
        a, b = key.field("a").to_numpy(), key.field("b").to_numpy()
        every = Block(_matrix(table.column("e")), axes, table.column("n").to_numpy())
        order = np.lexsort((b, a, places(a, every.shade)))

        def part(number: int) -> tuple[Block, np.ndarray]:
            pick = order[at[order] == number]
            one = Block.__new__(Block)
            one.raw, one.many, one.unit, one.shade, one.bound = (v[pick] for v in (every.raw, every.many, every.unit, every.shade, every.bound))
            return one, pick

        (x, own), (y, other) = part(i), part(j)
        links, root, _ = join_blocks(x, y, t, eps, i == j)
        rows = own if i == j else np.concatenate([own, other])
        some = np.flatnonzero(links > 0)
        return pa.table({"k": key.take(pa.array(rows[some])), "links": links[some], "tie": key.take(pa.array(rows[root[some]]))})

    return sent.groupBy("i", "j").applyInArrow(compare, f"{KEY}, links long, tie struct<a:long,b:long>")
