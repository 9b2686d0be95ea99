"""Similar pairs inside groups, nearest neighbours, thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.vectors import dot
from graphloom.operators.ordered import top_k
from graphloom.session import scratch


def similar_edges(vectors: DataFrame, group: str, key: str, embedding: str, k: int = 5, threshold: float = 0.82, block_rows: int = 2000) -> DataFrame:
    """src, dst, score within each group: dst is among the k nearest of src, src < dst, score >= threshold.

    A group is cut into blocks; two blocks meet once, as a matrix product that gives the k
    nearest in either direction, and those are merged.  Ties in score go to the lesser key.
    Rows without group, key or vector, vectors with a null and vectors of another length aren't
    compared; a zero vector scores 0.
    """
    import numpy as np
    import pyarrow as pa

    unit = vectors.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(embedding).alias("v"))
    unit = unit.where("group IS NOT NULL AND key IS NOT NULL AND v IS NOT NULL").withColumn("dim", F.size("v"))
    sizes = unit.groupBy("group", "dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n"))
    placed = unit.join(sizes, ["group", "dim"]).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("n")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = placed.select("group", "dim", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "key", "v")
    kinds = {c: met.schema[c].dataType.simpleString() for c in ("group", "key")}

    def near(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).astype(float)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(length == 0, 1.0, length)
        keys, mine = table.column("key").combine_chunks(), table.column("mine").to_numpy()
        low, high = (np.flatnonzero(mine == table.column(c)[0].as_py()) for c in ("low", "high"))
        ids = keys.dictionary_encode().indices.to_numpy()
        found = []
        for a, b in [(low, high)] + [(high, low)] * (not np.array_equal(low, high)):
            for a in _steps(a, len(b)):
                score = np.nan_to_num(np.round(x[a] @ x[b].T, 6), nan=-np.inf)
                score[ids[a][:, None] == ids[b][None, :]] = -np.inf
                if score.size:
                    i, j = _best(score, k)
                    found.append((a[i], b[j], score[i, j]))
        src, dst, score = (np.concatenate(f) if found else np.zeros(0, t) for f, t in zip(list(zip(*found, strict=True)) or [[], [], []], (int, int, float), strict=True))
        column = lambda c, at: table.column(c).combine_chunks().take(pa.array(at, pa.int64()))
        return pa.table({"group": column("group", src), "src": keys.take(pa.array(src, pa.int64())), "dst": keys.take(pa.array(dst, pa.int64())), "score": pa.array(score, pa.float64())})

    pairs = met.groupBy("group", "dim", "low", "high").applyInArrow(near, f"group {kinds['group']}, src {kinds['key']}, dst {kinds['key']}, score double")
    best = top_k(pairs, k, ["group", "src"], [F.desc("score"), F.asc("dst")])
    return best.where((F.col("score") >= threshold) & (F.col("src") < F.col("dst"))).select("src", "dst", "score")


def nearest(vectors: DataFrame, query: list[float], key: str, embedding: str, k: int, skip: object = None) -> DataFrame:
    """The k vectors of greatest inner product with a query vector; the query travels as a literal."""
    q = F.array(*[F.lit(float(v)) for v in query])
    rows = vectors.select(key, F.round(dot(F.col(embedding), q), 6).alias("score"))
    if skip is not None:
        rows = rows.where(F.col(key) != skip)
    return rows.orderBy(F.desc("score"), F.asc(key)).limit(k)


#: Numbers in a matrix that a worker makes at once, however long a block, a batch or a list of cells is.
HELD = 500_000


def _rows_held(width: int, most: int) -> int:
    """Rows of a matrix so wide that make at most `HELD` numbers; 1 to `most`."""
    return max(1, min(most, HELD // max(1, width)))


def _steps(rows, width: int):
    """Shares of an array of rows, each for a matrix so wide."""
    step = _rows_held(width, max(1, len(rows)))
    return [rows[i : i + step] for i in range(0, len(rows), step)]


def coarse_cells(n: int) -> int:
    """Cells of a coarse quantiser for n vectors: the root of n, 4 to 4096."""
    return max(4, min(4096, int(n**0.5)))


def _closest(x, centres):
    """Number of the centre of greatest inner product of each row, in bounded steps."""
    import numpy as np

    step = _rows_held(len(centres), 1000)
    parts = [(x[i : i + step] @ centres.T).argmax(axis=1) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, int)


def probes_for(x, ids, centres, recall: float, k: int, queries: int = 1000, seed: int = 1) -> int:
    """Least number of cells a query must visit for that share of its true k nearest among x.

    All cells are visited if x has too few rows to tell.
    """
    import numpy as np

    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    cell, ranks = _closest(x, centres), []
    asked = np.random.default_rng(seed).permutation(len(x))[:queries]
    for i in range(0, len(asked), 100):
        q = asked[i : i + 100]
        score = np.round(x[q] @ x.T, 6)
        score[ids[q][:, None] == ids[None, :]] = -np.inf
        near = np.argsort(-score, axis=1, kind="stable")[:, :k]
        place = np.argsort(np.argsort(-(x[q] @ centres.T), axis=1, kind="stable"), axis=1)
        ranks.append(np.take_along_axis(place, cell[near], axis=1)[np.isfinite(np.take_along_axis(score, near, axis=1))])
    found = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, int)
    return int(found[int(np.ceil(recall * len(found))) - 1]) + 1 if len(found) else len(centres)


def assign_cells(
    vectors: DataFrame, key: str, embedding: str, seed: int = 1, sample: int = 20_000, recall: float = 0.95, k: int = 10
) -> tuple[DataFrame, list[list[float]], int]:
    """(vectors with their cell, centroids, probes): k-means on a bounded sample, every row indexed.

    Centroids are at most 4096; each vector goes to the one of greatest inner product.
    A null vector has no cell.  Probes are as many cells as queries need for `recall` of their k nearest: among all
    rows up to twice the sample, beyond that among as many rows as the sample has that the
    centroids were not fitted on.  An empty table has no centroids and no probes.
    """
    import numpy as np

    n = vectors.count()
    some = vectors.select(key, embedding).where(F.col(embedding).isNotNull() & F.col(key).isNotNull()).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(2 * sample)
    held = some.toArrow().combine_chunks()  # bounded by `sample`; numbers, not Python objects
    if not len(held):
        return vectors.withColumn("cell", F.lit(None).cast("int")), [], 0
    lists = held.column(embedding).combine_chunks()
    every, ids = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1).astype(float), held.column(key).to_numpy()
    x = every[:sample] / np.maximum(np.linalg.norm(every[:sample], axis=1, keepdims=True), 1e-12)
    cells = min(coarse_cells(n), len(x))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(8):
        near = _closest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = np.bincount(near, minlength=cells) > 0
        centres[full] = sums[full] / np.maximum(np.linalg.norm(sums[full], axis=1, keepdims=True), 1e-12)
    unseen = slice(sample if n > 2 * sample else 0, None)
    probes = probes_for(every[unseen], ids[unseen], centres, recall, k, seed=seed)

    @F.pandas_udf("int")
    def cell(v):
        import pandas as pd

        out = pd.Series([None] * len(v), dtype="Int32")
        some = v.notna().to_numpy()
        if some.any():
            out[some] = _closest(np.stack(v[some].to_numpy()), centres).astype("int32")
        return out

    return vectors.withColumn("cell", cell(F.col(embedding))), centres.tolist(), probes


def probe(indexed: DataFrame, centroids: list[list[float]], probes: int, query: list[float], key: str, embedding: str, k: int) -> DataFrame:
    """Nearest neighbours among the vectors of the cells next to the query."""
    import numpy as np

    best = np.argsort(-(np.array(centroids) @ np.array(query)), kind="stable")[:probes]
    return nearest(indexed.where(F.col("cell").isin([int(c) for c in best])), query, key, embedding, k)


def vector_index(vectors: DataFrame, key: str, embedding: str, path: str, dimension: int, allowed: DataFrame | None = None, flat: int = 100_000) -> dict:
    """Writes the vectors of one dimension, and of the allowed keys if given, as Parquet with the cells
    of a coarse quantiser if there are more than `flat`; returns what `nearest_of_all` needs and how many were left out."""
    rows = vectors.where(F.col(key).isNotNull() & (F.size(embedding) == dimension)).select(key, embedding)
    if allowed is not None:
        rows = rows.join(allowed.select(key).distinct(), key, "left_semi")
    n, total = rows.count(), vectors.count()
    cells = assign_cells(rows, key, embedding) if n > flat else (rows.withColumn("cell", F.lit(0)), [], 0)
    cells[0].write.mode("overwrite").parquet(path)
    return {"cells": (vectors.sparkSession.read.parquet(path), cells[1], cells[2]), "rows": n, "skipped": total - n}


def _best(score, k: int):
    """Column numbers of the k greatest scores of each row, -1 where there are fewer; of equal ones the first columns."""
    import numpy as np

    k = min(k, score.shape[1])
    least = np.partition(score, -k, axis=1)[:, -k][:, None]
    more, tie = score > least, score == least
    pick = (more | tie & (np.cumsum(tie, axis=1) <= k - more.sum(axis=1, keepdims=True))) & (score > -np.inf)
    return np.nonzero(pick)


def nearest_of_all(
    vectors: DataFrame, key: str, embedding: str, k: int, every: int = 20, cells: tuple[DataFrame, list[list[float]], int] | None = None, block_rows: int = 20_000, block_queries: int = 250
) -> DataFrame:
    """query_id, key, score: the k rows of greatest inner product of each row whose key is divisible by `every`.

    A query meets all rows but those of its own key, or, with `cells` as assign_cells gives
    them, the rows of the cells that it probes.  Scores are rounded to 6 digits, ties go to
    the lesser key.  Rows without key or vector take no part.  Rows are sent once, to
    blocks of whole cells or shares of large ones; a task holds one block at a time and the
    queries that reach it stream past, at most `block_queries` at a time and fewer past a
    long block, each giving k rows a block.
    """
    import heapq

    import numpy as np
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc

    rows, centroids, probes = cells or (vectors.withColumn("cell", F.lit(0)), [], 0)
    centres = np.array(centroids)
    rows = rows.where(F.col(key).isNotNull() & F.col(embedding).isNotNull()).select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("v"), "cell", F.xxhash64(key).alias("at"))
    size = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most one row a cell
    total = sum(size.values())
    n_block = max(32, -(-total // block_rows))
    share = max(1, -(-total // (2 * n_block)))
    shares = sorted(((-(-n // -(-n // share)), c) for c, n in size.items() for _ in range(-(-n // share))), reverse=True)
    heap, homes = [(0, b) for b in range(n_block)], {c: [] for c in size}
    for n, c in shares:
        held, b = heapq.heappop(heap)
        homes[c].append(b)
        heapq.heappush(heap, (held + n, b))
    blocks_of = {c: sorted(set(h)) for c, h in homes.items()}
    kind = vectors.schema[key].dataType.simpleString()
    matrix = lambda column: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    @F.pandas_udf("int")
    def home(cell, at):
        return pd.Series([homes[c][h % len(homes[c])] for c, h in zip(cell, at)], dtype="int32")

    def asked(batches):
        for batch in batches:
            step = _rows_held(max(len(centres), n_block), 500)
            for i in range(0, batch.num_rows, step):
                some = pa.Table.from_batches([batch.slice(i, step)])
                near = np.argsort(-(matrix(some.column("v")) @ centres.T), axis=1, kind="stable")[:, :probes].tolist() if probes else [[0]] * len(some)
                row, block, visits = [], [], []
                for j, visited in enumerate(near):
                    by_block: dict[int, list[int]] = {}
                    for c in visited:
                        for b in blocks_of.get(c, ()):
                            by_block.setdefault(b, []).append(c)
                    row += [j] * len(by_block)
                    block += by_block
                    visits += by_block.values()
                at = pa.array(row, pa.int64())
                yield from pa.table({"block": pa.array(block, pa.int32()), "key": some.column("key").take(at), "v": some.column("v").take(at), "visited": pa.array(visits, pa.list_(pa.int32()))}).combine_chunks().to_batches()

    def met(batches):
        """Rows of a block come before its queries."""
        block, waiting, x, ids, cell, edge, by_id = None, [], None, None, None, None, None

        def ready():
            nonlocal x, ids, cell, edge, by_id, waiting
            table = pa.Table.from_batches(waiting).sort_by([("cell", "ascending"), ("key", "ascending")])
            x, ids, cell = matrix(table.column("v")), table.column("key").to_numpy(), table.column("cell").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            by_id = np.argsort(ids, kind="stable")
            waiting = []

        def answers(some: pa.RecordBatch) -> pa.RecordBatch:
            q, q_ids = matrix(pa.Table.from_batches([some]).column("v")), some.column("key").to_numpy(zero_copy_only=False)
            if pc.min(pc.list_value_length(some.column("visited"))).as_py() == len(edge) - 1:  # all cells of the block
                score = np.round(q @ x.T, 6)
            else:
                visitors: dict[int, list[int]] = {}
                for j, visited in enumerate(some.column("visited").to_pylist()):
                    for c in visited:
                        visitors.setdefault(c, []).append(j)
                score = np.full((len(q), len(ids)), -np.inf)
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    if who := visitors.get(int(cell[a])):
                        score[who, a:b] = np.round(q[who] @ x[a:b].T, 6)
            score = score[:, by_id]
            score[q_ids[:, None] == ids[by_id][None, :]] = -np.inf
            j, c = _best(score, k)
            return pa.RecordBatch.from_arrays([pa.array(q_ids[j]), pa.array(ids[by_id][c]), pa.array(score[j, c])], names=["query_id", "key", "score"])

        for batch in batches:
            places = batch.column("block").to_numpy()
            sides = batch.column("side").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (sides[1:] != sides[:-1]), [True]]))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if places[a] != block:
                    block, waiting, x = places[a], [], None
                part = batch.slice(a, b - a)
                if sides[a] == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    ready()
                if x is not None:
                    step = _rows_held(len(ids), block_queries)
                    for i in range(0, part.num_rows, step):
                        yield answers(part.slice(i, step))

    none = F.lit(None)
    held = rows.select(home("cell", "at").alias("block"), F.lit(0).alias("side"), "key", "v", "cell", none.cast("array<int>").alias("visited"))
    queries = rows.where(F.col("key") % every == 0).select("key", "v").mapInArrow(asked, f"block int, key {kind}, v array<double>, visited array<int>")
    sent = held.union(queries.select("block", F.lit(1).alias("side"), "key", "v", none.cast("int").alias("cell"), "visited"))
    ordered = sent.repartition(n_block, "block").sortWithinPartitions("block", "side")
    near = ordered.mapInArrow(met, f"query_id {kind}, key {kind}, score double")
    return top_k(near, k, ["query_id"], [F.desc("score"), F.asc("key")]).select("query_id", F.col("key").alias(key), "score")


def exact_quantiles(values: DataFrame, column: str, points: list[float], buckets: int = 1024, held: int = 10_000) -> list[float | None]:
    """Exact quantiles (linear between neighbours, as quantile_cont) by refining histograms.

    A pass counts, within each interval that holds a wanted rank, the values of `buckets` equal
    parts with their least and greatest; the part with the rank is the next interval, until it
    has one value or at most `held` rows, which are sorted.  The driver gets at most
    `buckets` rows an interval, no task sorts or holds the values.  Nulls and NaN are left out.
    """
    rows = values.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    n, low, high = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(points)
    ranks = sorted({r for p in points for r in (int((n - 1) * p), min(int((n - 1) * p) + 1, n - 1))})
    known: dict[int, float] = {}
    open_ = [(low, high, 0, n, ranks)]  # least, greatest, rows below, rows, ranks in it
    while open_:
        wide = []
        for a, b, below, count, inside in open_:
            if a == b:
                known.update({r: a for r in inside})
            elif count <= held:
                found = sorted(r["x"] for r in rows.where(F.col("x").between(a, b)).collect())  # at most `held`
                known.update({r: found[r - below] for r in inside})
            else:
                wide.append((a, b, below, inside))
        if not wide:
            break
        part = reduce(lambda e, w: e.when(F.col("x").between(w[1][0], w[1][1]), F.lit(w[0])), enumerate(wide), F)
        place = reduce(lambda e, w: e.when(F.col("k") == w[0], F.least(F.floor((F.col("x") / 2 - w[1][0] / 2) / (w[1][1] / 2 - w[1][0] / 2) * buckets), F.lit(buckets - 1))), enumerate(wide), F)
        counts = rows.withColumn("k", part).where("k IS NOT NULL").withColumn("b", place).groupBy("k", "b").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("z"))
        by_interval: dict[int, list] = {}
        for r in counts.collect():  # at most `buckets` an interval
            by_interval.setdefault(r["k"], []).append((r["b"], r["n"], r["a"], r["z"]))
        open_ = []
        for k, (_, _, below, inside) in enumerate(wide):
            for _, count, a, z in sorted(by_interval[k]):
                mine = [r for r in inside if below <= r < below + count]
                if mine:
                    open_.append((a, z, below, count, mine))
                below += count
    out = []
    for p in points:
        at = (n - 1) * p
        a, b = known[int(at)], known[min(int(at) + 1, n - 1)]
        out.append(a + (b - a) * (at - int(at)))
    return out


def score_profile(scores: DataFrame, score: str, threshold: float, points: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: exact percentiles (linear), mean, share at or above the threshold, count; no task sees all scores.

    The scores are written once and read in each of the few passes.
    """
    spark = scores.sparkSession
    path = scratch(spark)
    scores.select(score).write.parquet(path)
    held = spark.read.parquet(path)
    cuts = [F.lit(q).cast("double").alias(f"p{round(100 * p)}") for p, q in zip(points, exact_quantiles(held, score, list(points)), strict=True)]
    return held.agg(F.avg(score).alias("mean"), F.avg((F.col(score) >= threshold).cast("int")).alias("share"), F.count(score).alias("n")).select(*cuts, "mean", "share", "n")
