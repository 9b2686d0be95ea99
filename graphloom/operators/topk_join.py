"""The k nearest within groups by bounds: cells around pivots, visited only where they can hold a neighbour.

Unit vectors of a group go to the cell of their closest pivot.  The triangle inequality of
angles bounds what a vector can score in another cell: the cosine of its angle to the pivot
less the cell's radius.  A first pass meets each block of a cell with itself, which gives each
vector a lower bound of its k-th score; then a vector is sent only to cells whose bound
reaches that score and the threshold.  Blocks are kept in bins, and a vector is sent once to each bin with
the blocks that it visits there, so what is sent doesn't grow with the number of cells.
Vectors that are equal are searched once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ordered import top_k
from graphloom.session import scratch

#: Cosines are rounded to 6 digits, and bounds have rounding errors of their own.
SLACK = 1e-5
_CELL = ["group", "dim", "cell"]
_BLOCK = [*_CELL, "block"]
_BIN = ["group", "dim", "bin"]
#: Blocks of a group meet their visitors in so many bins, and in more only if a bin would have more than `BIN_ROWS` vectors.
BINS, BIN_ROWS = 16, 32_768


def _matrix(column):
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _placed(vectors: DataFrame, group: str, key: str, embedding: str, n_keys: int, cell_rows: int, most_cells: int, task_rows: int) -> tuple[DataFrame, DataFrame]:
    """(members: group, dim, rep, key; classes of equal vectors with their unit vector, cell, angle and block), both written."""
    import numpy as np
    import pyarrow as pa

    spark, path = vectors.sparkSession, scratch(vectors.sparkSession)
    rows = vectors.select(F.col(group).cast("string").alias("group"), F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("group IS NOT NULL AND key IS NOT NULL AND size(v) > 0").where(~odd)
    rows.groupBy("group", "key").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    least = top_k(rows, n_keys, ["group", "v"], [F.asc("key")])
    classes = least.groupBy("group", "dim", "v").agg(F.sort_array(F.collect_list("key")).alias("keys")).withColumn("rep", F.col("keys")[0])
    classes.write.parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    rows.join(classes.select("group", "v", "rep"), ["group", "v"]).select("group", "dim", "rep", "key").write.parquet(f"{path}/members")

    sizes = classes.groupBy("group", "dim").agg(F.count("*").alias("n"))
    cells = F.least(F.lit(most_cells), F.ceil(F.col("n") / cell_rows)).cast("int")
    sizes = sizes.withColumns({"cells": cells, "salts": F.ceil(F.col("n") / task_rows).cast("int")})
    sized = classes.join(sizes, ["group", "dim"])
    pivots = sized.where("cells > 1").where(F.pmod(F.xxhash64("rep"), F.col("n")) < F.col("cells"))
    spread = sized.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("salts")).cast("int"))
    pivots.select("group", "dim", "salts", F.col("rep").alias("pivot"), "v").write.parquet(f"{path}/pivots")
    pivots = spark.read.parquet(f"{path}/pivots")
    copied = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    kind = vectors.schema[key].dataType.simpleString()

    def unit(v):
        x = _matrix(v)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.where(length == 0, 0.0, x / np.where(length == 0, 1.0, length))

    def place(some: pa.Table, centres: pa.Table) -> pa.Table:
        x = unit(some.column("v"))
        cell, angle = np.zeros(len(x), np.int32), np.full(len(x), np.pi)
        c = unit(centres.sort_by("pivot").column("v")) if len(centres) else np.zeros((0, x.shape[1]))
        c = c[c.any(axis=1)]
        if len(c):
            cosine = x @ c.T
            cell = cosine.argmax(axis=1).astype(np.int32)
            angle = np.arccos(np.clip(cosine[np.arange(len(x)), cell], -1, 1))
        zero = ~x.any(axis=1)
        cell[zero], angle[zero] = -1, 0.0  # scores 0 whatever it meets
        flat = pa.array(x.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
        kept = {name: some.column(name) for name in ("group", "dim", "rep", "keys", "v")} if len(some) else {}
        return pa.table({**kept, "unit": lists, "cell": pa.array(cell), "angle": pa.array(angle)}) if kept else _nothing(schema)

    fields = f"group string, dim int, rep {kind}, keys array<{kind}>, v array<double>, unit array<double>, cell int, angle double"
    schema = _arrow(classes.select("group", "dim", "rep", "keys", "v", F.col("v").alias("unit"), F.lit(0).alias("cell"), F.lit(0.0).alias("angle")))
    found = spread.select("group", "dim", "salt", "rep", "keys", "v").groupBy("group", "dim", "salt").cogroup(copied.groupBy("group", "dim", "salt")).applyInArrow(place, fields)
    found.write.parquet(f"{path}/cells")
    found = spark.read.parquet(f"{path}/cells")
    blocks = found.groupBy(*_CELL).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("blocks"))
    found.join(blocks, _CELL).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int")).write.parquet(f"{path}/placed")
    return spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/placed")


def _arrow(df: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def _nothing(schema):
    return schema.empty_table()


def _searched(placed: DataFrame, k: int, threshold: float, cell_rows: int, task_rows: int) -> tuple[DataFrame, DataFrame]:
    """(group, dim, src, keys, score of every hit; group, dim, cell, block, rep, unit of every visit to another block)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from graphloom.operators.similarity import _best

    spark, path = placed.sparkSession, scratch(placed.sparkSession)
    kind = placed.schema["rep"].dataType.simpleString()

    def scored(q, x):
        return np.round(q @ x.T, 6)

    def own(table: pa.Table) -> pa.Table:
        """A block with itself: the k nearest classes of each, and the score that others have to reach."""
        table = table.sort_by("rep")
        x, n_keys = _matrix(table.column("unit")), np.array([len(s) for s in table.column("keys").to_pylist()])
        score = scored(x, x)
        i, j = _best(score, k)
        order = np.lexsort((j, -score[i, j], i))
        i, j = i[order], j[order]
        hits, needs = [[] for _ in x], np.full(len(x), threshold, float)
        seen = np.zeros(len(x), int)
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            hits[a].append({"dst": b, "score": float(score[a, b])})
            if seen[a] < k <= seen[a] + n_keys[b]:
                needs[a] = max(threshold, score[a, b])
            seen[a] += n_keys[b]
        keys = table.column("keys").to_pylist()
        hits = [[{"keys": keys[h["dst"]], "score": h["score"]} for h in some] for some in hits]
        kept = {c: table.column(c) for c in ("group", "dim", "cell", "block", "blocks", "rep", "unit", "angle", "keys")}
        return pa.table({**kept, "need": pa.array(needs), "hits": pa.array(hits, hit_type)})

    hit_type = pa.list_(pa.struct([("keys", _arrow(placed.select("keys")).field("keys").type), ("score", pa.float64())]))
    fields = f"group string, dim int, cell int, block int, blocks int, rep {kind}, unit array<double>, angle double, keys array<{kind}>, need double, hits array<struct<keys:array<{kind}>,score:double>>"
    placed.groupBy(*_BLOCK).applyInArrow(own, fields).write.parquet(f"{path}/own")
    met = spark.read.parquet(f"{path}/own")

    # --- which cells each class must visit
    # a cell's direction is its pivot, which is the member at no angle to it; of equal ones the least
    centre = F.min_by("unit", F.struct("angle", "rep"))
    about = met.groupBy(*_CELL).agg(F.max("angle").alias("radius"), F.min("angle").alias("nearest"), centre.alias("centre"), F.max("blocks").alias("blocks"))
    n = F.count("*")
    bins = F.greatest(F.least(F.lit(BINS), F.ceil(n / F.lit(cell_rows))), F.ceil(n / F.lit(BIN_ROWS))).cast("int")
    sizes = met.groupBy("group", "dim").agg(F.ceil(n / task_rows).cast("int").alias("salts"), bins.alias("bins"))
    about.join(sizes, ["group", "dim"]).write.parquet(f"{path}/about")
    copied = spark.read.parquet(f"{path}/about").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    spread = met.join(sizes, ["group", "dim"]).withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("salts")).cast("int"))

    def route(some: pa.Table, cells: pa.Table) -> pa.Table:
        if not len(some):
            return _nothing(routed)
        x, c = _matrix(some.column("unit")), _matrix(cells.column("centre"))
        number, radius, blocks = (cells.column(n).to_numpy() for n in ("cell", "radius", "blocks"))
        # the direction taken is within `nearest` of the pivot, so the radius around it is at most this
        radius = radius + cells.column("nearest").to_numpy()
        bound = np.cos(np.maximum(0.0, np.arccos(np.clip(x @ c.T, -1, 1)) - radius[None, :]))
        bound[:, number == -1] = 0.0
        bound[some.column("cell").to_numpy() == -1] = 0.0
        visit = bound + SLACK >= some.column("need").to_numpy()[:, None]
        # every block of a visited cell but the own one, by bins
        at = np.repeat(np.arange(len(number)), blocks)
        cell, block = number[at].astype(np.int64), np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        visit = visit[:, at]
        visit &= (some.column("cell").to_numpy()[:, None] != cell[None, :]) | (some.column("block").to_numpy()[:, None] != block[None, :])
        code, home = (cell << 32) + block, (cell + block) % cells.column("bins")[0].as_py()
        found = []
        for b in np.unique(home):
            inside = np.flatnonzero(home == b)
            who = np.flatnonzero(visit[:, inside].any(axis=1))
            row, j = np.nonzero(visit[np.ix_(who, inside)])
            to = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(who) + 1)), pa.int32()), pa.array(code[inside][j], pa.int64()))
            kept = {n: some.column(n).take(pa.array(who)) for n in ("group", "dim", "rep", "unit")}
            found.append(pa.table({**kept, "bin": pa.array(np.full(len(who), b), pa.int32()), "to": to}))
        return pa.concat_tables(found) if found else _nothing(routed)

    fields = f"group string, dim int, rep {kind}, unit array<double>, bin int, to array<long>"
    routed = _arrow(spark.createDataFrame([], fields))
    inputs = spread.select("group", "dim", "salt", "cell", "block", "rep", "unit", "need")
    went = inputs.groupBy("group", "dim", "salt").cogroup(copied.groupBy("group", "dim", "salt")).applyInArrow(route, fields)
    to = went.select("group", "dim", F.explode("to").alias("to"), "rep", "unit")
    visits = to.select("group", "dim", F.shiftright("to", 32).cast("int").alias("cell"), F.col("to").bitwiseAND((1 << 32) - 1).cast("int").alias("block"), "rep", "unit")

    # --- a bin's classes come first, those that visit it stream past
    none = F.lit(None)
    code = F.shiftleft(F.col("cell").cast("long"), 32) + F.col("block")
    home = F.pmod(F.col("cell") + F.col("block"), F.col("bins")).cast("int").alias("bin")
    held = met.join(sizes, ["group", "dim"]).select("group", "dim", home, F.lit(0).alias("side"), "rep", "unit", "keys", F.array(code).alias("to"))
    sent = went.select(*_BIN, F.lit(1).alias("side"), "rep", "unit", none.cast(f"array<{kind}>").alias("keys"), "to")
    ordered = held.union(sent).repartition(*_BIN).sortWithinPartitions(*_BIN, "side")

    def visited(batches):
        at, waiting, x, keys, names, edge, column_of = None, [], None, None, None, None, None
        for batch in batches:
            n = batch.num_rows
            changed = np.zeros(max(n - 1, 0), bool)
            for name in (*_BIN, "side"):
                column = batch.column(name)
                changed |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.flatnonzero(changed) + 1, [n]]) if n else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                place = tuple(batch.column(name)[int(a)].as_py() for name in _BIN)
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if place != at:
                    at, waiting, x = place, [], None
                if part.column("side")[0].as_py() == 0:
                    waiting.append(part)
                    continue
                if x is None:
                    table = pa.concat_tables(waiting)
                    table = table.set_column(table.schema.get_field_index("side"), "code", table.column("to").combine_chunks().flatten()).sort_by([("code", "ascending"), ("rep", "ascending")])
                    x, order = _matrix(table.column("unit")), pc.sort_indices(table.column("rep"))
                    keys, column_of = table.column("keys").combine_chunks().take(order), np.argsort(order.to_numpy())  # ties go to the lesser key
                    names, first = np.unique(table.column("code").to_numpy(), return_index=True)
                    edge, waiting = [*first.tolist(), len(x)], []
                size = max(1, min(1000, 4_000_000 // len(x)))
                for i in range(0, len(part), size):
                    some = part.slice(i, size)
                    q, to = _matrix(some.column("unit")), some.column("to").combine_chunks()
                    visit = np.zeros((len(q), len(names)), bool)
                    owner = np.repeat(np.arange(len(q)), pc.list_value_length(to).to_numpy(zero_copy_only=False))
                    visit[owner, np.searchsorted(names, to.flatten().to_numpy())] = True
                    score = np.full((len(q), len(x)), -np.inf)
                    for j in np.flatnonzero(visit.any(axis=0)):
                        who = np.flatnonzero(visit[:, j])
                        score[np.ix_(who, column_of[edge[j] : edge[j + 1]])] = scored(q[who], x[edge[j] : edge[j + 1]])
                    q, j = _best(score, k)
                    where = pa.array(q, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [some.column(c).combine_chunks().take(where) for c in ("group", "dim", "rep")] + [keys.take(pa.array(j, pa.int64())), pa.array(score[q, j])],
                        names=["group", "dim", "src", "keys", "score"],
                    )

    far = ordered.mapInArrow(visited, f"group string, dim int, src {kind}, keys array<{kind}>, score double")
    near = met.select("group", "dim", F.col("rep").alias("src"), F.explode("hits").alias("hit")).select("group", "dim", "src", "hit.keys", "hit.score")
    return near.unionByName(far), visits


def topk_edges(
    vectors: DataFrame, group: str, key: str, embedding: str, k: int = 5, threshold: float = 0.82, cell_rows: int = 1000, most_cells: int = 1024, task_rows: int = 10_000
) -> DataFrame:
    """src, dst, score within each group: dst is among the k nearest of src, src < dst, score >= threshold.

    As `similar_edges`, with pairs of far cells left out; ties in score go to the lesser key.
    Rows without group, key or vector, empty vectors and vectors with a null or non-finite
    component aren't compared; a zero vector scores 0, vectors of other lengths don't meet.
    A key with several vectors in a group stands for its least one.  A task holds one block of
    about `cell_rows` vectors, or `task_rows` vectors with the group's pivots.
    """
    members, placed = _placed(vectors, group, key, embedding, k + 1, cell_rows, most_cells, task_rows)
    hits, _ = _searched(placed, k + 1, threshold, cell_rows, task_rows)
    pairs = hits.where(F.col("score") >= threshold).select("group", "dim", "src", "score", F.explode("keys").alias("dst"))
    best = top_k(pairs, k + 1, ["group", "dim", "src"], [F.desc("score"), F.asc("dst")])
    lists = best.groupBy("group", "dim", F.col("src").alias("rep")).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "dst"))).alias("near"))
    own = members.join(lists, ["group", "dim", "rep"]).withColumn("near", F.expr(f"slice(filter(near, x -> x.dst <> key), 1, {int(k)})"))
    found = own.select(F.col("key").alias("src"), F.explode("near").alias("x")).select("src", "x.dst", (-F.col("x.less")).alias("score"))
    return found.where("src < dst")


def pairs_met(vectors: DataFrame, group: str, key: str, embedding: str, k: int = 5, threshold: float = 0.82, cell_rows: int = 1000, most_cells: int = 1024, task_rows: int = 10_000) -> DataFrame:
    """One row: `compared` pairs of different vectors (in each direction, with themselves) of `pairs` in the groups."""
    _, placed = _placed(vectors, group, key, embedding, k + 1, cell_rows, most_cells, task_rows)
    _, visits = _searched(placed, k + 1, threshold, cell_rows, task_rows)
    blocks = placed.groupBy(*_BLOCK).agg(F.count("*").alias("n"))
    gone = visits.groupBy(*_BLOCK).agg(F.count("*").alias("came"))
    met = blocks.join(gone, _BLOCK, "left").agg(F.sum(F.col("n") * (F.col("n") + F.coalesce("came", F.lit(0)))).alias("compared"))
    every = placed.groupBy("group", "dim").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    return met.unionByName(every, allowMissingColumns=True).agg(F.max("compared").alias("compared"), F.max("pairs").alias("pairs"))
