"""Quality by Bradley-Terry pairwise ranking and a threshold at a score quantile."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A
from graphloom.llm.frames import shared_folder, small_batches, with_scores
from graphloom.llm.linear import N_FORM, fold, form_features
from graphloom.operators.similarity import exact_quantiles


@dataclass
class Ranking:
    """Weights of standardised features, and the ranking score that separates good from bad."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float  # the probability that the threshold is mapped to

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Ranking scores mapped to (0, 1), the threshold to `cut`."""
        s = ((form_features(data, off) - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(s + np.log(self.cut / (1 - self.cut)), -35, 35)))


#: Rows of one group of preference pairs, about, and how many of the rarer label come to each group at least.
GROUP_ROWS, RARE_ROWS = 5_000, 64


def _arrow_rows(column) -> np.ndarray:
    """Binary values of N_FORM numbers each as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, N_FORM)


def _learning_rows(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str) -> DataFrame:
    """(_id, y, x) of every id labelled 0 or 1 outside fold 0; ids repeated as in sample_rows."""
    mark = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold(F.col(doc_id)) != 0))
    mark = mark.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("y")).where("y IN (0, 1)")
    named = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull() & (fold(F.col(doc_id)) != 0))
    named = named.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = A.flat(batch.column("text"))
            x = [r.tobytes() for _, _, d, o in A.chunks(data, off) for r in form_features(d, o)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_h"), pa.array(x, pa.binary())], names=["_id", "_h", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return named.mapInArrow(run, f"_id {kind}, _h long, x binary").join(mark, "_id").groupBy("_id", "y").agg(F.min(F.struct("_h", "x")).alias("first")).select("_id", "y", "first.x")


def _summed(rows: DataFrame, column: str, part) -> np.ndarray:
    """The sum of part(matrix) over all rows; tasks add up first, the driver gets at most 32 sums."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(_arrow_rows(batch.column(column)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    def together(some: pa.Table) -> pa.Table:
        found = [np.frombuffer(x) for x in some.sort_by("task").column("sum").to_pylist()]
        return pa.table({"task": pa.array([some.column("task")[0].as_py()], pa.int32()), "sum": pa.array([np.sum(found, axis=0).tobytes()], pa.binary())})

    sums = rows.select(column).mapInArrow(each, "sum binary").withColumn("task", F.spark_partition_id())
    met = sums.groupBy(F.col("task") % 32).applyInArrow(lambda some: together(some.select(["task", "sum"])), "task int, sum binary")
    return np.sum([np.frombuffer(r["sum"]) for r in sorted(met.collect(), key=lambda r: r["task"])], axis=0)


def _pairs(rows: DataFrame, scale: np.ndarray, n: int, rare: int, n_rare: int) -> DataFrame:
    """d: what the standardised features of a good row have more than those of a bad one.

    Rows are dealt to groups by their ids, those of the rarer label to as many as each group needs
    for RARE_ROWS of them; in a group each row of the larger side meets one of the other, in turn.
    """
    groups = -(-n // GROUP_ROWS)
    copies = min(groups, -(-RARE_ROWS * groups // n_rare))
    at = F.when(F.col("y") == rare, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("h", F.xxhash64("_id")).withColumn("at", F.explode(at))
    dealt = dealt.select(F.pmod(F.pmod(F.col("h"), F.lit(groups)) + F.col("at"), F.lit(groups)).alias("group"), "h", "y", "x")

    def meet(some: pa.Table) -> pa.Table:
        x, y = _arrow_rows(some.column("x")), some.column("y").to_numpy()
        order = np.lexsort((y, some.column("h").to_numpy()))
        good, bad = order[y[order] == 1], order[y[order] == 0]
        k = np.arange(max(len(good), len(bad)) if len(good) and len(bad) else 0)
        d = (x[good[k % len(good)]] - x[bad[k % len(bad)]]) / scale if len(k) else np.zeros((0, N_FORM))
        return pa.table({"d": pa.array([r.tobytes() for r in d], pa.binary())})

    return dealt.groupBy("group").applyInArrow(meet, "d binary")


def _ranked(pairs: DataFrame, l2: float = 1e-4, rounds: int = 40) -> np.ndarray:
    """Bradley-Terry weights over all pairs by Newton's method, steps halved where the loss would rise."""
    size = N_FORM
    w = old = step = np.zeros(size)
    best = np.inf
    for _ in range(rounds):

        def part(d: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            m = np.clip(d @ w, -35, 35)
            p = 1 / (1 + np.exp(m))
            return np.concatenate([[len(d), np.log1p(np.exp(-m)).sum()], -(p @ d), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        found = _summed(pairs, "d", part)
        n, loss = found[0], found[1] / found[0] + l2 / 2 * (w @ w)
        if loss > best + 1e-12:
            step = step / 2
        else:
            old, best = w, loss
            gradient, curve = found[2 : 2 + size] / n + l2 * w, found[2 + size :].reshape(size, size) / n
            step = -np.linalg.solve(curve + l2 * np.eye(size), gradient)
        w = old + step
        if np.abs(step).max() < 1e-5:
            break
    return old


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", cut: float = 0.3) -> Ranking:
    """Ranking learnt from preference pairs in which every labelled row outside fold 0 takes part.

    The features of these rows and their pairs are written once; the driver gets sums only.  The
    threshold is the quantile of all their scores at their share of label 0, in the middle of
    the gap there.  Labels of one kind or none: every document gets the same side.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}"
    _learning_rows(docs, labels, label, doc_id, text).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(count) < 2:
        side = 1.0 if not count or 1 in count else -1.0
        return Ranking(np.zeros(N_FORM), np.ones(N_FORM), np.zeros(N_FORM), -4 * side, cut)
    n = sum(count.values())
    mean = _summed(rows, "x", lambda x: x.sum(axis=0)) / n
    scale = np.sqrt(_summed(rows, "x", lambda x: ((x - mean) ** 2).sum(axis=0)) / n) + 1e-3
    rare = min(count, key=lambda y: (count[y], y))
    _pairs(rows, scale, n, rare, count[rare]).write.parquet(f"{path}/pairs")
    w = _ranked(spark.read.parquet(f"{path}/pairs"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((_arrow_rows(batch.column("x")) - mean) / scale @ w)], names=["s"])

    rows.select("x").mapInArrow(score, "s double").write.parquet(f"{path}/scores")
    threshold = exact_quantiles(spark.read.parquet(f"{path}/scores"), "s", [(count[0] - 0.5) / (n - 1)])[0]
    return Ranking(mean, scale, w, threshold, cut)


def score_quality(docs: DataFrame, model: Ranking, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score in (0, 1), at least `cut` for good ones; null texts count as empty."""
    return with_scores(docs, text, out, lambda data, off: model.scores(data, off))
