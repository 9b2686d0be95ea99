"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import arrays as A
from graphloom.llm.frames import small_batches, with_scores
from graphloom.llm.linear import SparseWeights, ftrl, gram_features, sample_rows

BITS = 20


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    sample_docs: int = 12_000,
    sample_bytes: int = 48 << 20,
    epochs: int = 5,
    alpha: float = 1.0,
    l1: float = 20.0,
) -> SparseWeights:
    """Weights learnt from a bounded sample of the labelled rows outside fold 0.

    The rows' distinct features are made where the texts lie; one task gets those of at most
    sample_docs rows with at most sample_bytes of text and learns, and the driver gets the
    non-zero weights.  No labelled rows: no weights.
    """
    small_batches(docs.sparkSession)
    rows = sample_rows(docs, labels, label, doc_id, text, sample_docs, sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = A.flat(batch.column("text"))
            out: list[bytes] = []
            for i, j, d, o in A.chunks(data, off):
                doc, slot = gram_features(d, o, BITS)
                pair = np.unique(doc << BITS | slot)
                cut = np.searchsorted(pair >> BITS, np.arange(j - i + 1))
                low = (pair & ((1 << BITS) - 1)).astype(np.int32)
                out += [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), pa.array(out, pa.binary()), pa.array(np.zeros(len(out), np.int32))], names=["id", "y", "x", "all"])

    def learn(table: pa.Table) -> pa.Table:
        rows = zip(table.column("id").to_pylist(), table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True)
        seen = [(np.frombuffer(x, np.int32), y) for _, x, y in sorted(rows)]  # the same model whatever the partitions
        model = ftrl(seen, BITS, 2, 1, alpha, 1.0, l1, 0.0, epochs)
        return pa.table({"bias": [model.bias], "slots": pa.array([model.slots.tolist()], pa.list_(pa.int64())), "weights": pa.array([model.values.tolist()], pa.list_(pa.float64()))})

    kind = docs.schema[doc_id].dataType.simpleString()
    features = rows.mapInArrow(run, f"id {kind}, y int, x binary, all int")
    found = features.groupBy("all").applyInArrow(learn, "bias double, slots array<long>, weights array<double>").collect()
    if not found:
        return ftrl([], BITS, 2, 1, alpha, 1.0, l1, 0.0, epochs)
    return SparseWeights(BITS, 2, 1, found[0]["bias"], np.array(found[0]["slots"], np.int64), np.array(found[0]["weights"], float))


def score_toxicity(docs: DataFrame, model: SparseWeights, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1; null and empty texts get that of no features."""

    def score(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not hasattr(model, "_dense"):
            model._dense = model.dense()
        return 1 / (1 + np.exp(-np.clip(model.margins(data, off, model._dense), -35, 35)))

    return with_scores(docs, text, out, score)
