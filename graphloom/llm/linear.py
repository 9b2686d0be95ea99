"""Training samples, FTRL-proximal logistic regression, Bradley-Terry ranking; text features.

op7's learner sees a bounded sample (parameters `sample_docs` and `sample_bytes`); scoring is a
narrow map over all documents with the weights in the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays as A

WORDLIKE = np.ones(256, bool)  # True: between words
WORDLIKE[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)]] = False


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo `folds`; null for null ids."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, sample_docs: int, sample_bytes: int, seed: int = 7) -> DataFrame:
    """(text, label) of at most sample_docs labelled ids outside fold 0, of at most sample_bytes.

    Chosen by a hash of the id, so the choice doesn't depend on order or partitions; the first
    of them is taken even if it alone has more bytes.  Of an id with several rows the text
    of least hash counts, once; of an id labelled twice the largest label.  Rows with a
    null id, text or label are left out.
    """
    mark = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold(F.col(doc_id)) != 0))
    mark = mark.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    named = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_h"))
    ids = named.select("_id", "_h", F.octet_length("text").alias("_n")).groupBy("_id").agg(F.min(F.struct("_h", "_n")).alias("row"))
    first = ids.join(mark, "_id").select("_id", "_y", "row.*").orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(sample_docs)
    total, chosen = 0, []
    for row in first.collect():  # bounded by sample_docs
        total += row["_n"]
        if total > sample_bytes and chosen:
            break
        chosen.append((row["_id"], row["_h"], row["_y"]))
    picked = docs.sparkSession.createDataFrame(chosen, f"_id {docs.schema[doc_id].dataType.simpleString()}, _h long, label int")
    # rows that repeat an id and its text are one: joined in each task, then once more
    return named.join(F.broadcast(picked), ["_id", "_h"]).groupBy("_id", "label").agg(F.min("text").alias("text")).select("_id", "text", "label")


# --- hashed word n-grams and skip-grams -------------------------------------------------


def gram_features(data: np.ndarray, off: np.ndarray, bits: int, n: int = 2, skips: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every word n-gram up to n and every skip-gram (pairs with up to `skips` words between)."""
    start, end, first = A.words(data, off, WORDLIKE)
    h = A.word_hashes(A.LOWER[data], start, end)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    slots, owners = [A.salted(h, 1)], [doc]
    run = h
    for k in range(1, n):
        run = A.mix(run[:-1] * A.U64(0x9E3779B97F4A7C15) + h[k:]) if len(run) > 1 else run[:0]
        same = doc[: len(run)] == doc[k : k + len(run)]
        slots.append(A.salted(run, 1 + k)[same])
        owners.append(doc[: len(run)][same])
    for k in range(2, skips + 2):
        if len(h) > k:
            same = doc[:-k] == doc[k:]
            slots.append(A.salted(h[:-k] * A.U64(0x9E3779B97F4A7C15) + A.mix(h[k:]), 64 + k)[same])
            owners.append(doc[:-k][same])
    return np.concatenate(owners), (np.concatenate(slots) >> A.U64(64 - bits)).astype(np.int64)


@dataclass
class SparseWeights:
    """Non-zero weights only; small enough to travel with each task."""

    bits: int
    n: int
    skips: int
    bias: float
    slots: np.ndarray
    values: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float64)
        w[self.slots] = self.values
        return w

    def margins(self, data: np.ndarray, off: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Sum of the weights of each document's distinct features, with the bias."""
        doc, slot = gram_features(data, off, self.bits, self.n, self.skips)
        live = dense[slot] != 0
        pair = np.unique(doc[live] << self.bits | slot[live])
        return self.bias + np.bincount(pair >> self.bits, dense[pair & ((1 << self.bits) - 1)], len(off) - 1)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, n: int, skips: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int = 3, most_weight: float = 4.0) -> SparseWeights:
    """FTRL-proximal logistic regression: per-coordinate rates, L1 sparsity; binary features.

    rows: (distinct slots, label 0/1).  Rows of label 1, if rarer, weigh more, up to
    most_weight times, so that few of them are enough.  One class only or no rows: no weights, and the bias
    says how likely label 1 is.
    """
    size = 1 << bits
    z, q = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(seed)
    bias_z = bias_q = 0.0  # the bias is a coordinate without L1 penalty

    def weights(zi: np.ndarray | float, qi: np.ndarray | float, penalty: float):
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(qi)) / alpha + l2))

    ones = sum(y for _, y in rows)
    heavy = min(most_weight, max(1.0, (len(rows) - ones) / max(ones, 1)))
    if 0 < ones < len(rows):
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                at, y = rows[k]
                w, bias = weights(z[at], q[at], l1), float(weights(bias_z, bias_q, 0.0))
                g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
                g *= heavy if y else 1.0
                z[at] += g - (np.sqrt(q[at] + g * g) - np.sqrt(q[at])) / alpha * w
                q[at] += g * g
                bias_z += g - (np.sqrt(bias_q + g * g) - np.sqrt(bias_q)) / alpha * bias
                bias_q += g * g
        w, bias = weights(z, q, l1), float(weights(bias_z, bias_q, 0.0))
    else:
        w, bias = np.zeros(size), 0.0 if not rows else (4.0 if rows[0][1] else -4.0)
    live = np.flatnonzero(w)
    return SparseWeights(bits, n, skips, bias, live, w[live])


# --- dense features of form ---------------------------------------------------------------

_CLASS = np.zeros(256, np.int64)  # kinds of bytes: other, lower, upper, digit, space, line end, beyond ASCII, then each mark alone
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, 0x09]] = 4
_CLASS[[0x0A, 0x0D]] = 5
_CLASS[0x80:] = 6
_MARKS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
for _k, _c in enumerate(_MARKS):
    _CLASS[_c] = 7 + _k
N_CLASS = 7 + len(_MARKS)
N_FORM = 2 * N_CLASS + 8


def form_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of N_FORM numbers a document: shares of kinds of bytes, their roots, and word statistics."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    share = np.bincount(doc * N_CLASS + _CLASS[data], minlength=n * N_CLASS).reshape(n, N_CLASS) / np.maximum(size, 1)[:, None]
    start, end, first = A.words(data, off)
    count = np.diff(first)
    some = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    h = A.word_hashes(data, start, end)
    per = lambda x: np.bincount(owner, x, n) / some
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((h, owner))
    fresh = np.ones(len(h))
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    lone = (end - start == 1).astype(float)
    caps = (_CLASS[data[start]] == 2) & (_CLASS[data[np.minimum(start + 1, np.maximum(end - 1, 0))]] == 2) if len(start) else lone
    mark_end = (_CLASS[data[end - 1]] >= 7).astype(float) if len(start) else lone
    words = np.column_stack(
        [
            per((end - start).astype(float)) / 10,
            np.bincount(owner[order], fresh, n) / some,
            per(again),
            per(lone),
            per(caps.astype(float)),
            per(mark_end),
            np.log1p(count) / 10,
            (count == 0).astype(float),
        ]
    )
    return np.column_stack([share, np.sqrt(share), words])


def bradley_terry(x: np.ndarray, y: np.ndarray, steps: int = 400, pairs: int = 2048, rate: float = 0.05, l2: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Weights w such that w.x ranks preferred rows higher.

    Preference pairs are drawn from rows with different labels; the loss is logistic on the
    difference of their features.  Rows of one label only: zero weights.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w
    rng, m, v = np.random.default_rng(seed), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
        g = -(p @ d) / pairs + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
