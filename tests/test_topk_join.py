"""The top-k join by bounds against a plain loop, and what it leaves out."""

import numpy as np
import pytest

from graphloom.operators import topk_join

SCHEMA = "g int, k int, v array<double>, score string"


def plain(rows, k, threshold):
    """(src, dst, score) by comparing all pairs; a key stands for its least vector."""
    kept = {}
    for g, key, v in rows:
        if g is not None and key is not None and v and all(x is not None and np.isfinite(x) for x in v):
            kept[g, key] = min(kept.get((g, key), v), v)
    want = set()
    for (g, a), v in kept.items():
        near = []
        for (h, b), w in kept.items():
            if h == g and b != a and len(v) == len(w):
                n = np.linalg.norm(v) * np.linalg.norm(w)
                near.append((-round(float(np.dot(v, w) / n), 6) if n else 0.0, b))
        want |= {(a, b, -s + 0.0) for s, b in sorted(near)[:k] if -s >= threshold and a < b}
    return want


def close(got, want):
    """Equal pairs; scores may differ by their last digit."""
    got = {(r["src"], r["dst"]): r["score"] for r in got}
    assert set(got) == {w[:2] for w in want}
    assert all(abs(got[w[:2]] - w[2]) <= 2e-6 for w in want)


def clustered(n, dim, clusters, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return centres[rng.integers(0, clusters, n)] + rng.normal(scale=spread, size=(n, dim))


def frame(spark, rows):
    return spark.createDataFrame([(g, k, v, "clash") for g, k, v in rows], SCHEMA)


@pytest.mark.parametrize("threshold", [0.82, 0.2, -1.0])
def test_against_all_pairs(spark, threshold):
    rng = np.random.default_rng(3)
    x = clustered(240, 6, 9, 0.2, 3)
    rows = [(int(g), k, [float(f) for f in v]) for k, (g, v) in enumerate(zip(rng.integers(0, 2, 240), x, strict=True))]
    rows += [(0, 1000 + i, rows[0][2]) for i in range(12)]  # equal vectors, more than k
    rows += [(0, 2000, [0.0] * 6), (0, 2001, [0.0] * 6), (1, 2002, [0.0] * 6)]
    rows += [(0, 3, [9.0] * 6), (0, 3, [9.0] * 6), (0, 2003, [1.0]), (0, 2004, [2.0])]
    rows += [(None, 3000, [1.0] * 6), (0, None, [1.0] * 6), (0, 3001, None), (0, 3002, []), (0, 3003, [None] * 6), (0, 3004, [float("nan")] * 6), (0, 3005, [float("inf")] + [0.0] * 5)]
    got = topk_join.topk_edges(frame(spark, rows), "g", "k", "v", 4, threshold, cell_rows=15, task_rows=40).collect()
    assert len(got) == len({(r["src"], r["dst"]) for r in got})
    close(got, plain(rows, 4, threshold))


def test_few_pivots_and_large_cells(spark):
    """Cells of many blocks: a cell may be larger than its share of the pivots."""
    rows = [(0, k, [float(f) for f in v]) for k, v in enumerate(clustered(150, 5, 2, 0.05, 4))]
    got = topk_join.topk_edges(frame(spark, rows), "g", "k", "v", 3, 0.5, cell_rows=10, most_cells=3, task_rows=30).collect()
    close(got, plain(rows, 3, 0.5))


def test_empty(spark):
    got = topk_join.topk_edges(frame(spark, []), "g", "k", "v")
    assert got.columns == ["src", "dst", "score"] and got.count() == 0


def test_skips_pairs_of_far_cells_only(spark):
    near = [(0, k, [float(f) for f in v]) for k, v in enumerate(clustered(1500, 16, 30, 0.03, 5))]
    even = [(0, k, [float(f) for f in v]) for k, v in enumerate(np.random.default_rng(6).normal(size=(600, 32)))]
    one = topk_join.pairs_met(frame(spark, near), "g", "k", "v", 5, 0.82, cell_rows=50).first()
    assert one["pairs"] == 1500**2 and one["compared"] < 0.4 * one["pairs"]
    two = topk_join.pairs_met(frame(spark, even), "g", "k", "v", 5, 0.2, cell_rows=50).first()
    assert two["compared"] <= two["pairs"] == 600**2
    print(f"compared: clustered {one['compared'] / one['pairs']:.3f}, even {two['compared'] / two['pairs']:.3f}")


def test_a_vector_is_sent_once_to_a_bin(spark, monkeypatch):
    """Many cells that all have to be visited: as many rows are sent as there are bins, not cells, and the edges are whole."""
    monkeypatch.setattr(topk_join, "BINS", 3)
    rows = [(0, k, [float(f) for f in v]) for k, v in enumerate(np.random.default_rng(8).normal(size=(300, 16)))]
    sent = []
    whole = topk_join._searched

    def searched(placed, *rest):
        hits, visits = whole(placed, *rest)
        sent.append((hits.where("src = 7").count(), placed.select("cell").distinct().count()))
        return hits, visits

    monkeypatch.setattr(topk_join, "_searched", searched)
    close(topk_join.topk_edges(frame(spark, rows), "g", "k", "v", 4, -1.0, cell_rows=10).collect(), plain(rows, 4, -1.0))
    answers, cells = sent[0]
    assert cells > 12 and answers <= 5 * (1 + 3)  # k + 1 from the own block and from each bin
