"""Removing bytes of passages that occur elsewhere: a hash-compared sparse suffix sort.

Suffixes (and reversed prefixes) at shared anchors are merge-sorted.  Two are compared by
their longest common extension, found by binary search on prefix polynomial hashes, in
logarithmic time; the extensions of neighbours are verified byte by byte.  With the two
orders, the windows at one offset from their anchors fall into classes of equal left and
right parts, and a class of two or more is a repeat.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import arrays as A
from graphloom.llm.repeats import FIRST, Answers, Cut, Runs, Tokens, digest_schema, grouped, kept_digests, repeated_windows


def common(prefix: A.Prefix, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common extension of the suffixes at a and b, at most `most`, by hashes."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = prefix.of(a, a + mid) == prefix.of(b, b + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def before(text: np.ndarray, prefix: A.Prefix, at: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether suffix x sorts before suffix y; a prefix of another before it, equals by number."""
    n = common(prefix, at[x], at[y], np.minimum(size[x], size[y]))
    end_x, end_y = n == size[x], n == size[y]
    last = len(text) - 1
    cx, cy = text[np.minimum(at[x] + n, last)], text[np.minimum(at[y] + n, last)]
    return np.where(end_x | end_y, np.where(end_x & end_y, x < y, end_x), cx < cy)


def merge_sort(text: np.ndarray, prefix: A.Prefix, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes text[at : at + size] within each group; group is sorted.

    Bottom-up: at each level all pairs of sorted blocks of all groups are merged at once,
    each element by binary search in the other block.
    """
    n = len(at)
    order = np.arange(n)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if n else np.zeros(1, np.int64)
    own = np.searchsorted(edge, np.arange(n), "right") - 1
    base, limit = edge[own], edge[own + 1] if n else edge[:0]
    local = np.arange(n) - base
    width = 1
    while n and (limit - base > width).any():
        live = np.flatnonzero(limit - base > width)
        block = local[live] // width
        other = base[live] + (block ^ 1) * width
        lo = np.minimum(other, limit[live])
        hi = np.minimum(other + width, limit[live])
        start = lo.copy()
        mine = order[live]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = before(text, prefix, at, size, order[mid], mine[open_])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        pair = base[live] + (block & ~1) * width
        place = pair + (local[live] - block * width) + (lo - start)
        fresh = order.copy()
        fresh[place] = mine
        order = fresh
        width *= 2
    return order


def neighbours(text: np.ndarray, prefix: A.Prefix, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order and, for each place in it, the extension shared with the one before (-1: another group).

    The extensions of neighbours are compared byte by byte; if hashes were wrong anywhere, the
    sort is done again with other values of the bytes, as often as it takes.
    """
    for salt in count(1):
        order = merge_sort(text, prefix, at, size, group)
        a, b = order[:-1], order[1:]
        most = np.minimum(size[a], size[b])
        shared = common(prefix, at[a], at[b], most)
        owner, k = A.spread(np.zeros(len(a), np.int64), np.minimum(shared + 1, most))
        same = text[at[a][owner] + k] == text[at[b][owner] + k]
        true = np.bincount(owner[same & (k < shared[owner])], minlength=len(a))
        if (true == shared).all() and not (same & (k == shared[owner])).any():
            break
        prefix = A.Prefix(A.salted(A.BYTE, 30 + salt)[text])
    lcp = np.concatenate([[-1], np.where(group[a] == group[b], shared, -1)]) if len(order) else np.zeros(0, np.int64)
    return order, lcp


def repeated_runs(runs: Runs, length: int) -> Answers:
    """For each run the ranges of windows that occur at two places or more."""
    group, size = grouped(runs)
    sure = np.flatnonzero(runs.count > 1)
    which, lo, hi = [sure], [np.zeros(len(sure), np.int64)], [runs.windows[sure]]
    mixed = np.flatnonzero(size > 1)
    if len(mixed):
        own = group[mixed]
        begin, end = runs.begin[mixed], runs.begin[mixed + 1]
        anchor = begin + runs.shift[mixed]
        prefix = A.Prefix(A.BYTE[runs.text])
        order_r, lcp_r = neighbours(runs.text, prefix, anchor, end - anchor, own)
        flipped = np.ascontiguousarray(runs.text[::-1])
        back = A.Prefix(A.BYTE[flipped])
        n = len(flipped)
        order_l, lcp_l = neighbours(flipped, back, n - anchor, anchor - begin, own)
        least, most = runs.shift[mixed] - runs.windows[mixed] + 1, runs.shift[mixed]
        found_run, found_window = [], []
        for d in range(int(least.min()), int(most.max()) + 1):  # tokens before the anchor
            right, left = np.empty(len(mixed), np.int64), np.empty(len(mixed), np.int64)
            right[order_r] = np.cumsum(lcp_r < length - d)
            left[order_l] = np.cumsum(lcp_l < d)
            live = np.flatnonzero((least <= d) & (d <= most))
            key = right[live] * (len(mixed) + 1) + left[live]
            _, back_to, times = np.unique(key, return_inverse=True, return_counts=True)
            hit = live[times[back_to] > 1]
            found_run.append(hit)
            found_window.append(most[hit] - d)
        run, window = np.concatenate(found_run), np.concatenate(found_window)
        fresh = runs.count[mixed[run]] == 1  # the others are removed whole already
        run, window = run[fresh], window[fresh]
        order = np.lexsort((window, run))
        run, window = run[order], window[order]
        if len(run):
            turn = np.concatenate([[True], (run[1:] != run[:-1]) | (window[1:] != window[:-1] + 1)])
            first = np.flatnonzero(turn)
            last = np.append(first[1:], len(run)) - 1
            which.append(mixed[run[first]])
            lo.append(window[first])
            hi.append(window[last] + 1)
    which, lo, hi = np.concatenate(which), np.concatenate(lo), np.concatenate(hi)
    return which, lo, hi, np.full(len(which), FIRST), np.full(len(which), -1)


BYTES200 = Tokens(words=False, length=200, gram=64, fine=8)


def repeated_byte_digests(docs: DataFrame, by: Tokens = BYTES200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what is left without repeated windows.

    Null texts are empty; long texts are read whole; ids play no part, so null and repeated ones
    do no harm and a row that repeats another loses all of its windows, as the other does.
    Other columns are not looked at; an empty table gives no rows.
    """

    def apply(rows, data, off, c: Cut, gone) -> pa.RecordBatch:
        ones = np.concatenate([[0], np.cumsum(gone)])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        cuts = off[:-1][off[:-1] < len(gone)]
        opens[cuts] = gone[cuts]
        spans = np.concatenate([[0], np.cumsum(opens)])
        return pa.RecordBatch.from_arrays(
            [rows.column(doc_id).combine_chunks(), pa.array(np.diff(off)), pa.array(np.diff(ones[off])), pa.array(np.diff(spans[off])), pa.array(kept_digests(data, off, ~gone), pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    schema = digest_schema(docs, doc_id, "n_bytes", "n_removed", "n_spans")
    return repeated_windows(docs.select(doc_id, text), by, repeated_runs, apply, schema, doc_id, text)
