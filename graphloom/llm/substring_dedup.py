"""Removing words that repeat an earlier passage: suffix automata and matching statistics.

Runs of windows that share an anchor are the reference shards.  For each shard a
generalised suffix automaton is built over its distinct runs, each of its states told the
earliest place of its window; then the runs are streamed through it, and the state that
matches the last `length` words says where the window started first.  A shard whose runs
are all equal needs no automaton: each window's earliest place is its run's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphloom.llm import arrays as A
from graphloom.llm.repeats import Answers, Cut, Runs, Tokens, digest_schema, grouped, kept_digests, repeated_windows


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences, online and linear.

    `length` and `link` are the longest match and the suffix link of each state, `step` its
    transitions; state 0 is the empty match.
    """

    def __init__(self) -> None:
        self.length, self.link, self.step = [0], [-1], [{}]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _divide(self, p: int, token: int, q: int) -> int:
        """Splits off the matches of q that are at most one longer than p's."""
        twin = self._state(self.length[p] + 1, self.link[q], self.step[q].copy())
        self.link[q] = twin
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = twin
            p = self.link[p]
        return twin

    def add(self, tokens: list[int]) -> None:
        last, step, link, length = 0, self.step, self.link, self.length
        for token in tokens:
            q = step[last].get(token)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._divide(last, token, q)
                continue
            new = self._state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and token not in step[p]:
                step[p][token] = new
                p = link[p]
            if p >= 0:
                q = step[p][token]
                link[new] = q if length[q] == length[p] + 1 else self._divide(p, token, q)
            last = new

    def matches(self, tokens: list[int], most: int) -> list[tuple[int, int]]:
        """Matching statistics: for each token the state and length (at most `most`) of the
        longest match that ends there."""
        state, size, out = 0, 0, []
        step, link, length = self.step, self.link, self.length
        for token in tokens:
            while state and token not in step[state]:
                state = link[state]
                size = length[state]
            state = step[state].get(token, 0)
            size = size + 1 if state else 0
            if size >= most:
                size = most
                while length[link[state]] >= most:
                    state = link[state]
            out.append((state, size))
        return out


def earliest_windows(runs: Runs, length: int) -> Answers:
    """For each run the ranges of windows and their earliest place anywhere."""
    group, size = grouped(runs)
    lone = np.flatnonzero((size == 1) & (runs.count > 1))
    which, lo, hi, doc, start = [lone], [np.zeros(len(lone), np.int64)], [runs.windows[lone]], [runs.doc[lone]], [runs.start[lone]]
    mixed = np.flatnonzero(size > 1)
    rows: list[tuple[int, int, int, int, int]] = []
    edges = np.flatnonzero(np.diff(group[mixed], prepend=-1, append=-1)) if len(mixed) else []
    for a, b in zip(edges[:-1], edges[1:], strict=False):
        shard = mixed[a:b]
        automaton = SuffixAutomaton()
        number: dict[bytes, int] = {}  # words by their bytes
        words = [runs.text[runs.begin[r] : runs.begin[r + 1]].tobytes().split(b" ")[:-1] for r in shard]
        texts = [[number.setdefault(w, len(number)) for w in t] for t in words]
        for t in texts:
            automaton.add(t)
        streams = [automaton.matches(t, length)[length - 1 :] for t in texts]
        first: dict[int, tuple[int, int]] = {}
        for r, stream in zip(shard, streams, strict=True):
            at, from_ = int(runs.doc[r]), int(runs.start[r])
            for k, (state, _) in enumerate(stream):
                place = (at, from_ + k)
                if state not in first or place < first[state]:
                    first[state] = place
        for r, stream in zip(shard, streams, strict=True):
            k, n = 0, len(stream)
            while k < n:  # windows in a row whose earliest places are in a row, as places of the first
                at, from_ = first[stream[k][0]]
                e = k + 1
                while e < n and first[stream[e][0]] == (at, from_ + e - k):
                    e += 1
                rows.append((int(r), k, e, at, from_ - k))
                k = e
    table = np.array(rows, np.int64).reshape(-1, 5)
    parts = [which, lo, hi, doc, start]
    return tuple(np.concatenate([p[0], table[:, k]]) for k, p in enumerate(parts))  # type: ignore[return-value]


def kept_words(data: np.ndarray, c: Cut, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the words that stay, joined by one space."""
    begin, end = c.span
    stay = ~gone
    n = np.concatenate([[0], np.cumsum(stay)])[c.first]
    size = (end - begin)[stay] + 1
    _, at = A.spread(begin[stay], end[stay] + 1)
    out = np.append(data, np.uint8(0x20))[at]
    edge = np.concatenate([[0], np.cumsum(size)])
    if len(size):
        out[edge[1:] - 1] = 0x20
    # a document's last word has no space after it
    drop = edge[n[1:]][np.diff(n) > 0] - 1
    keep = np.ones(len(out), bool)
    keep[drop] = False
    off = edge[n] - np.concatenate([[0], np.cumsum(np.diff(n) > 0)])
    return out[keep], off


WORDS20 = Tokens(words=True, length=20, gram=6)


def repeated_word_digests(docs: DataFrame, by: Tokens = WORDS20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: what is left without words of earlier windows.

    Null and empty texts have no words and an empty rest; long texts are read whole.  A null id
    counts as the least, rows of one id as being at the same place, so that neither loses a
    word to the other; ids that aren't whole numbers are in the order of their hashes.  Other
    columns are not looked at; an empty table gives no rows.
    """

    def apply(rows, data, off, c: Cut, gone) -> pa.RecordBatch:
        kept, edge = kept_words(data, c, gone)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[c.first])
        digests = kept_digests(kept, edge, np.ones(len(kept), bool))
        return pa.RecordBatch.from_arrays(
            [rows.column(doc_id).combine_chunks(), pa.array(np.diff(c.first)), pa.array(removed), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
        )

    schema = digest_schema(docs, doc_id, "n_words", "n_removed")
    return repeated_windows(docs.select(doc_id, text), by, earliest_windows, apply, schema, doc_id, text)


def without_repeated_words(docs: DataFrame, by: Tokens = WORDS20, doc_id: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs, with the words of windows that start earlier elsewhere taken out of the texts.

    A text that loses words has the others joined by one space, and its `chars` column, if
    there is one, counts again; all others, null and empty ones too, stay as they are.
    Every row stays, even if nothing is left of its text, and every other column, whatever its
    name.  Ids as in `repeated_word_digests`; an empty table stays empty.
    """

    def apply(rows, data, off, c: Cut, gone) -> pa.RecordBatch:
        kept, edge = kept_words(data, c, gone)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[c.first]) > 0
        raw = kept.tobytes()
        texts = [raw[a:b].decode() if r else None for a, b, r in zip(edge[:-1], edge[1:], removed, strict=True)]
        which = pa.array(removed)
        out = rows.set_column(rows.schema.get_field_index(text), text, pc.if_else(which, pa.array(texts, pa.string()), rows.column(text).cast(pa.string())))
        if chars in out.column_names:
            n = pa.array([len(t) if t is not None else None for t in texts], out.column(chars).type)
            out = out.set_column(out.schema.get_field_index(chars), chars, pc.if_else(which, n, out.column(chars)))
        return out.combine_chunks().to_batches()[0]

    return repeated_windows(docs, by, earliest_windows, apply, docs.schema, doc_id, text)
