"""Best-fit packing of documents into token sequences under several capacities.

Documents are tokenized where they lie.  Each task packs the pieces it has: the pieces by
falling length, each into the open sequence that fits best (`Packer`).  A sequence's residual
is a vector of tokens, documents and attention cost (sum of squared lengths); a piece must
fit in every one.  Sequences stay open from one batch of pieces to the next.  A task wastes
less than a sequence or so, however large the input, and nothing is shuffled.  Sequence ids
hold the task's number.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphloom.llm.frames import small_batches
from graphloom.llm.tokenizer import PieceCache, Splitter

#: Pieces that are packed together; their lengths are held, their tokens are not.
PACK_ROWS = 1 << 14


@lru_cache(maxsize=2)
def document_encoder(tokenizer_file: str):
    """text -> ids of the whole text and a closing 0, as little-endian unsigned 32-bit integers.

    For plain byte-level tokenizers each piece's ids come from the library's model once and
    are kept; for all others, and texts with the string of a special token, the library
    encodes the whole text.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    spec = json.loads(tokenizer.to_str())
    before = spec.get("pre_tokenizer") or {}
    plain = (
        spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    )
    special = [x["content"] for x in spec.get("added_tokens", [])]
    # Byte-level vocabularies write each byte as a printable character: itself, or the next one from U+0100.
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    letter = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
    model, split = tokenizer.model, Splitter()
    cache = PieceCache(lambda p: np.array([t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letter))], "<u4").tobytes())

    def encode(text: str | None) -> bytes:
        text = text or ""
        if not plain or any(x in text for x in special):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4").tobytes()
        return b"".join([cache[p] for p in split(text)]) + b"\0\0\0\0"

    return encode


def pieces(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, but the first may be shorter."""
    head = length % most
    cuts = ([(0, head)] if head else []) + [(s, most) for s in range(head, length, most)]
    return cuts


class Packer:
    """Open sequences, and the vector best fit of pieces into them.

    A sequence's residual is a vector: tokens, documents and attention cost left, as shares of
    the limits.  A piece may only go where it fits in all three.  Of those it takes the
    sequence with the least weighted dot product of residual and need: what it needs most is
    then scarcest there, so that the least is left over; with one capacity that is plain best
    fit.  by="norm" takes the least weighted norm of what would be left.  Ties go to the
    sequence opened first.  A piece that breaks the cost limit by itself gets a sequence of
    its own.  A sequence is closed once the smallest piece so far wouldn't fit, and beyond
    most_open the fullest ones are; that costs tokens at most, never a constraint.
    """

    def __init__(self, tokens: int, documents: int, cost: float, weights: tuple[float, float, float], by: str = "dot", most_open: int = 4096):
        self.limit, self.w, self.by, self.most_open = np.array([tokens, documents, cost], float), np.array(weights, float), by, most_open
        self.tokens, self.made, self.n_open, self.least = tokens, 0, 0, tokens
        self.left, self.used, self.name = np.zeros((1024, 3)), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def close(self, at: int) -> None:
        self.n_open -= 1
        for x in (self.left, self.used, self.name):
            x[at] = x[self.n_open]

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence number and offset of each piece, the longest placed first; lengths are at most `tokens`."""
        where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        self.least = min(self.least, int(lengths.min(initial=self.tokens)))
        for i in np.argsort(-lengths, kind="stable"):
            size = int(lengths[i])
            need = np.array([size, 1, float(size) * size]) / self.limit
            at = -1
            if self.n_open:
                room = self.left[: self.n_open]
                fits = (room >= need - 1e-12).all(axis=1)
                if fits.any():
                    score = room @ (self.w * need) if self.by == "dot" else (self.w * (room - need) ** 2).sum(axis=1)
                    score = np.where(fits, score, np.inf)
                    best = np.flatnonzero(score == score.min())
                    at = int(best[np.argmin(self.name[best])])
            if at < 0:
                if self.n_open == self.most_open:
                    self.close(int(np.argmax(self.used[: self.n_open])))
                if self.n_open == len(self.left):
                    self.left, self.used, self.name = (np.concatenate([x, x * 0]) for x in (self.left, self.used, self.name))
                at, self.n_open = self.n_open, self.n_open + 1
                self.left[at], self.used[at], self.name[at] = 1.0, 0, self.made
                self.made += 1
            where[i], offset[i] = self.name[at], self.used[at]
            self.left[at] -= need
            self.used[at] += size
            if self.tokens - self.used[at] < self.least:
                self.close(at)
        return where, offset


def best_fit(
    lengths: np.ndarray, tokens: int, documents: int, cost: float, weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), by: str = "dot"
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one batch."""
    return Packer(tokens, documents, cost, weights, by).place(lengths)


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    max_tokens: int = 2048,
    max_documents: int | None = None,
    max_cost: float | None = None,
    by: str = "dot",
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and a closing 0; longer ones are cut (`pieces`).  A sequence
    holds at most max_tokens tokens, max_documents pieces and an attention cost of max_cost
    (the sum of the squared lengths; a piece dearer than that is alone in its sequence).
    Without max_documents and max_cost these two are as large as can be, never bind and count
    for ties only.  Null and empty texts are one token; repeated rows and null ids are packed
    as often as they come; long texts are read whole; other columns are not looked at; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    documents, cost = max_documents or max_tokens, max_cost or float(max_tokens) ** 2
    weights = (1.0, 1.0 if max_documents else 1e-6, 1.0 if max_cost else 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = document_encoder(tokenizer_file)
        task, packer = TaskContext.get().partitionId() << 40, Packer(max_tokens, documents, cost, weights, by)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            doc, piece, start, length, crc, ids = zip(*rows, strict=True)
            where, offset = packer.place(np.array(length, np.int64))
            columns = [
                pa.array(doc, kind),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(where + task),
                pa.array(offset),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
        for batch in batches:
            kind = batch.column("doc_id").type
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = encode(value.as_py())
                for k, (start, length) in enumerate(pieces(len(raw) // 4, max_tokens)):
                    part = raw[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(part), part if with_ids else None))
                if len(rows) >= PACK_ROWS:
                    yield flush()
        if rows:
            yield flush()

    out = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {out}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInArrow(run, schema)
