"""Byte-level BPE over a text column: encode, decode, and both with digests.

A narrow map over the input's own partitions: no shuffle, one batch in memory at a time,
and a lost task is simply run again.  Each worker builds the vocabulary's tables once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.frames import small_batches, widened
from graphloom.llm.tokenizer import USUAL_PATTERN, BytePairEncoder, PieceCache, Splitter, load_ranks


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(load_ranks(path))


@lru_cache(maxsize=2)
def _digest_cache(path: str) -> PieceCache:
    bpe = encoder(path)

    def make(piece: str) -> tuple[int, str, bytes]:
        ids = bpe.encode_piece(piece.encode())
        return len(ids), ",".join(map(str, ids)), bpe.decode(ids)

    return PieceCache(make)


@lru_cache(maxsize=2)
def _ids_cache(path: str) -> PieceCache:
    bpe = encoder(path)
    return PieceCache(lambda piece: bpe.encode_piece(piece.encode()))


def encode_documents(docs: DataFrame, ranks: str, pattern: str = USUAL_PATTERN, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>); null and empty texts give no ids.

    A column already called `out` is replaced.  Repeated rows are each encoded.
    """
    kept = docs.drop(out)
    small_batches(docs.sparkSession)
    schema = widened(kept, out, "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cache = Splitter(pattern), _ids_cache(ranks)
        for batch in batches:
            ids = [[i for p in split(t or "") for i in cache[p]] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes of a column of token ids; null ids decode to no bytes.

    An id outside the vocabulary is an error: nothing is dropped silently.
    """
    kept = docs.drop(out)
    small_batches(docs.sparkSession)
    schema = widened(kept, out, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks)
        for batch in batches:
            raw = [bpe.decode(x or ()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str = USUAL_PATTERN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.

    Encodes each whole text piece by piece and decodes the ids again in the same pass.
    Null texts count as empty (no ids); repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cache = Splitter(pattern), _digest_cache(ranks)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            count, ids, raw = [], [], []
            for value in batch.column("text"):
                found = [cache[p] for p in split(value.as_py() or "")]
                count.append(sum([x[0] for x in found]))
                ids.append(sha(",".join([x[1] for x in found]).encode()))
                raw.append(sha(b"".join([x[2] for x in found])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    return named.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
