"""Repairing the structure of conversations by a forward Viterbi pass over their turns.

The roles of a sound conversation are an optional system turn and then pairs of user and
assistant.  Four states say what has been read: nothing, the system turn, a user's, an
assistant's.  A layer holds for each state the minimum (cost, audit string) of the edits so
far; a turn is kept, reroled or deleted, and then the layer is closed under insertions, of
which three in a row reach every state.  Of two audits of equal cost none is a prefix of the
other (what it has more would be insertions, which cost), so the least prefix stays least.

Conversations lie in sorted ranges of (conversation, turn), so that a long one is spread over
many tasks.  A conversation inside a range is repaired there.  One that reaches a range's
end, of which there are two a range at most, or that is too large to hold is taken apart:
each range gives the minimum for every pair of states before and after, the pieces are put
together by conversation, and its text passes once more, in order, through the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from graphloom.llm.frames import checkpointed, small_batches

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: State after keeping a turn of this initial: 0 nothing read, 1 system, 2 user, 3 assistant.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: State after a turn whose role is free (reroled or inserted).
FREE = (2, 2, 3, 2)
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Turns in a block of a piece, and characters of one conversation that a task holds.
BLOCK, HELD = 256, 16 << 20

Layer = list[tuple[int, str] | None]


def _offer(layer: Layer, state: int, cost: int, audit: str) -> None:
    have = layer[state]
    if have is None or (cost, audit) < have:
        layer[state] = (cost, audit)


def closed(layer: Layer) -> Layer:
    """The layer with insertions after its last turn."""
    for _ in range(3):
        for state in range(4):
            if (have := layer[state]) is not None:
                _offer(layer, FREE[state], have[0] + INSERT_COST, have[1] + "I")
    return layer


def advanced(layer: Layer, initial: str, fault: int) -> Layer:
    """The layer after one more turn."""
    out: Layer = [None] * 4
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    for state, have in enumerate(layer):
        if have is None:
            continue
        cost, audit = have
        _offer(out, state, cost + DELETE_COST, audit + "D")
        if fault not in (BLANK, DUPLICATE):
            if (after := KEPT.get((state, initial))) is not None:
                _offer(out, after, cost + KEEP_COST + more, audit + "K")
            _offer(out, FREE[state], cost + REROLE_COST + more, audit + "R")
    return closed(out)


def only(state: int) -> Layer:
    return [(0, "") if k == state else None for k in range(4)]


def chained(layer: Layer, piece: list[Layer]) -> Layer:
    """The layer after a piece, given as the layers that each single state leads to."""
    out: Layer = [None] * 4
    for have, then in zip(layer, piece, strict=True):
        if have is not None:
            for state, more in enumerate(then):
                if more is not None:
                    _offer(out, state, have[0] + more[0], have[1] + more[1])
    return out


def best(layer: Layer) -> tuple[int, str]:
    """The cheapest of the sound ends: nothing at all, or after an assistant's turn."""
    return min(x for x in (layer[0], layer[3]) if x is not None)


def fault_of(text: str, again: bool) -> int:
    """The first fault of a turn: blank, duplicate, truncated or none (0)."""
    ink = text.rstrip(SPACE)
    return BLANK if not ink else DUPLICATE if again else TRUNCATED if ink[-1] not in ".!?" else 0


@dataclass
class Tally:
    """What is counted turn by turn, over a whole conversation or a piece of it."""

    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    first: str | None = None  # initials of the first and last role
    last: str | None = None
    low: int | None = None  # least and greatest turn
    high: int | None = None
    turns: int = 0  # distinct ones

    def add(self, turn: int | None, initial: str, fault: int, times: int = 1) -> None:
        self.faults[fault] += times
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        if times > 1:
            self.illegal += (times - 1) * (initial * 2 not in LEGAL)
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def join(self, other: Tally) -> None:
        """Adds a later piece of the same conversation."""
        if other.last is None:
            return
        self.faults = [x + y for x, y in zip(self.faults, other.faults, strict=True)]
        self.illegal += other.illegal + (self.last is not None and self.last + other.first not in LEGAL)
        self.first, self.last = other.first if self.last is None else self.first, other.last
        if other.high is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns

    def row(self) -> tuple[int, ...]:
        return (self.gaps, *self.faults[1:], self.illegal)


class Digest:
    """SHA-256 of the repaired turns, one `role:text` a line, as the audit tells."""

    def __init__(self, audit: str):
        self.hash, self.audit, self.at, self.lines, self.state = hashlib.sha256(), audit, 0, 0, 0

    def _line(self, role: str | None, text: str) -> None:
        if role is None:
            self.state = FREE[self.state]
            role = "user" if self.state == 2 else "assistant"
        else:
            self.state = KEPT[self.state, role[:1]]
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(None, "")
            self.at += 1

    def add(self, role: str, text: str, times: int = 1) -> None:
        for _ in range(times):
            self._inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                self._line(role if edit == "K" else None, text)

    def value(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows with faults planted by their keys.

    Nulls are read as one space.  crc32 of `conv_id:turn` modulo 20: 0 drops the row (it
    stays, marked, so that its conversation isn't lost), 1 empties the text, 2 takes its
    sentence marks, 3 repeats the row, 4 makes the role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("time")).drop("time")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _schema(rows: DataFrame, *more: StructField) -> StructType:
    fields = [StructField("conv_id", rows.schema["conv_id"].dataType), *(StructField(c, LongType()) for c in COUNTS)]
    return StructType([*fields, StructField("audit", StringType()), StructField("repaired_sha256", StringType()), *more])


def _batch(schema: pa.Schema, found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)] if found else [pa.array([], f.type) for f in schema], schema=schema)


def _records(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def repaired(rows: DataFrame) -> DataFrame:
    """One row a conversation: counts of faults, the cheapest repair and its digest.

    rows: conv_id, turn (whole numbers), role, text and gone, as from `damaged`; rows marked
    gone only say that their conversation exists.  Turns are in order of turn (nulls first),
    then role, then a hash of the text; equal rows are adjacent, the later ones are
    duplicates.  A null conv_id is a conversation too.  Empty tables give no rows; a
    conversation without rows gets zeros, an empty audit and the digest of nothing.
    """
    small_batches(rows.sparkSession)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(12, -(-size // (32 << 20)))
    order = ["conv_id", "turn", "role", "h", "text"]
    hashed = rows.withColumn("h", F.xxhash64("text"))
    ranged = hashed.repartitionByRange(parts, *order[:-1]).sortWithinPartitions(*order)
    schema = _schema(rows, StructField("open", BooleanType()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repairs the conversations that lie within the range; names those that may not."""
        kind = None
        found: list[tuple] = []
        held: list[tuple] = []
        conv, first, some, chars = None, True, False, 0

        def closed_off(open_: bool) -> None:
            if open_ or chars > HELD:
                found.append((conv, *[None] * 8, True))
                return
            layer, tally, seen = closed(only(0)), Tally(), set()
            for turn, role, text in held:
                fault = fault_of(text, (role, text) in seen)
                seen.add((role, text))
                tally.add(turn, role[:1], fault)
                layer = advanced(layer, role[:1], fault)
            cost, audit = best(layer)
            digest = Digest(audit)
            for _, role, text in held:
                digest.add(role, text)
            found.append((conv, *tally.row(), cost, audit, digest.value(), False))

        for b in batches:
            kind = kind or pa.schema([b.schema.field("conv_id"), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("open", pa.bool_())])
            for c, turn, role, text, gone in _records(iter([b]), "conv_id", "turn", "role", "text", "gone"):
                if some and c != conv:
                    closed_off(first)
                    first, chars = False, 0
                    held.clear()
                conv, some = c, True
                chars += len(text) + 64
                if chars > HELD or first:
                    held.clear()
                elif not gone:
                    held.append((turn, role, text))
            if len(found) > 500:
                yield _batch(kind, found)
                found.clear()
        if some:
            closed_off(True)
            yield _batch(kind, found)

    done = checkpointed(ranged.select("conv_id", "turn", "role", "text", "gone").mapInArrow(whole, schema))
    names = done.where("open").select(F.col("conv_id").alias("name")).distinct()
    left = hashed.join(names, _same(F.col("conv_id"), F.col("name")), "left_semi")
    return done.where("NOT open").drop("open").union(_long_ones(left, names, parts))


def _long_ones(rows: DataFrame, names: DataFrame, parts: int) -> DataFrame:
    """The same for conversations of any length, spread over ranges of their turns."""
    # equal rows are one record; the earliest of a role and text is no duplicate
    records = rows.where("NOT gone").groupBy("conv_id", "turn", "role", "h", "text").agg(F.count("*").alias("times"))
    early = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("at")
    first = records.groupBy("conv_id", "role", "h", "text").agg(early).select(F.col("conv_id").alias("c"), F.col("at.turn").alias("t"), F.col("role").alias("r"), F.col("h").alias("k"), F.col("text").alias("x"))
    same = _same(F.col("conv_id"), F.col("c")) & _same(F.col("turn"), F.col("t")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k")) & (F.col("text") == F.col("x"))
    marked = records.join(first, same, "left").select("conv_id", "turn", "role", "h", "text", "times", F.col("k").isNotNull().alias("fresh"))
    marked = checkpointed(marked.repartitionByRange(parts, "conv_id", "turn", "role", "h").sortWithinPartitions("conv_id", "turn", "role", "h", "text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each conversation of a range the minima between any two states, and its counts."""
        kind = None
        conv, some, n = None, False, 0
        tally, block = Tally(), [only(k) for k in range(4)]
        whole_: list[Layer] = [only(k) for k in range(4)]

        def piece() -> pa.RecordBatch:
            table = [chained(x, block) for x in whole_]
            flat = [x for layer in table for x in layer]
            cells = [[x[0] if x else None for x in flat], [x[1] if x else None for x in flat]]
            t = tally
            return pa.RecordBatch.from_arrays([
                pa.array([conv], kind), pa.array([at], pa.string()), pa.array([cells[0]], pa.list_(pa.int64())), pa.array([cells[1]], pa.list_(pa.string())), pa.array([t.faults], pa.list_(pa.int64())),
                pa.array([t.illegal], pa.int64()), pa.array([t.first]), pa.array([t.last]), pa.array([t.low], pa.int64()), pa.array([t.high], pa.int64()), pa.array([t.turns], pa.int64()),
            ], names=["conv_id", "at", "costs", "audits", "faults", "illegal", "first", "last", "low", "high", "turns"])

        at = ""
        for b in batches:
            kind = kind or b.schema.field("conv_id").type
            for c, turn, role, h, text, times, fresh in _records(iter([b]), "conv_id", "turn", "role", "h", "text", "times", "fresh"):
                if some and c != conv:
                    yield piece()
                    tally, n = Tally(), 0
                    block, whole_ = [only(k) for k in range(4)], [only(k) for k in range(4)]
                if not n:  # a place that sorts pieces as their turns
                    at = "" if turn is None else f"{turn + (1 << 63):020d}"
                    at += f"\x00{role}\x00{h + (1 << 63):020d}"
                conv, some = c, True
                for k in range(times):
                    again = k > 0 or not fresh
                    fault = fault_of(text, again)
                    tally.add(turn, role[:1], fault)
                    block = [advanced(x, role[:1], fault) for x in block]
                    n += 1
                    if n % BLOCK == 0:
                        whole_, block = [chained(x, block) for x in whole_], [only(s) for s in range(4)]
        if some:
            yield piece()

    kind = rows.schema["conv_id"].dataType
    fields = "at string, costs array<long>, audits array<string>, faults array<long>, illegal long, first string, last string, low long, high long, turns long"
    schema = StructType([StructField("conv_id", kind), *StructType.fromDDL(fields).fields])
    found = marked.mapInArrow(pieces, schema)

    def together(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        layer, tally = closed(only(0)), Tally()
        none = lambda x: None if x is None or x != x else x
        for p in part.sort_values("at").itertuples():
            cells = [None if a is None else (int(c), a) for c, a in zip(p.costs, p.audits, strict=True)]
            layer = chained(layer, [cells[k : k + 4] for k in range(0, 16, 4)])
            whole_int = lambda x: None if none(x) is None else int(x)
            tally.join(Tally([int(x) for x in p.faults], int(p.illegal), none(p.first), none(p.last), whole_int(p.low), whole_int(p.high), int(p.turns)))
        cost, audit = best(layer)
        return pd.DataFrame([[*tally.row(), cost, audit]], columns=[*COUNTS, "audit"])

    out = ", ".join([*(f"{c} long" for c in COUNTS), "audit string"])
    told = found.groupBy("conv_id").applyInPandas(lambda key, part: together(key, part).assign(conv_id=[key[0]])[["conv_id", *COUNTS, "audit"]], StructType([StructField("conv_id", kind), *StructType.fromDDL(out).fields]))
    every = names.join(told, _same(F.col("name"), F.col("conv_id")), "left")
    every = every.select(F.col("name").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"))
    every = checkpointed(every)

    # the digest reads a conversation in order, behind its audit
    empty = {"turn": "long", "role": "string", "h": "long", "text": "string", "times": "long"}
    heads = every.select("conv_id", F.lit(0).alias("body"), *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), *COUNTS, "audit")
    bodies = marked.select("conv_id", F.lit(1).alias("body"), *empty, *(F.lit(None).cast("long").alias(c) for c in COUNTS), F.lit(None).cast("string").alias("audit"))
    lines = heads.union(bodies).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "body", "turn", "role", "h", "text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, head, digest = None, None, None
        for b in batches:
            kind = kind or pa.schema([b.schema.field("conv_id"), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            found = []
            for r in _records(iter([b]), "conv_id", "body", "role", "text", "times", *COUNTS, "audit"):
                if r[1]:
                    digest.add(r[2], r[3], r[4])
                    continue
                if head:
                    found.append((*head, digest.value()))
                head, digest = (r[0], *r[5:]), Digest(r[-1])
            if found:
                yield _batch(kind, found)
        if head:
            yield _batch(kind, [(*head, digest.value())])

    return lines.mapInArrow(digests, _schema(rows))
