"""Personal data, repair of conversations and compaction, against plain forms."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from functools import lru_cache

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.llm import compaction, conversations, pii
from graphloom.llm.queries import QUERIES

# --- conversations ------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"
sys.setrecursionlimit(20_000)  # the plain repair is a recursion over the rows


def damage(rows):
    """{conv_id: rows after damage, in order}; rows: (conv_id, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's rows, from the last row back."""
    faults, seen = [], set()
    for _, role, text in rows:
        ink = text.rstrip(SPACE)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))

    def read(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    @lru_cache(None)
    def rest(k, state, inserts):
        """Least (cost, audit, roles) from row k on."""
        found = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        ways = [("I", 5, r, k, inserts + 1) for r in ("user", "assistant") if inserts < 4]
        if k < len(rows):
            ways.append(("D", 2, None, k + 1, 0))
            if faults[k] not in ("blank", "duplicate"):
                more = 5 * (faults[k] == "truncated")
                ways += [("K", more, rows[k][1], k + 1, 0), *(("R", 1 + more, r, k + 1, 0) for r in ("user", "assistant"))]
        for edit, cost, role, after, n in ways:
            to = state if role is None else read(state, role[:1])
            if to is not None and (then := rest(after, to, n)):
                found.append((cost + then[0], edit + then[1], (role, *then[2])))
        return min(found) if found else None

    cost, audit, roles = rest(0, "", 0)
    lines, k = [], 0
    for edit, role in zip(audit, roles):
        if edit != "D":
            lines.append(f"{role}:{'' if edit == 'I' else rows[k][2]}")
        k += edit != "I"
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def check_repairs(got, rows):
    want = {c: repair(r) for c, r in damage(rows).items()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in names) == want[r["conv_id"]], r["conv_id"]


def test_conversations_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn").collect()]
    check_repairs(QUERIES["op12_conversation_repair"](spark, sf_dir).collect(), rows)


def in_order(rows):
    """One row of each conversation and turn, in order; rows of one turn lie in order of a hash otherwise."""
    return sorted({(c, t): (c, t, r, x) for c, t, r, x in rows}.values(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))


@pytest.fixture(scope="module")
def odd_conversations():
    rng = random.Random(12)
    texts = ["Yes.", "No!", "", " \t", "so", "Why? ", "é.", "a\nb.", None]
    rows = []
    for conv in range(150):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8])):
            role = rng.choices(["user", "assistant", "system", "tool", "", None, "unknown"], [8, 8, 3, 1, 1, 1, 1])[0]
            rows.append((conv, turn * rng.choice([1, 1, 1, 3]) + conv, role, rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    rows += [(None, k, "user" if k % 2 == 0 else "assistant", f"null {k}.") for k in range(5)]
    rows += [(1000, None, "user", "first."), (1000, 4, "assistant", "last."), (1001, None, None, None), (1002, -5, "system", "Be good.")]
    # one conversation over many ranges: a third of all rows
    return rows + [(77_777, k, rng.choice(["user", "user", "assistant", "system"]), rng.choice([f"line {k}.", f"line {k}", "same.", "same"])) for k in range(300)]


def test_odd_conversations(spark, odd_conversations):
    order = in_order(odd_conversations)
    df = spark.createDataFrame(order, "conv_id long, turn long, role string, text string").repartition(7)
    for c in ("gone", "h", "at", "audit", "open"):
        df = df.withColumn(c, F.lit(3))
    check_repairs(conversations.repaired(conversations.damaged(df)).collect(), order)


def test_long_conversations_stay_in_pieces(spark, monkeypatch):
    """Every conversation by way of pieces, with blocks of two turns."""
    monkeypatch.setattr(conversations, "BLOCK", 2)
    monkeypatch.setattr(conversations, "HELD", 0)
    rng = random.Random(5)
    rows = [(f"c{k % 3}", k, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", "x.", ""])) for k in range(160)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(3)
    check_repairs(conversations.repaired(conversations.damaged(df)).collect(), rows)


def test_equal_rows_of_a_turn(spark):
    """Rows that repeat, at null turns too, are duplicates beside each other."""
    rows = [("a", None, "user", "Hi.")] * 40 + [("a", 3, "assistant", "Ho.")] * 2
    got = conversations.repaired(spark.createDataFrame([(*r, False) for r in rows], "conv_id string, turn long, role string, text string, gone boolean")).collect()
    assert [tuple(r) for r in got] == [("a", *repair([r[1:] for r in rows]))]


def test_conversations_without_rows(spark):
    names = "conv_id long, turn long, role string, text string"
    assert conversations.repaired(conversations.damaged(spark.createDataFrame([], names))).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    got = conversations.repaired(conversations.damaged(spark.createDataFrame([(dropped, 1, "user", "x.")], names))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- compaction ---------------------------------------------------------------------------


def packed_files(rows):
    """Final files of rows [(click_id, arrived_at, value)]: {(day, lot, piece): (n, min, max, cents, sources, digest, rewritten)}."""
    total = len(rows)
    limit = lambda x: 1 + total // x
    days = Counter(r[1] and (r[1].date() - date(1970, 1, 1)).days for r in rows)
    start = defaultdict(list)
    for i, at, value in rows:
        day = at and (at.date() - date(1970, 1, 1)).days
        h = zlib.crc32(b"" if i is None else str(i).encode())
        start[day, h // 16 % (1 + days[day] // limit(150)), min(h % 4, h // 4 % 4)].append((i, at, value))
    groups = []
    for day in days:
        mine = sorted(((-len(v), k[1], k[2]) for k, v in start.items() if k[0] == day))
        open_ = []
        for n, lot, piece in mine:
            if -n >= limit(600):
                groups.append([(day, lot, piece)])
                continue
            fit = next((g for g in open_ if sum(len(start[k]) for k in g) - n <= limit(400)), None)
            if fit is None:
                open_.append([(day, lot, piece)])
            else:
                fit.append((day, lot, piece))
        groups += open_
    out = {}
    for g in groups:
        every = [r for k in g for r in sorted(start[k], key=lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, r[0] or 0))]
        ids = [i for i, _, _ in every]
        known = [i for i in ids if i is not None]
        cents = sum(math.floor(100 * v + 0.5) for _, _, v in every if v is not None and math.isfinite(v))
        out[g[0]] = (len(every), min(known, default=None), max(known, default=None), cents, ",".join(f"{k[1]}-{k[2]}" for k in g), hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest(), len(g) > 1)
    return out


def check_files(got, rows, columns):
    want = packed_files(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r["n_rows"], r["min_click_id"], r["max_click_id"], r["cents"], r["sources"], r["ids_sha256"], r["rewritten"]) == want[r["day"], r["lot"], r["piece"]]
        assert r["columns"] == ",".join(columns)
        assert os.path.basename(r["path"]).startswith("compact-") == r["rewritten"]
        assert pq.ParquetFile(r["path"].removeprefix("file:")).metadata.num_rows == r["n_rows"]
    if got:
        root = got[0]["path"].removeprefix("file:").split("/day=")[0]
        left = {f"{d}/{f}" for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}
        assert left == {r["path"].removeprefix("file:") for r in got}


def test_compaction_of_clicks(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    got = QUERIES["op13_compaction"](spark, sf_dir).collect()
    check_files(got, [tuple(r) for r in df.select("click_id", "arrived_at", "value").collect()], df.columns)
    assert {r["rewritten"] for r in got} == {True, False}
    root = got[0]["path"].split("/day=")[0]
    again = spark.read.parquet(root).select(df.columns)
    assert again.exceptAll(df).count() == 0 and df.exceptAll(again).count() == 0
    assert dict(again.dtypes) == dict(df.dtypes)


def test_compaction_of_odd_rows(spark):
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    rows = []
    for k in range(3000):
        at = None if rng.random() < 0.1 else base + timedelta(days=0 if rng.random() < 0.4 else rng.randrange(40), seconds=rng.randrange(5))
        rows.append((None if rng.random() < 0.05 else rng.randrange(2000) - 50, at, rng.choice([None, float("nan"), float("inf"), 1.005, -2.5, 3.0])))
    rows += rows[:100] + [(1, datetime(1969, 12, 31, 23), 1.0)]
    df = spark.createDataFrame([(*r, "d", 1, "x") for r in rows], "click_id long, arrived_at timestamp_ntz, value double, day string, Lot int, `a.b` string")
    got = compaction.compacted(df.repartition(6))
    root = got.first()["path"].split("/_day=")[0]
    assert spark.read.parquet(root).count() == len(rows)
    want = packed_files(rows)
    for r in got.collect():
        assert (r["n_rows"], r["min_click_id"], r["max_click_id"], r["cents"], r["sources"], r["ids_sha256"], r["rewritten"]) == want[r["day"], r["lot"], r["piece"]]
        assert r["columns"] == "click_id,arrived_at,value,day,Lot,a.b"
    assert got.count() == len(want)
    assert compaction.compacted(df.limit(0)).count() == 0


def test_untouched_files_stay(spark, sf_dir, monkeypatch):
    """Files that no group replaces keep their bytes."""
    before = {}
    keep = compaction.checkpointed

    def watched(df):
        out = keep(df)
        if out.columns == ["day", "lot", "piece", "path", "rows"]:
            for r in out.collect():
                with open(r["path"].removeprefix("file:"), "rb") as f:
                    before[r["path"]] = hashlib.sha256(f.read()).hexdigest()
        return out

    monkeypatch.setattr(compaction, "checkpointed", watched)
    for r in compaction.compacted(spark.read.parquet(f"{sf_dir}/clicks.parquet")).where("NOT rewritten").collect():
        with open(r["path"].removeprefix("file:"), "rb") as f:
            assert before[r["path"]] == hashlib.sha256(f.read()).hexdigest()


def test_first_fit_prunes_full_groups():
    files = [(1, n, k, 0, f"p{k}", 2) for k, n in enumerate([9, 6, 5, 4, 3, 2, 2])]
    assert sorted([f[1] for f in g] for g in compaction.first_fit(files, 9, 8)) == [[4, 2], [5, 3], [6, 2], [9]]


# --- personal data ------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def base_of(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = sum(c.isdigit() for c in m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= digits <= 19 and luhn(m.group()), "phone": 9 <= digits <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_patterns():
    rng = random.Random(8)
    pieces = ["a", "b.c", "@", ".", "-", "+", " ", "1", "22", "333", "256", "0001", "4111 1111 1111 1111", "4111111111111111", "(0) 12", "é", "x@y.z", "10.2.3.4", "\n", "%", "_", "+1 555 123-4567", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == base_of(text), text


def test_very_long_runs_are_linear():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1.x" * 500_000, "a@" * 500_000, "+" * 500_000, "1-" * 500_000, "@a" * 300_000):
        assert pii.base_spans(text) == []


def terms_of(text):
    return [(m.start(), m.end(), m.group().translate({i: i + 32 for i in range(65, 91)})) for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")]


def sanitised_spans(texts, window, support, remove, generalise):
    seen, counts = defaultdict(set), Counter()
    for text in texts:
        spans = base_of(text)
        counts.update(t for _, _, t in terms_of(text))
        free = [w for w in terms_of(text) if all(w[1] <= s or w[0] >= e for s, _, e in spans)]
        for s, k, e in spans:
            value = text[s:e].lower() if k < 2 else re.sub("[^0-9]", "", text[s:e])
            near = [w[2] for w in free if w[1] <= s][-window:] + [w[2] for w in free if w[0] >= e][:window]
            seen[k, value].add(frozenset(near))
    total, part = sum(counts.values()), {}
    for found in seen.values():
        for t, n in Counter(t for c in found for t in c).items():
            if n >= support:
                chance = 1 - (1 - min(counts[t] / total, 1 - 1e-9)) ** (2 * window)
                own = max(math.log2(total) - math.log2(len(found) * 2 * window), 1)
                part[t] = max(part.get(t, 0), math.log2(n / len(found) / chance) / own)
    out = []
    for text in texts:
        spans = base_of(text)
        more = [(s, 4 + (part[t] >= remove), e) for s, e, t in terms_of(text) if part.get(t, 0) >= generalise and all(e <= a or s >= b for a, _, b in spans)]
        out.append((spans, sorted(spans + more)))
    return out


@pytest.fixture(scope="module")
def personal():
    rng = random.Random(6)
    word = lambda: f"w{int(rng.paretovariate(0.4)) % 3000}"
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [text(60) for _ in range(120)]
    rows += [f"{text(20)} Zelda Quux <zq@mail.example.com> {text(20)}" for _ in range(6)]
    rows += [f"{text(9)} ZELDA said {text(9)}", f"{text(30)} call +1 555 123-4567 Onkel Würg {text(3)}", f"Würg {text(30)}"]
    rows += [f"{text(4)} +1 (555) 1234567 würg {text(8)} würg" for _ in range(4)] + [f"würg {text(30)}" for _ in range(3)]
    copies = f"{text(10)} once@there.org unique {text(10)}"  # copies are one observation
    return rows + [copies] * 9 + [None, "", " ", "10.0.0.1 4111 1111 1111 1111 +1.2.3.4.5.6.7.8.9", text(30_000)]


def test_personal_spans(spark, personal):
    names = [*pii.KINDS, *pii.ADDED]
    told = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(personal)], "doc_id long, text string, t int, _row int").repartition(5)
    got = {r["doc_id"]: r for r in pii.span_digests(df).collect()}
    want = sanitised_spans(personal, 8, 3, 0.9, 0.75)
    kinds = Counter()
    for k, (base, every) in enumerate(want):
        assert got[k]["spans"] == told(every), personal[k]
        assert got[k]["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(b[1] == j for b in base) for j in range(4)]
        kinds.update(x[1] for x in every)
    assert kinds[4] and kinds[5] and not any("removed" in got[k]["spans"] for k in range(120))
    whole = {r["doc_id"]: r for r in pii.sanitised(df).collect()}
    assert "elda" not in whole[120]["text"].lower() and "[EMAIL]" in whole[120]["text"] and whole[0]["text"] == personal[0]
    assert whole[120]["_row"] == 2 and whole[len(personal) - 5]["text"] is None
    assert pii.span_digests(df.limit(0)).count() == 0


def test_personal_spans_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd"), (1, None)], "doc_id long, text string")
    assert sorted(r["spans"] for r in pii.span_digests(df).collect()) == ["", "email:0:6", "email:0:6", "email:0:6"]


def test_personal_data_of_the_table(spark, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op11_pii"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base_of(r["text"]))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
