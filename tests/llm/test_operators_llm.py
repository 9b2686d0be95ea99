"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, extra columns, empty tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from graphloom.llm import arrays as A
from graphloom.llm import bpe, embedding_dedup, fingerprint, jaccard_join, packing, quality, repeats, substring_dedup, suffix_dedup, toxicity, url_filter
from graphloom.llm.tokenizer import load_ranks

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    shared = sentence(rng, 70)
    base = [sentence(rng, rng.choice([3, 19, 20, 40, 150])) for _ in range(40)]
    near = base[4:10] + [" ".join(w if rng.random() > 0.01 else "changed" for w in b.split()) for b in base[4:30]]
    texts = base + near + [f"{sentence(rng, 10)} {shared}\n{sentence(rng, 9)}" for _ in range(12)]
    texts += [None, "", "   ", "word", "word", "Word", sentence(rng, 6000), "same " * 300, "é" * 700, "é" * 700, base[0], base[0]]
    rng.shuffle(texts)
    return [(k * 3, t) for k, t in enumerate(texts)]


def docs(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit(1) for c in extra.split()})


CLASHES = "bucket key score blob target component _one set_id zipped"


def test_substring_dedup(spark, corpus):
    want = brute.kept_words(corpus, 20)
    got = {r["doc_id"]: r for r in substring_dedup.repeated_word_digests(docs(spark, corpus, CLASHES)).collect()}
    assert len(got) == len(corpus)
    for (i, _), (w, kept, n) in zip(corpus, want):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), n, brute.sha(" ".join(kept).encode())), i
    whole = {r["doc_id"]: r for r in substring_dedup.without_repeated_words(docs(spark, corpus, "n_chars bucket")).collect()}
    for (i, t), (w, kept, n) in zip(corpus, want):
        assert whole[i]["text"] == (" ".join(kept) if n else t)
        assert whole[i]["n_chars"] == (len(" ".join(kept)) if n else 1) and whole[i]["bucket"] == 1


def test_substring_dedup_repeated_ids_and_empty(spark):
    long = sentence(random.Random(1), 50)
    rows = [(1, long), (1, long), (None, long), (2, None)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.repeated_word_digests(docs(spark, rows)).collect())
    assert got == [(-1, 0), (1, 50), (1, 50), (2, 0)]
    assert substring_dedup.repeated_word_digests(docs(spark, [])).count() == 0


def test_suffix_dedup(spark, corpus):
    want = brute.repeated_bytes([t for _, t in corpus], 200)
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_byte_digests(docs(spark, corpus, CLASHES)).collect()}
    for (i, _), w in zip(corpus, want):
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == w, i
    assert suffix_dedup.repeated_byte_digests(docs(spark, [])).count() == 0


def test_suffix_dedup_boundaries(spark):
    """Passages that end at different places around the same anchors."""
    rng = random.Random(9)
    core = "".join(rng.choices("abcdefgh", k=700))
    rows = []
    for k in range(40):
        a = rng.randrange(0, 350)
        b = a + rng.randrange(150, 350)
        rows.append((k, "".join(rng.choices("xyz", k=rng.randrange(30))) + core[a:b] + "".join(rng.choices("xyz", k=rng.randrange(30)))))
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_byte_digests(docs(spark, rows)).collect()}
    for (i, _), w in zip(rows, brute.repeated_bytes([t for _, t in rows], 200)):
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == w, i


def test_substring_dedup_boundaries(spark):
    rng = random.Random(10)
    core = [f"c{k}" for k in range(120)]
    rows = []
    for k in range(40):
        a = rng.randrange(0, 80)
        rows.append((40 - k, " ".join([f"x{rng.randrange(9)}" for _ in range(rng.randrange(8))] + core[a : a + rng.randrange(10, 40)] + ["y"] * rng.randrange(4))))
    got = {r["doc_id"]: r for r in substring_dedup.repeated_word_digests(docs(spark, rows)).collect()}
    for (i, _), (w, kept, n) in zip(rows, brute.kept_words(rows, 20)):
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (n, brute.sha(" ".join(kept).encode())), i


@pytest.mark.parametrize("wide,widest", [(1, 1 << 20), (0, 2)])
def test_runs_of_common_anchors_in_parts(spark, corpus, monkeypatch, wide, widest):
    """Halves, and the finest parts, give what whole runs give."""
    monkeypatch.setattr(repeats, "WIDE", wide)
    monkeypatch.setattr(repeats, "WIDEST", widest)
    test_substring_dedup(spark, corpus)
    test_suffix_dedup(spark, corpus)
    test_suffix_dedup_boundaries(spark)
    test_substring_dedup_boundaries(spark)


def test_common_phrase_in_many_contexts(spark):
    """A phrase of 25 words in 50,000 different surroundings."""
    rng, phrase = random.Random(5), " ".join(f"p{k}" for k in range(25))
    rows = [(k, f"{' '.join(f'a{rng.randrange(10**6)}' for _ in range(8))} {phrase} {' '.join(f'z{rng.randrange(10**6)}' for _ in range(8))}") for k in range(50_000)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_word_digests(docs(spark, rows)).collect()}
    assert got == {k: n for (k, _), (_, _, n) in zip(rows, brute.kept_words(rows, 20))} and min(got.values()) == 0 and got[49_999] >= 25


def test_repeats_with_clashing_names_and_other_ids(spark):
    long = sentence(random.Random(1), 50)
    rows = [("b", long, 1, 2), ("a", long, 3, 4), (None, long, 5, 6), (None, long, 7, 8), ("c", None, 9, 10), ("d", "", 11, 12)]
    df = spark.createDataFrame(rows, "name string, body string, _key int, _BUCKET int")
    got = substring_dedup.without_repeated_words(df, doc_id="name", text="body")
    assert got.columns == ["name", "body", "_key", "_BUCKET"]
    got = sorted(map(tuple, got.collect()), key=lambda r: r[2])
    # null ids come first, and neither of two at the same place gives way
    assert got == [("b", "", 1, 2), ("a", "", 3, 4), *rows[2:]]
    left = suffix_dedup.repeated_byte_digests(df, doc_id="name", text="body").collect()
    assert sorted(r["n_removed"] for r in left) == [0, 0] + [len(long)] * 4


def test_repeats_tell_runs_apart():
    """Equal hashes of different runs end the job; in the suffix sort they only make it start again."""
    ones = np.ones(2, np.int64)
    runs = repeats.Runs(np.zeros(2, np.uint64), np.zeros(2, np.uint64), ones, ones, ones, ones, ones, np.array([1, 2, 1, 3], np.uint8), np.array([0, 2, 4]))
    with pytest.raises(ArithmeticError):
        repeats._merge(runs)
    text = np.frombuffer(b"banana.bandana", np.uint8)
    at = np.arange(14)
    poor = A.Prefix(np.zeros(14, np.uint64))
    order, lcp = suffix_dedup.neighbours(text, poor, at, 14 - at, np.zeros(14, np.int64))
    raw = bytes(text)
    assert [raw[k:] for k in order] == sorted(raw[k:] for k in range(14))
    assert lcp[0] == -1 and max(lcp) == 3


def test_jaccard(spark, corpus):
    rows = corpus + [(None, "null id text"), (None, "null id text"), (3, "repeated id")]
    got = sorted(map(tuple, jaccard_join.similarity_classes(docs(spark, rows, CLASHES)).collect()), key=str)
    assert got == sorted(brute.jaccard_components(rows), key=str)
    assert jaccard_join.similarity_classes(docs(spark, [])).count() == 0


def test_jaccard_large_group_and_pivots(spark, monkeypatch):
    """A group of near copies, with chains and outsiders under shared keys, through the pivot path."""
    monkeypatch.setattr(jaccard_join, "PIVOT_PAIRS", 2)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(40):
        w = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3])):
            w[at] = f"n{rng.randrange(1000)}"
        rows.append((100 - k, " ".join(w)))
    for k in range(25):
        rows.append((200 + k, " ".join(base[k : k + rng.choice([5, 6, 7])])))
    got = sorted(map(tuple, jaccard_join.similarity_classes(docs(spark, rows)).collect()))
    assert got == sorted(brute.jaccard_components(rows))


def test_jaccard_hot_group_without_links(spark, monkeypatch):
    """5,000 texts near one another, most of them not linked: what pivots leave is compared block by block."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 900)
    rng = random.Random(12)
    base, rows, have = [f"b{k}" for k in range(64)], [], np.zeros((5000, 60), np.float32)
    for i in range(5000):
        at = sorted(rng.sample(range(64), rng.choice([1, 2, 2, 3, 3, 4, 5])))
        rows.append((i, " ".join(f"n{i}x{k}" if k in at else w for k, w in enumerate(base))))
        have[i] = [not any(s <= k < s + 5 for k in at) for s in range(60)]
    both = have @ have.T
    parent = list(range(5000))
    for a, b in zip(*np.nonzero(180 * both >= 80 * 120)):
        x, y = brute.find(parent, int(a)), brute.find(parent, int(b))
        parent[max(x, y)] = min(x, y)
    got = sorted(map(tuple, jaccard_join.similarity_classes(docs(spark, rows)).collect()))
    assert got == [(i, 60, brute.find(parent, i)) for i in range(5000)]
    assert len({c for _, _, c in got}) > 2500


def test_jaccard_names_that_collide(spark, monkeypatch):
    """Two sets under one name make all names anew."""
    plain = jaccard_join.set_ids

    def poor(h, begin, salt=0):
        return np.where(np.diff(begin) > 0, np.uint64(2), np.uint64(0)) if salt == 0 else plain(h, begin, salt)

    monkeypatch.setattr(jaccard_join, "set_ids", poor)
    salts = []
    found = jaccard_join._sets
    monkeypatch.setattr(jaccard_join, "_sets", lambda m: salts.append(m) or found(m.withColumn("set_id", F.lit(2).cast("long")) if len(salts) < 2 else m))
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "q r s t u v w")]
    assert sorted(map(tuple, jaccard_join.similarity_classes(docs(spark, rows)).collect())) == [(1, 2, 1), (2, 2, 1), (3, 3, 3)]
    assert len(salts) == 2


def test_merged_components():
    rng = np.random.default_rng(2)
    for _ in range(30):
        left, right = rng.integers(0, 30, 40), rng.integers(0, 30, 300)
        close = rng.random((40, 300)) < 0.003
        parent = list(range(30))
        for a, b in zip(*np.nonzero(close)):
            x, y = brute.find(parent, left[a]), brute.find(parent, right[b])
            parent[max(x, y)] = min(x, y)
        moved, to = jaccard_join.merged_components(close, left, right)
        assert dict(zip(moved.tolist(), to.tolist())) == {k: int(brute.find(parent, k)) for k in range(30) if brute.find(parent, k) != k}


def test_signatures_lose_no_pair():
    """Any two sets of similarity 0.8 or more share a key of which one is a probe."""
    rng = random.Random(8)
    bands = jaccard_join.Bands(80, 100, 400)
    for _ in range(300):
        n = rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 15, 30, 60, 120])
        a = {rng.getrandbits(63) for _ in range(n)}
        b = set(a)
        while True:
            c = set(b)
            (c.discard(rng.choice(sorted(c))) if rng.random() < 0.5 and len(c) > 1 else c.add(rng.getrandbits(63)))
            if len(a & c) * 100 < 80 * len(a | c):
                break
            b = c
            if rng.random() < 0.05:
                break
        h = np.array(sorted(a) + sorted(b), np.uint64)
        who, key, flag = jaccard_join.signatures(h, np.array([0, len(a), len(a) + len(b)]), bands)
        keys = [{int(k) for k in key[who == s]} for s in (0, 1)]
        probes = {int(k) for k in key[flag > 0]}
        assert keys[0] & keys[1] & probes or a == b, (len(a), len(b))


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(6, 16))
    x = np.concatenate([centre[k] + rng.normal(size=(25, 16)) * s for k, s in zip(range(6), (0.05, 0.1, 0.2, 0.3, 0.4, 0.02))])
    x = np.concatenate([x, x[:5], x[:3] * 2, [x[0]] * 10])
    ids = rng.permutation(len(x)) * 2
    odd = [(1001, None), (1003, []), (1005, [0.0] * 16), (1007, [float("nan")] * 16), (1009, [float("inf")] + [1.0] * 15), (1011, [1.0, 0.0]), (1013, [None] + [1.0] * 15), (1015, [2.0, 0.0])]
    rows = [(int(i), [float(f) for f in np.float32(v)]) for i, v in zip(ids, x)] + odd + [(None, [float(f) for f in np.float32(x[0])])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("k", "block", "links", "component")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, block=32, sample=50).collect()}
    y = np.float32(x).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    close = y @ y.T >= 0.9
    np.fill_diagonal(close, False)
    parent = list(range(len(x)))
    for a, b in zip(*np.nonzero(close)):
        p, q = brute.find(parent, a), brute.find(parent, b)
        parent[q] = p
    for a, i in enumerate(ids):
        least = min(int(ids[b]) for b in range(len(x)) if brute.find(parent, b) == brute.find(parent, a))
        assert got[int(i)] == (int(close[a].sum()), least, int(i) == least)
    for i, _ in odd[:5] + odd[6:7]:
        assert got[i] == (0, i, True)
    assert got[1011] == (1, 1011, True) and got[1015] == (1, 1011, False) and got[None] == (0, None, False)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0


def test_embeddings_at_the_threshold(spark):
    """Cosines of exactly 0.9 link, whatever the sums round to; components far from 1 are no matter."""
    rows = [(1, [10.0, 0.0, 0.0, 0.0, 0.0]), (2, [9.0, 4.0, 1.0, 1.0, 1.0]), (3, [0.0, 0.0, 0.0, 0.0, 1e-30]), (4, [0.0, 0.0, 0.0, 0.0, 3e30]), (5, [9.0, 4.0, 1.0, 1.0, 1.0001])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = sorted(map(tuple, embedding_dedup.near_duplicates(df, directions=2).collect()))
        assert got == [(1, 1, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 1, False)]


def test_leaves_skip_only_what_is_far():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 32))
    raw = np.float32(centre[rng.integers(0, 40, 1500)] + 0.15 * rng.normal(size=(1500, 32)))
    axes = embedding_dedup.principal_directions(raw.astype(float), 8)
    own = embedding_dedup.Block(raw, axes, np.ones(1500, np.int64))
    order = np.lexsort(np.floor(own.shade / 0.45).T[::-1])
    own = embedding_dedup.Block(raw[order], axes, np.ones(1500, np.int64))
    links, root, (pairs, near, whole) = embedding_dedup.join_blocks(own, own, 0.9, 0.4473, True)
    close = own.unit @ own.unit.T >= 0.9
    assert (links == close.sum(axis=1) - 1).all() and links.sum() > 1500
    assert whole < near / 3 and near <= pairs + 1500 * 256


def test_urls(spark):
    rules = url_filter.rules_frame(spark, [("com", "/en/", "block"), ("a.com", "/en/7", "allow"), ("b.com", "/x", "allow"), ("b.com", "/x", "block"), (None, "/", "block"), ("c.com", None, "block"), ("d.com", "", "block")])
    urls = {
        "http://A.com/en/7?q": ("a.com", "/en/7", "a.com/en/7", "allow"),
        "https://www.a.com/en/8#x": ("www.a.com", "/en/8", "com/en/", "block"),
        "http://xa.com/en/7": ("xa.com", "/en/7", "com/en/", "block"),
        "http://b.com/xyz": ("b.com", "/xyz", "b.com/x", "block"),
        "http://b.com": ("b.com", "", None, "allow"),
        "no scheme/en/": ("", "", None, "allow"),
        "http://d.com": ("d.com", "", "d.com", "block"),
        "http://com/en/://b.com/x": ("com", "/en/://b.com/x", "com/en/", "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://" + "s." * 500 + "com/en/" + "y" * 5000: ("s." * 500 + "com", "/en/" + "y" * 5000, "com/en/", "block"),
    }
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "url string").withColumns({c: F.lit("z") for c in ("rule", "at_host", "digest", "won")})
    for limit in (200_000, 0):  # broadcast and shuffled rules
        rows = url_filter.judge_urls(df, rules, broadcast_rules=limit).collect()
        assert len(rows) == len(urls) + 1
        for r in rows:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["url"]]
            assert (r["at_host"], r["digest"], r["won"]) == ("z", "z", "z")
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_urls_with_long_and_many_rules(spark):
    """No rule is too long, and rules may have any number of lengths."""
    long = "/" + "p" * 4500
    rules = url_filter.rules_frame(spark, [("a.com", long, "block"), ("a.com", "", "allow")] + [("b.com", "/" + "q" * k, "block" if k % 2 else "allow") for k in range(300)])
    urls = {"http://x.a.com" + long + "z": "block", "http://a.com/p": "allow", **{"http://b.com/" + "q" * k: "block" if k % 2 else "allow" for k in range(0, 300, 7)}, "http://b.com/" + "q" * 400: "block"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r["url"]: r["verdict"] for r in url_filter.judge_urls(df, rules).collect()} == urls


def test_bpe(spark, corpus):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(BPE_RANKS), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.round_trip_digests(docs(spark, corpus, CLASHES), BPE_RANKS, public_tokenizers.PATTERN).collect():
        t = dict(corpus)[r["doc_id"]] or ""
        ids = theirs.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))
    both = bpe.decode_documents(bpe.encode_documents(docs(spark, corpus, "ids decoded"), BPE_RANKS), BPE_RANKS)
    for r in both.collect():
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.round_trip_digests(docs(spark, []), BPE_RANKS).count() == 0


def test_packing(spark, corpus):
    tokenizer = Tokenizer.from_file(BPE_JSON)
    rows = corpus + [(999, "a <|endoftext|> b"), (None, "x")]
    packed = packing.pack_documents(docs(spark, rows, CLASHES), BPE_JSON, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == ids
        assert [r["start"] for r in mine] == [sum(q["length"] for q in mine[:k]) for k in range(len(mine))]
        assert all(r["length"] == 2048 for r in mine[1:]) and mine[0]["length"] <= 2048
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    total = 0
    for s in by_sequence.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(q["length"] for q in s[:k]) for k in range(len(s))]
        assert sum(r["length"] for r in s) <= 2048
        total += sum(r["length"] for r in s)
    assert len(by_sequence) <= total / 2048 + 6  # one open sequence a task
    assert packing.pack_documents(docs(spark, []), BPE_JSON).count() == 0
    bound = packing.pack_documents(docs(spark, rows), BPE_JSON, max_documents=3, max_cost=60_000.0).collect()
    by_sequence = {}
    for r in bound:
        by_sequence.setdefault(r["sequence_id"], []).append(r["length"])
    assert max(map(len, by_sequence.values())) == 3 and len(bound) == len(packed)
    assert all(sum(n * n for n in s) <= 60_000 or len(s) == 1 for s in by_sequence.values())


def test_fingerprints(spark, corpus):
    rows = sorted(corpus)
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(docs(spark, corpus, CLASHES)).collect()}
    assert len(got) == len(rows)
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        t, follow = texts[k], texts[(k + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if edited == t:
            assert got[i]["near_edited"] == 1.0
        assert 0 <= got[i]["near_next"] <= 1
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    # the likeness that it estimates: generalised Jaccard similarity of the shingles with their counts
    errors = []
    for k, (i, _) in enumerate(rows):
        t, follow = texts[k], texts[(k + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        for name, other in (("near_edited", edited), ("near_next", follow)):
            if t.split() and other.split():
                errors.append(got[i][name] - brute.weighted_jaccard(t, other))
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.35 and np.sqrt(np.mean(np.square(errors))) < 0.06
    alone = fingerprint.compare_with_next(docs(spark, [(5, "just one text")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    odd = fingerprint.compare_with_next(docs(spark, [(1, "a"), (1, "b"), (None, None), (0, "c")])).collect()
    assert len(odd) == 4
    assert fingerprint.compare_with_next(docs(spark, [])).count() == 0
    named = fingerprint.fingerprint_documents(docs(spark, rows, "fingerprint")).collect()
    assert all(r["fingerprint"] == got[r["doc_id"]]["fingerprint"] for r in named)


def test_fingerprints_of_hot_ids(spark):
    """A third of the rows without an id, a third the same row: ranges of hashes, equal rows counted."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(k, sentence(rng, 12)) for k in range(1, 200)] + [(None, sentence(rng, 12)) for _ in range(150)] + [(None, None)] * 50
    rows += [(77, "the same row again and again")] * 1500
    df = docs(spark, rows)
    got = [tuple(r) for r in fingerprint.compare_with_next(df, each=20).collect()]
    # the order that the ranges stand for: ids, nulls last, and of one id the hashes of the texts
    hashes = {r["t"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, x[0] or 0, hashes[x[1]]))
    texts = [t for _, t in order]
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, t), e in zip(order, edited, strict=True)]
    same = 77  # the one text of its own under this id has a place told by its hash, as the others
    assert sum(i == same for i, _ in order) == 1501
    assert sorted(map(str, (g[:3] for g in got))) == sorted(map(str, want))
    sig = {t: fingerprint._hex(fingerprint.signatures([t.encode()]))[0] for t in {*texts, *edited}}
    assert sorted((g[3], g[4]) for g in got) == sorted((sig[t], sig[e]) for t, e in zip(texts, edited, strict=True))
    assert sum(g[6] == 1.0 for g in got) >= 1499


def test_long_vectors_make_shorter_blocks(spark, monkeypatch):
    """Blocks are bounded by their numbers; the links stay."""
    from graphloom.llm import embedding_dedup

    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 96))
    vectors = np.concatenate([base, base + 0.2 * rng.normal(size=base.shape), base + 0.5 * rng.normal(size=base.shape), rng.normal(size=(350, 96))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = [tuple(r) for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()]
    monkeypatch.setattr(embedding_dedup, "BLOCK_VALUES", 96 * 300)
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()] == want
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert [r[1] for r in want] == ((unit @ unit.T >= 0.9).sum(axis=1) - 1).tolist() and max(r[1] for r in want) >= 1


def test_classifiers(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(500):
        toxic, poor = k % 5 == 0, k % 7 == 0
        words = sentence(rng, 60).split()
        if toxic:
            words[rng.randrange(60)] = rng.choice(["nasty", "vile"])
        rows.append((k, " ".join(w.upper() + "!!" if poor else w for w in words)))
        labels.append((k, int(not poor), int(toxic)))
    rows += [(1000, None), (1001, ""), (1001, "nasty"), (None, "vile vile")]
    labels += [(3, None, None), (None, 1, 1), (4, 1, 0)]
    df = docs(spark, rows, "score label _id x")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(df, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, model).collect()}
    held = [k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 5 == 0) for k in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    rank = quality.fit_quality(df, marks)
    good = {r["doc_id"]: r["score"] for r in quality.score_quality(df, rank).collect()}
    assert np.mean([(good[k] >= 0.3) == (k % 7 != 0) for k in held]) > 0.95
    assert all(0 <= s <= 1 for s in good.values())
    none = marks.limit(0)
    assert {r["score"] for r in toxicity.score_toxicity(df, toxicity.fit_toxicity(df, none)).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), quality.fit_quality(df, none)).count() == 0


@pytest.fixture(scope="module")
def colliding_words():
    """Pairs of words whose 64-bit hashes agree in their upper 32 bits."""
    words = [f"word{k}" for k in range(400_000)]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end, _ = A.words(raw, np.array([0, len(raw)]))
    high = A.word_hashes(raw, start, end) >> np.uint64(32)
    order = np.argsort(high, kind="stable")
    same = np.flatnonzero(high[order][1:] == high[order][:-1])
    return [(words[order[k]], words[order[k + 1]]) for k in same]


def test_substring_dedup_tells_colliding_words_apart(spark, colliding_words):
    """Documents that differ only in words with alike hashes keep all their words."""
    assert len(colliding_words) > 5
    rng = random.Random(2)
    rows = []
    for a, b in colliding_words[:8]:
        lead = sentence(rng, 19)
        rows += [(len(rows), f"{lead} {a}"), (len(rows) + 1, f"{lead} {b}"), (len(rows) + 2, f"{lead}\n{a} end")]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_word_digests(docs(spark, rows)).collect()}
    for (i, _), (w, kept, n) in zip(rows, brute.kept_words(rows, 20)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), n, brute.sha(" ".join(kept).encode())), i
    assert sum(r["n_removed"] for r in got.values()) == 8 * 20


def test_automaton_numbers_words_by_their_bytes(colliding_words):
    """Runs of one anchor in one shard whose last words have alike hashes share no window."""
    a, b = (" ".join([*(f"x{k}" for k in range(19)), w, ""]).encode() for w in colliding_words[0])
    ones = np.ones(2, np.int64)
    text = np.frombuffer(a + b, np.uint8)
    runs = repeats.Runs(np.zeros(2, np.uint64), np.arange(2).astype(np.uint64), ones, ones, np.arange(2), ones, ones, text, np.array([0, len(a), len(a) + len(b)]))
    which, lo, hi, doc, start = substring_dedup.earliest_windows(runs, 20)
    assert list(zip(which, doc)) == [(0, 0), (1, 1)]


def test_rows_without_text_lie_anywhere(spark):
    """A third of all rows with null ids and texts is spread over buckets, and none is lost."""
    rows = [(None, None)] * 300 + [(None, "")] * 100 + [(k, f"{k} {sentence(random.Random(3), 25)}") for k in range(600)]
    got = substring_dedup.repeated_word_digests(docs(spark, rows)).collect()
    assert len(got) == 1000 and sum(r["n_removed"] > 0 for r in got) == 599
    assert sum(r["doc_id"] is None for r in got) == 400


def test_sample_is_bounded_whatever_repeats(spark):
    from graphloom.llm.linear import fold, sample_rows

    rows = [(7, f"text {k % 900}") for k in range(5000)] + [(k, "x" * 50) for k in range(100, 400)] + [(None, "n"), (3, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in [7, 3, *range(100, 400)]] + [(7, 1), (7, 0)], "doc_id long, toxic int")
    seven = spark.range(1).select((fold(F.lit(7)) != 0).alias("in")).first()["in"]
    got = sample_rows(docs(spark, rows), labels, "toxic", "doc_id", "text", 100, 1 << 20).collect()
    assert len(got) == 100 and len({r["_id"] for r in got}) == 100
    every = sample_rows(docs(spark, rows), labels, "toxic", "doc_id", "text", 1000, 1 << 20).collect()
    assert sum(r["_id"] == 7 for r in every) == seven and all(r["label"] == (1 if r["_id"] == 7 else r["_id"] % 2) for r in every)
    assert sum(len(r["text"]) for r in sample_rows(docs(spark, rows), labels, "toxic", "doc_id", "text", 1000, 2000).collect()) <= 2000


def test_a_pivot_with_partners_in_many_buckets(spark, monkeypatch):
    """One text is sent to all its partners' buckets, few buckets a copy."""
    monkeypatch.setattr(jaccard_join, "SENDS", 3)
    rng = random.Random(11)
    base = sentence(rng, 120, 10_000).split()
    rows = [(k, " ".join([*base[: k % 40], f"new{k}", *base[k % 40 :]])) for k in range(150)] + [(200 + k, sentence(rng, 60)) for k in range(20)]
    got = sorted(tuple(r) for r in jaccard_join.similarity_classes(docs(spark, rows)).collect())
    assert got == sorted(brute.jaccard_components(rows))


def test_quality_is_learnt_from_every_labelled_row(spark, monkeypatch):
    """Mean, pairs and threshold are of all rows outside fold 0, in groups with few of the rarer label too."""
    from graphloom.llm.linear import form_features

    rng = random.Random(3)
    rows = [(k, (lambda t: t.upper() if k % 9 == 0 else t)(sentence(rng, 12))) for k in range(12000)]
    marks = spark.createDataFrame([(k, int(k % 9 != 0)) for k, _ in rows], "doc_id long, quality int")
    monkeypatch.setattr(quality, "GROUP_ROWS", 100)
    rank = quality.fit_quality(docs(spark, rows), marks)
    kept = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 5]
    y = np.array([k % 9 != 0 for k, _ in kept])
    texts = [t.encode() for _, t in kept]
    x = form_features(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert len(kept) > 8000 and np.allclose(rank.mean, x.mean(axis=0)) and np.allclose(rank.scale, x.std(axis=0) + 1e-3)
    s = np.sort((x - rank.mean) / rank.scale @ rank.weights)
    k = int((~y).sum())
    assert abs(rank.threshold - (s[k - 1] + s[k]) / 2) < 1e-9
    assert ((((x - rank.mean) / rank.scale @ rank.weights) > rank.threshold) == y).all()
