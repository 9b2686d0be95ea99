"""Kernels without Spark."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from graphloom.llm import arrays as A
from graphloom.llm import fingerprint, linear, packing, suffix_dedup
from graphloom.llm.substring_dedup import SuffixAutomaton
from graphloom.llm.tokenizer import BytePairEncoder, Splitter, load_ranks

TEXT = st.text(st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\t\x0b é", max_size=12)), max_size=8))
def test_words(texts):
    data, off = A.flat(pa.array(texts, pa.string()))
    start, end, first = A.words(data, off)
    got = [[bytes(data[s:e]).decode() for s, e in zip(start[a:b], end[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [regex.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 6), st.integers(1, 4))
def test_minimizers(values, width, gram):
    values = A.salted(np.array(values, np.uint64), 1)
    n = max(0, len(values) - width - gram + 2)
    prefix = A.Prefix(values)
    at = np.arange(n + width - 1 if n else 0)
    h = prefix.of(at, at + gram)
    anchor, first, last = A.minimizers(h, np.array([n]), width)
    got = {s: int(a) for a, f, e in zip(anchor, first, last) for s in range(f, e + 1)}
    assert sorted(got) == list(range(n))
    for s, a in got.items():
        window = (h[s : s + width] >> np.uint64(20)).tolist()
        assert a == s + window.index(min(window))


@pytest.fixture(scope="module")
def bpe():
    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return BytePairEncoder(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_exact(bpe):
    mine, theirs = bpe
    split = Splitter(public_tokenizers.PATTERN)
    rng = random.Random(5)
    alphabet = ["a", "e", " ", "th", "ing", "é", "中", "ß", "'s", "'", "1", "½", "\n", "  ", "\x85", "!'", "́", "😀", "\x1c", "İ"]
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        ids = [i for p in split(t) for i in mine.encode_piece(p.encode())]
        assert ids == theirs.encode_ordinary(t)
        assert mine.decode(ids).decode() == t
    for p in ("a" * 4000, "中" * 2000, "ab" * 2000):
        assert mine.encode_piece(p.encode()) == theirs.encode_ordinary(p)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_splitter(text):
    assert Splitter()(text) == regex.findall(public_tokenizers.PATTERN, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 8), st.sampled_from(["dot", "norm"]))
def test_best_fit(lengths, documents, by):
    sizes = np.array(lengths, np.int64)
    where, offset = packing.best_fit(sizes, 50, documents, 50.0**2, by=by)
    for s in set(where.tolist()):
        mine = np.flatnonzero(where == s)
        mine = mine[np.argsort(offset[mine])]
        assert len(mine) <= documents
        assert (offset[mine] == np.concatenate([[0], np.cumsum(sizes[mine])[:-1]])).all()
        assert sizes[mine].sum() <= 50 and (sizes[mine] ** 2).sum() <= 50.0**2 + 1e-6


def test_pieces():
    assert packing.pieces(5, 10) == [(0, 5)]
    assert packing.pieces(20, 10) == [(0, 10), (10, 10)]
    assert packing.pieces(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_attention_cost_binds():
    where, _ = packing.best_fit(np.array([10, 10, 10]), 100, 100, 150.0)
    assert len(set(where.tolist())) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=20), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=20), st.integers(1, 6))
def test_matching_statistics(references, stream, most):
    automaton = SuffixAutomaton()
    for r in references:
        automaton.add(r)
    has = lambda x: any(x == r[k : k + len(x)] for r in references for k in range(len(r) - len(x) + 1))
    for k, (_, size) in enumerate(automaton.matches(stream, most)):
        want = max(n for n in range(min(most, k + 1) + 1) if n == 0 or has(stream[k + 1 - n : k + 1]))
        assert size == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", max_size=8)), max_size=30))
def test_suffix_merge_sort(items):
    items.sort(key=lambda x: x[0])
    text = np.frombuffer("".join(t for _, t in items).encode() or b"x", np.uint8)
    size = np.array([len(t) for _, t in items], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
    group = np.array([g for g, _ in items], np.int64)
    order, lcp = suffix_dedup.neighbours(text, A.Prefix(A.BYTE[text]), at, size, group)
    assert [items[k] for k in order] == sorted(items)
    for k in range(1, len(order)):
        (g, a), (h, b) = items[order[k - 1]], items[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (n if g == h else -1)


def test_fingerprint_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(20):
            n = 400
            words = [f"w{rng.integers(1 << 40)}" for _ in range(n)]
            other = words[: int(n * share)] + [f"v{rng.integers(1 << 40)}" for _ in range(n - int(n * share))]
            twice = " ".join(words + words[:50])
            a, b = fingerprint.signatures([twice.encode(), " ".join(other).encode()], shingle=1)
            m = int(n * share)
            least = m
            most = n + 50 + n - m
            errors.append(float((a == b).mean()) - least / most)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_fingerprint_edges():
    a = fingerprint.signatures([b"", b"  ", b"one", b"one", ("x " * 9000).encode()])
    assert (a[0] == 0).all() and (a[1] == 0).all() and (a[2] == a[3]).all() and a[4].any()


def test_ftrl_and_ranking_learn():
    rng = np.random.default_rng(2)
    rows = [(np.unique(np.append(rng.integers(10, 4000, 30), [3] if k % 4 == 0 else [])).astype(np.int64), int(k % 4 == 0)) for k in range(800)]
    model = linear.ftrl(rows, 12, 2, 1, 1.0, 1.0, 5.0, 0.0, 4)
    dense = model.dense()
    assert np.mean([(model.bias + dense[x].sum() >= 0) == (y == 1) for x, y in rows]) > 0.97
    assert len(model.slots) < 600
    assert len(linear.ftrl([], 12, 2, 1, 1.0, 1.0, 5.0, 0.0, 1).slots) == 0
    x = rng.normal(size=(400, 6))
    y = (x[:, 2] > 0.5).astype(int)
    w = linear.bradley_terry(x, y)
    s = x @ w
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) > 0.98


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 60, 8)), int(rng.random() < 0.3)) for _ in range(200)]
    rows = [(np.unique(np.append(x, 7)) if y else x, y) for x, y in rows]
    model = linear.ftrl(rows, 6, 2, 1, 0.5, 1.0, 1.5, 0.1, 3, seed=3)
    draw = np.random.default_rng(3)
    order = [int(k) for _ in range(3) for k in draw.permutation(len(rows))]
    ones = sum(y for _, y in rows)
    want = brute.ftrl([([int(k) for k in x], y) for x, y in rows], 0.5, 1.0, 1.5, 0.1, order, min(4.0, max(1.0, (200 - ones) / ones)))
    assert model.bias == pytest.approx(want.pop("bias"))
    assert {int(k): v for k, v in zip(model.slots, model.values)} == pytest.approx(want)


def test_bradley_terry_against_all_pairs():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    y = (x @ [1.0, -0.5, 0.2] + rng.normal(size=40) * 1.5 > 0).astype(int)
    mine = linear.bradley_terry(x, y, steps=4000, l2=0.05)
    want = np.array(brute.bradley_terry(x.tolist(), y.tolist(), 300, 0.05))
    assert np.abs(mine - want).max() < 0.05 * np.abs(want).max() + 0.03


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 40), max_size=25), max_size=3), st.integers(1, 6), st.integers(200, 1600), st.sampled_from(["dot", "norm"]))
def test_packer_against_a_plain_loop(batches, documents, cost, by):
    """Three capacities that bind: every piece goes where a plain search over all sequences puts it."""
    limit, weights = (40, documents, float(cost)), (1.0, 0.7, 0.4)
    packer = packing.Packer(*limit, weights, by)
    held = []  # lengths in each sequence
    for lengths in [[1], *batches]:  # a piece of 1 keeps all but full sequences open
        where, offset = packer.place(np.array(lengths, np.int64))
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            n, best = lengths[i], None
            need = (n / limit[0], 1 / limit[1], n * n / limit[2])
            for k, h in enumerate(held):
                left = (1 - sum(h) / limit[0], 1 - len(h) / limit[1], 1 - sum(x * x for x in h) / limit[2])
                if all(r >= q - 1e-9 for r, q in zip(left, need)):
                    score = sum(w * (r * q if by == "dot" else (r - q) ** 2) for w, r, q in zip(weights, left, need))
                    if best is None or score < best[0] - 1e-9:
                        best = (score, k)
            at = best[1] if best else len(held)
            if at == len(held):
                held.append([])
            mine = int(where[i])
            if mine != at:  # equal scores may differ in the last digit
                h = held[mine]
                left = (1 - sum(h) / limit[0], 1 - len(h) / limit[1], 1 - sum(x * x for x in h) / limit[2])
                assert sum(w * (r * q if by == "dot" else (r - q) ** 2) for w, r, q in zip(weights, left, need)) == pytest.approx(best[0])
            assert offset[i] == sum(held[mine])
            held[mine].append(n)
    for h in held:
        assert sum(h) <= 40 and len(h) <= documents and (sum(x * x for x in h) <= cost or len(h) == 1)
