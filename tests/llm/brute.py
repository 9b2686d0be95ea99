"""Plain forms of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def kept_words(rows, length):
    """Indices of the words that stay, by position in rows [(doc_id, text)]."""
    places = defaultdict(list)
    words = [WORD.findall(t or "") for _, t in rows]
    for (doc, _), w in zip(rows, words):
        for s in range(len(w) - length + 1):
            places[tuple(w[s : s + length])].append((doc, s))
    first = {w: min(p) for w, p in places.items()}
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (doc, s):
                gone.update(range(s, s + length))
        out.append((w, [x for k, x in enumerate(w) if k not in gone], len(gone)))
    return out


def repeated_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = set()
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone.update(range(s, s + length))
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((len(b), len(gone), spans, sha(bytes(c for k, c in enumerate(b) if k not in gone))))
    return out


def shingle_set(text, size=5):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def weighted_jaccard(a, b, size=5):
    """Sum of the least over sum of the largest counts of all shingles."""
    x, y = (Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) for w in (WORD.findall(t.translate(LOW)) for t in (a, b)))
    return sum((x & y).values()) / sum((x | y).values())


def ftrl(rows, alpha, beta, l1, l2, order, heavy):
    """FTRL-proximal by the book, one coordinate after another; "bias" is in every row and has no L1 penalty."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        bound = 0.0 if k == "bias" else l1
        if abs(z[k]) <= bound:
            return 0.0
        return -(z[k] - math.copysign(bound, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for t in order:
        x, y = [*rows[t][0], "bias"], rows[t][1]
        w = {k: weight(k) for k in x}
        g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (heavy if y else 1.0)
        for k in x:
            sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
            z[k] += g - sigma * w[k]
            n[k] += g * g
    return {k: weight(k) for k in z if weight(k)}


def bradley_terry(x, y, steps, l2):
    """Gradient descent on the mean logistic loss over all preference pairs."""
    pairs = [[a - b for a, b in zip(u, v)] for u, p in zip(x, y) for v, q in zip(x, y) if p > q]
    w = [0.0] * len(x[0])
    for _ in range(steps):
        g = [l2 * c for c in w]
        for d in pairs:
            p = 1 / (1 + math.exp(sum(a * b for a, b in zip(d, w))))
            g = [c - p * a / len(pairs) for c, a in zip(g, d)]
        w = [c - 0.5 * a for c, a in zip(w, g)]
    return w


def jaccard_components(rows, num=80, den=100):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(parent, k)].append(k)
    least = {r: min((rows[k][0] for k in m if rows[k][0] is not None), default=None) for r, m in groups.items()}
    return [(rows[k][0], len(sets[k]), least[find(parent, k)]) for k in range(len(rows))]
