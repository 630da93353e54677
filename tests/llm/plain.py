"""Plain versions of the operators, row by row, for small tables."""

import hashlib
import itertools
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen |= kept
            out.append((i, keep, len(ids), kept, sha(t)))
    return sorted(out, key=repr)


def repeats(rows, length=50):
    first = {}
    for d, t in rows:
        b, d = (t or "").encode(), -(1 << 63) if d is None else d
        for i in range(len(b) - length + 1):
            g = b[i : i + length]
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        b, own = (t or "").encode(), -(1 << 63) if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < own:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def shingles(text, words):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}


def near(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def mix(rows, weights=(5, 2, 1), budget=1.5, most=2, seed=7):
    """rows: (doc_id, text, source). Weighted water-filling, then the seeded order, filled up document by document."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, capped = {}, set()
    while True:
        free = [s for s in sources if s not in capped]
        left = budget * sum(size) - sum(most * total[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * total[s]}
        if not over:
            target = {s: most * total[s] for s in capped} | share
            break
        capped |= over
    out = []
    for s in sources:
        own = sorted((order(d, seed), d, n) for n, (d, _, x) in zip(size, rows, strict=True) if x == s)
        left = round(target[s])
        flows = [min(total[s], left), max(0, left - total[s])]
        at = 0
        for _, d, n in own:
            out.append((d, n, total[s], target[s], sum(max(0, min(f, at + n) - min(f, at)) for f in flows)))
            at += n
    return out


def order(doc_id, seed):
    start = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), start)
    return h - (1 << 64) if h >> 63 else h


def quality(text, min_repeat=10):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    repeat = {k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(i, i + 3)}
    failed = n < 50 or 100 * len(repeat) > 50 * n
    longest, covered = 0, set()
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= min_repeat:
                longest = max(longest, k)
                covered |= set(range(i, i + k)) | set(range(j, j + k))
    kept = not failed and 100 * len(covered) <= 25 * n and 100 * longest <= 15 * n
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat), failed, kept


def terms(rows, base_spans, deviations=1.0, min_share=0.5, min_bits=6.0):
    """Disclosing terms by the definition: rows (id, text); equal texts count once; base_spans(text) gives (start, kind, end)."""
    texts = {t or "" for _, t in rows}
    word = re.compile(r"[^\W_]{3,}")
    split = re.compile(r"[\W_]+")
    held = {t: set(filter(None, split.split(t.lower()))) for t in texts}
    near = {}
    entities = {}
    for t in texts:
        spans = base_spans(t)
        found = {(k, t[a:b].lower() if k < 2 else "".join(c for c in t[a:b] if c in "0123456789")) for a, k, b in spans}
        rest = list(t)
        for a, _, b in spans:
            rest[a:b] = "\0" * (b - a)
        words = {m[0].lower() for m in word.finditer("".join(rest))}
        for e in found:
            entities[e] = entities.get(e, 0) + 1
            for w in words:
                near[e, w] = near.get((e, w), 0) + 1
    out = set()
    z = deviations
    for (e, w), both in near.items():
        of = sum(w in h for h in held.values())
        p = both / of
        low = (p + z * z / (2 * of) - z * (p * (1 - p) / of + z * z / (4 * of * of)) ** 0.5) / (1 + z * z / of)
        if low >= min_share - 1e-9 and math.log2(low / (entities[e] / len(texts))) >= min_bits:
            out.add(w)
    return out


def boilerplate(pages, min_run=8, min_share=0.05, min_pages=3):
    """pages (host, blocks) of different contents: the blocks without what enough pages of the host share."""
    by, count = {}, {}
    for host, blocks in pages:
        by[host] = by.get(host, 0) + 1
        for run in {tuple(w[i : i + min_run]) for b in blocks for w in [b.split(" ")] for i in range(len(w) - min_run + 1)}:
            count[host, run] = count.get((host, run), 0) + 1
    out = []
    for host, blocks in pages:
        bound, kept = max(min_pages, -(-by[host] * min_share // 1)), []
        for b in blocks:
            w = b.split(" ")
            gone = set()
            for i in range(len(w) - min_run + 1):
                if by[host] >= min_pages and count[host, tuple(w[i : i + min_run])] >= bound:
                    gone |= set(range(i, i + min_run))
            left = " ".join(x for i, x in enumerate(w) if i not in gone)
            if left:
                kept.append(left)
        out.append("\n\n".join(kept))
    return out


def cheapest(patterns, quotas, most):
    """(words, cost) of the best routing by trying all: patterns (sources, words), small numbers only."""
    options = [[x for x in itertools.product(range(n * most + 1), repeat=len(m)) if sum(x) <= n * most] for m, n in patterns]
    best = (0, 0)
    for choice in itertools.product(*options):
        got = [0] * len(quotas)
        cost = 0
        for (m, n), x in zip(patterns, choice):
            for s, v in zip(m, x):
                got[s] += v
            left = sum(x)
            for level in range(most):
                step = min(left, n)
                cost, left = cost + step * level, left - step
        if all(g <= q for g, q in zip(got, quotas)):
            best = max(best, (sum(got), -cost))
    return best[0], -best[1]
