"""The operators' definitions, written out plainly for small inputs."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction
from itertools import combinations

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, fp string, score string, ids string, key string, kept_text string, spans string, __rv_x int"


def prose(rng, n, words=None):
    words = words or ["the", "And", "of", "Étre", "tion,", "ing.", "漢字", "x1", "don't", "a-b", "!!", "río"]
    return " ".join(rng.choice(words) + (rng.choice("abcdef") * rng.randint(0, 2)) for _ in range(n))


def rows_of(texts):
    """(doc_id, text) pairs as documents with extra columns whose names operators use themselves."""
    return [(i, t, "en", "s", None if t is None else len(t), 7, "f", "s", "i", "k", "kt", "sp", 1) for i, t in texts]


SPACE = "[^\x20\x09-\x0d]+"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_scores(rows, learns):
    """{position: (tokens, known, base score)} and the number of training tokens."""
    tokens = [[*re.findall(SPACE, ascii_lower(t or "")), None] for _, t in rows]
    counts = Counter(w for (i, _), ts in zip(rows, tokens, strict=True) if learns(i) for w in ts)
    n, v = sum(counts.values()), len(counts)
    return [(len(ts), sum(counts[w] > 0 for w in ts), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)) for ts in tokens], n


def deduped_lines(rows):
    """(lines, dropped, kept text) for each row."""
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or i == min(held[key(x)])]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def simhash(text, shingle=4):
    words = re.findall(SPACE, ascii_lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_components(prints, budget=4):
    """{id: smallest id reachable} for {id: fingerprint}, by testing all pairs."""
    up = {i: i for i in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= budget:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in prints}


def similar_components(texts, shingle=5, similarity=0.8):
    """{id: smallest id reachable} for {id: text}, over pairs of texts whose sets of shingles overlap by the similarity or more."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(SPACE, ascii_lower(t or ""))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else {()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def without_repeats(texts, length):
    """(words, removed, kept) for each text."""
    docs = [re.findall(SPACE, t or "") for t in texts]
    seen = Counter(tuple(d[i : i + length]) for d in docs for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        gone = {j for i in range(len(d) - length + 1) if seen[tuple(d[i : i + length])] > 1 for j in range(i, i + length)}
        out.append((len(d), len(gone), " ".join(w for j, w in enumerate(d) if j not in gone)))
    return out


def contamination(texts, items, size=13):
    """(words, hit words, sorted items) for each text; items are (id, text)."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t or ""))
    patterns = {}
    for i, t in items:
        w = words(t)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                p = patterns.get(tuple(w[k : k + m]))
                if p:
                    hit |= set(range(k, k + m))
                    found |= p
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def manifest(rows, claims, fanout=3):
    """[(id, leaf, subroot, root, proof digest, folded root)] for rows (id, source, other fields ...) and the leaves claimed of them."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda row: h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def climb(levels, i, now):
        beside = []
        for level in levels[:-1]:
            run = level[i - i % fanout : i - i % fanout + fanout]
            beside += run[: i % fanout] + run[i % fanout + 1 :]
            run[i % fanout] = now
            now, i = h("".join(run)), i // fanout
        return beside, now

    order = lambda s: (s is not None, (s or "").encode())
    groups = {}
    for row, claim in zip(rows, claims, strict=True):
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), leaf(claim), row[0]))
    names = sorted(groups, key=order)
    trees = [tree([x[2] for x in sorted(groups[s], key=lambda x: x[:4])]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, x in enumerate(sorted(groups[s], key=lambda x: x[:4])):
            beside, now = climb(trees[k], i, x[3])
            more, now = climb(top, k, now)
            out.append((x[4], x[2], trees[k][-1][0], top[-1][0], h("".join(beside + more)), now))
    return out


def filled_middle(doc_id, text):
    """(n, form, prefix chars, middle chars, output)."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} for {source: words}, null last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | {s: float(x) for s, x in share.items()}
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target
