"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").encode())


def shingles(text, k):
    w = [x.lower() for x in words_of(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard_classes(rows, k, percent):
    """rows: (id, text); gives for each row (n_shingles, component, links)."""
    sets = [shingles(t, k) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0], links[i]) for i in range(len(rows))]


def dedup_lines(rows, min_words=50, min_lines=3):
    """rows: (id, text) with distinct ids. All runs of lines are compared, not only shortest windows."""
    docs = []
    for key, text in sorted(rows):
        lines = (text or "").split("\n")
        docs.append((key, [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate(lines) if words_of(x)]))
    first, gone = {}, {key: set() for key, _ in docs}
    found = []
    for key, lines in docs:
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += len(words_of(lines[b][1]))
                if b - a + 1 >= min_lines or total >= min_words:
                    run = tuple(x for _, x in lines[a : b + 1])
                    first.setdefault(run, (key, a))
                    found.append((run, key, a, b))
    places = dict(docs)
    for run, key, a, b in found:
        at, start = first[run]
        if at != key or a >= start + len(run):
            gone[key].update(places[key][i][0] for i in range(a, b + 1))
    return {key: ("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[key]) if text else text) for key, text in rows}


def base_quality(text):
    text = text or ""
    w = words_of(text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            duplicates += line in seen
            seen.add(line)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, inside = Counter(triples), set()
    for i, t in enumerate(triples):
        if count[t] > 1:
            inside.update((i, i + 1, i + 2))
    n = len(w)
    return n, sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), duplicates, len(inside), n < 50 or 100 * len(inside) > 50 * n


def shares(caps, weights, budget):
    """One node's budget among its children, exactly: {name: share} by raising the level until it is used up."""
    full = {}
    while True:
        rest = {c: w for c, w in weights.items() if c not in full and w}
        left = budget - sum(full.values())
        if not rest:
            return {c: full.get(c, 0) for c in caps}
        level = Fraction(left, sum(rest.values()))
        over = [c for c in rest if caps[c] <= level * rest[c]]
        if not over:
            return {c: full[c] if c in full else weights[c] * left // sum(rest.values()) for c in caps}
        full |= {c: caps[c] for c in over}


def mix(rows, weights, percent, epochs, seed):
    """rows: (id, leaf path, tokens); gives copies by row. weights: one dict for each level."""
    leaves = {}
    for _, leaf, n in rows:
        leaves[leaf] = leaves.get(leaf, 0) + n
    out = {}

    def down(prefix, budget):
        depth = len(prefix)
        if depth == len(weights):
            out[prefix] = budget
            return
        caps = {}
        for leaf, n in leaves.items():
            if leaf[:depth] == prefix:
                caps[leaf[depth]] = caps.get(leaf[depth], 0) + epochs * n
        given = shares(caps, {c: weights[depth].get(c, 1) for c in caps}, budget)
        for child, share in given.items():
            down((*prefix, child), share)

    down((), sum(leaves.values()) * percent // 100)
    copies = [0] * len(rows)
    for leaf, share in out.items():
        mine = [i for i, r in enumerate(rows) if r[1] == leaf]
        whole, rest = divmod(share, leaves[leaf]) if leaves[leaf] else (0, 0)
        keys = {i: hashlib.md5(f"{seed}:{whole}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest() for i in mine}
        for i in mine:
            upto = sum(rows[j][2] for j in mine if keys[j] <= keys[i])
            copies[i] = whole + (upto <= rest)
    return copies


def piece_weights(pieces, logs, usable, byte_piece, end, counts, n_train, prior, rounds):
    """Rounds of expectation over words (text: times) by plain probabilities; gives log weights by piece."""
    first = [math.exp(x) for x in logs]
    p = list(first)
    for _ in range(rounds):
        known = {pieces[i]: i for i in usable if p[i] > 0}
        got = [0.0] * len(pieces)
        for word, times in counts.items():
            a, b, edges = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0], []
            for j in range(1, len(word) + 1):
                for i in range(max(0, j - 40), j):
                    if (piece := known.get(word[i:j])) is not None:
                        edges.append((i, j, [piece], p[piece]))
                    elif j == i + 1:
                        parts = [byte_piece[x] for x in word[i:j].encode()]
                        edges.append((i, j, parts, math.prod(p[x] for x in parts)))
            for i, j, _, w in edges:
                a[j] += a[i] * w
            for i, j, _, w in reversed(edges):
                b[i] += w * b[j]
            for i, j, parts, w in edges:
                for x in parts:
                    got[x] += times * a[i] * w * b[j] / a[-1]
        got[end] = n_train
        p = [g + prior * f for g, f in zip(got, first)]
        total = sum(p)
        p = [x / total for x in p]
    return [math.log(x) if x else -1e300 for x in p]
