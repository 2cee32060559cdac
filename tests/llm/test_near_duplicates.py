import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from gleaner.llm import graph, lines, njaccard
from gleaner.llm.graph import components

SCHEMA = "doc_id long, text string, n long, f long, s int, block int"  # extra columns with names used inside


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1, 2, 3, 4) for k, t in rows], SCHEMA)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.6:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.7:
            texts.append(common + " " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 20, 100, 200]))))
    return texts


def classes(df, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in njaccard.jaccard_classes(df, **options).collect()), key=repr)


@pytest.mark.parametrize("k, percent, batch, longest", [(3, 90, 2000, 16), (5, 80, 2000, 1), (2, 60, 4, 3)])
def test_classes_equal_brute_force(spark, monkeypatch, k, percent, batch, longest):
    monkeypatch.setattr(njaccard, "BATCH_SETS", batch)
    monkeypatch.setattr(njaccard, "LIST", longest)
    if longest == 3:  # all joins by shuffle
        monkeypatch.setattr(graph, "MOST_BROADCAST", 0)
    rows = list(enumerate(corpus(k), 10))
    expected = [(key, *got) for (key, _), got in zip(rows, brute.jaccard_classes(rows, k, percent))]
    assert classes(frame(spark, rows), k=k, percent=percent) == sorted(expected, key=repr)


def test_hard_cases_of_classes(spark):
    rows = [(None, "a b c d"), (7, "A b  c\td"), (8, None), (9, ""), (3, "a b c d"), (3, "x y z"), (4, "x y z"), (5, " \n "), (6, "a b"), (11, "A B"), (12, "a " * 30_000)]
    expected = [(key, *got) for (key, _), got in zip(rows, brute.jaccard_classes(rows, 3, 90))]
    assert classes(frame(spark, rows), k=3, percent=90) == sorted(expected, key=repr)
    assert classes(frame(spark, []), k=3, percent=90) == []


def test_one_of_each_group_stays(spark):
    rows = list(enumerate(corpus(9)))
    kept = njaccard.keep_one(frame(spark, rows), k=5, percent=80)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    expected = {c if c is not None else key for (key, _), (_, c, _) in zip(rows, brute.jaccard_classes(rows, 5, 80))}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)


def test_sets_that_link_share_a_signature():
    rng, sign = np.random.default_rng(0), {p: njaccard.Signer(p) for p in (60, 80, 90)}
    for _ in range(400):
        percent = int(rng.choice([60, 80, 90]))
        n = int(rng.choice([1, 2, 5, 9, 10, 30, 100, 400]))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        change = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[change:], rng.integers(0, 1 << 63, int(rng.integers(0, change + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= percent * (len(x) + len(y) - both):
            a, b = sign[percent], set(sign[percent](x).tolist())
            agree = len(b & set(a(y).tolist()))
            assert agree >= max(a.agree(x), a.agree(y)) >= 1
            assert len(b) <= a.most(len(x))


def test_trie_matches():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 120, dtype=np.uint64) * np.uint64(2))
    sets = [np.unique(np.concatenate([rng.permutation(base)[int(rng.integers(0, 25)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64)])) for _ in range(80)]
    sets += [sets[0], base[:1], base[:2], base]
    for percent in (50, 80, 95):
        for i, found in njaccard.join_sets(sets, None, percent):
            expected = [j for j in range(len(sets)) if j != i and 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - b)]
            assert sorted(found.tolist()) == expected


def test_subtrees_are_left_where_the_bound_cannot_be_reached():
    """Sets in families that differ early: a query counts tokens in its own family's subtree, and at most once in the others."""
    rng = np.random.default_rng(2)
    bases = [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)) for _ in range(30)]
    sets = [np.unique(np.concatenate([rng.permutation(b)[3:], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])) for b in bases for _ in range(10)]
    trie = njaccard.PrefixTrie(sets)
    every = sum(len(start) - 1 for _, start, *_ in trie.nodes)
    for s in sets:
        trie.visited = 0
        found = trie.matches(s, 80)
        assert len(found) == 10 and trie.visited < every / 4
    trie.visited = 0
    assert not len(trie.matches(sets[0][:20], 80)) and trie.visited == 0


def test_long_lists_tie_a_set_once(spark):
    """All sets of a group of near copies, whatever its size, are tied in one row each."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    expected = [(key, *got) for (key, _), got in zip(rows, brute.jaccard_classes(rows, 5, 80))]
    assert classes(frame(spark, rows), k=5, percent=80) == sorted(expected, key=repr)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 60)]
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: v for x, v in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def passages(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 3, 30, 60]))) for _ in range(12)]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.9 else "" for _ in range(rng.randint(1, 9))) for _ in range(40)]
    return list(enumerate(texts, 5))


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_equals_brute_force(spark, monkeypatch, seed):
    if seed == 0:  # all joins by shuffle
        monkeypatch.setattr(graph, "MOST_BROADCAST", 0)
        monkeypatch.setattr(lines, "MOST_DOCUMENTS", 0)
    rows = passages(seed)
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute.dedup_lines(rows)


def test_hard_cases_of_line_dedup(spark):
    long = "\n".join(f"line {i} of many" for i in range(3000))
    rows = [(None, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, None), (3, ""), (4, "  a \nb\n\nc\r"), (5, long), (6, "x\n" + long), (7, "q\n" * 7)]
    out = lines.dedup_lines(frame(spark, rows))
    assert out.columns[: len(SCHEMA.split(", "))] == [c.split()[0] for c in SCHEMA.split(", ")]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(None, "a\nb\nc\nd"), (1, ""), (1, ""), (2, None), (3, ""), (4, ""), (5, long), (6, "x"), (7, "q\nq\nq\n")], key=repr)
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_a_long_passage_goes_and_clean_text_stays(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"one two\n{passage}\nthree"), (2, f"four five\n{passage}\nsix seven"), (3, "one two\nfour")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "four five\nsix seven", 3: "one two\nfour"}


def test_a_text_of_many_repeated_lines_takes_time_by_its_length(spark):
    """All lines of a long text go, also where more columns are made from the result."""
    import time

    long = "\n".join(f"line {i} of many" for i in range(30_000))
    out = lines.dedup_lines(frame(spark, [(1, long), (2, "x\n" + long + "\ny")])).withColumn("n_chars", F.length("text")).filter(F.col("text").rlike("[a-z]"))
    began = time.time()
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (long, len(long)), 2: ("x\ny", 3)} and time.time() - began < 30


def windows_of(hashes, words, least):
    """Shortest long-enough windows (start, length), by trying all."""
    m, out = len(hashes), set()
    long_enough = lambda a, b: b - a >= lines.MIN_LINES or sum(words[a:b]) >= least
    for a in range(m):
        out |= {(a, b - a) for b in range(a + 1, m + 1) if long_enough(a, b)} and {min(((a, b - a) for b in range(a + 1, m + 1) if long_enough(a, b)), key=lambda x: x[1])}
        out |= {min(((c, a + 1 - c) for c in range(a + 1) if long_enough(c, a + 1)), key=lambda x: x[1])} if any(long_enough(c, a + 1) for c in range(a + 1)) else set()
    return out


def test_fingerprints_are_the_minima_of_the_windows(spark):
    rows = passages(9) + [(900, "\n".join("ab"[i % 2] for i in range(12))), (901, "one line")]
    df = frame(spark, rows)
    hashed = {r.doc_id: ([x.a for x in r.L], [x.w for x in r.L]) for r in df.select("doc_id", lines._lines(F.col("text")).alias("L")).collect()}
    expected = {}
    for key, (hashes, words) in hashed.items():
        for s, n in windows_of(hashes, words, 50):
            p = min(range(s, s + n), key=lambda i: (hashes[i], i))
            expected.setdefault((key, p, hashes[p]), set()).add((s, n))
    got = {(r._ln_id, r.p, r.fp): {(x.s, x.n) for x in r.W} for r in lines.fingerprints(df).collect()}
    assert got == expected and len(got) > 50


def test_a_run_that_comes_after_a_lone_copy_of_its_least_line_is_found(spark):
    """The first place of each fingerprint need not hold the run: extensions have first places of their own."""
    run = ["alpha one", "beta two", "gamma three"]
    rows = [(i, line) for i, line in enumerate(run)] + [(10, "\n".join(run)), (11, "x\n" + "\n".join(run) + "\ny")]
    got = {r.doc_id: (r.text, r._ln_gone) for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got[10] == ("\n".join(run), None) and got[11] == ("x\ny", [1, 2, 3])
