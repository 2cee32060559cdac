import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import neighbours, urls


@pytest.mark.parametrize("url, host, path", [
    ("http://A.Com/x?y", "a.com", "/x"), ("https://a.com", "a.com", ""), ("https://a.com?q=/x", "a.com", ""), ("https://É.com#t", "É.com", ""),
    ("x://a.com/b#c?d", "a.com", "/b"), ("a.com/b", "", ""), (None, "", ""), ("", "", ""), ("://", "", ""), ("a://b://c", "b:", "//c"), ("http://u@h:80/p/", "u@h:80", "/p/"),
])
def test_split(url, host, path):
    assert urls.split_url(url) == (host, path)


@pytest.mark.parametrize("host, path, rule", [
    ("a.com", "/", "com/"), ("com", "/x", "com/"), ("acom", "/", None), ("a.com", "", None), ("m.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"),
    ("b.www.example.com", "/en/", "www.example.com/en/"), ("xexample.com", "/en/", "com/"), ("a.net", "/es/", "net/es/"), ("a.net", "/fr/x", "net/fr/"), ("a.net", "/en/", None), ("", "", None),
])
def test_rules(host, path, rule):
    found = urls.rule_for(host, path)
    assert (found and found[0]) == rule
    if found:
        assert found[1] == {h + p: v for h, p, v in urls.RULES}[rule]


def plain_verdict(url, labelled):
    """Host, path, rule and verdict by regular expressions, with a regression fitted by plain loops."""
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), found[1]), found[2]) if found else ("", "")
    best = None
    for rule, verdict in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")):
        on, start = re.match(r"([^/]*)(.*)", rule).groups()
        if path.startswith(start) and f".{host}".endswith(f".{on}") and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    if best:
        return host, path, *best
    return host, path, None, "block" if labelled(host, path) >= 0.5 else "allow"


def plain_regression(rows):
    """The same model by dictionaries: gradient descent with momentum over normalised n-gram counts."""
    def counts(url):
        got, bias = {}, 1.0
        for part, text in zip("hp", urls.split_url(url) if isinstance(url, str) else url):
            raw = f"{part}^{text}$".encode() if text else b""
            grams = [zlib.crc32(raw[i : i + n], ord(part)) % urls.BUCKETS for n in (3, 4, 5) for i in range(1, len(raw) - n + 1)]
            for g in grams:
                got[g] = got.get(g, 0.0) + len(grams) ** -0.5
        return got, bias

    data = [(counts(u)[0], y) for u, y in rows]
    n = [sum(1 for _, y in data if y == k) for k in (0, 1)]
    w, step, bias, bias_step = {g: 0.0 for x, _ in data for g in x}, {}, 0.0, 0.0
    for _ in range(400):
        fall, total = {}, 0.0
        for x, y in data:
            p = 1 / (1 + math.exp(-bias - sum(w[g] * v for g, v in x.items())))
            miss = (p - y) * 0.5 / max(1, n[y])
            total += miss
            for g, v in x.items():
                fall[g] = fall.get(g, 0.0) + miss * v
        step = {g: 0.9 * step.get(g, 0.0) - 2.0 * (fall.get(g, 0.0) + 3e-4 * w[g]) for g in w}
        bias_step = 0.9 * bias_step - 0.5 * total
        w, bias = {g: v + step[g] for g, v in w.items()}, bias + bias_step
    return lambda host, path: 1 / (1 + math.exp(-bias - sum(w.get(g, 0.0) * v for g, v in counts((host, path))[0].items())))


def test_verdicts_equal_brute_force(spark):
    labelled = urls.labelled_urls()[::19]
    own = plain_regression(labelled)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    extra = ["HTTP://WWW.Example.COM/en/x", "a://net/fr/", "a://b.net/fr/?q", "no scheme", "", None, "x://casino-win.example.org?x", "x://EXAMPLE.com", "x://y.example.net/es/#t"]
    rows = [(r.page_id, r.url) for r in pages.collect()] + list(enumerate(extra, 9000))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, pages.schema), urls.train(labelled)).collect()}
    assert got == {k: plain_verdict(u, own) for k, u in rows}
    assert len({v[3] for v in got.values()}) == 2 and None in {v[2] for v in got.values()}


def test_held_out_urls():
    rows = urls.labelled_urls()
    random.Random(0).shuffle(rows)
    cut = len(rows) * 3 // 4
    model = urls.train(rows[:cut])
    right = [(model.probability(*urls.split_url(u)) >= 0.5) == bool(y) for u, y in rows[cut:]]
    assert sum(right) / len(right) > 0.9
    assert urls.train([]).probability("a", "/") == 0.5


def test_every_url_gets_a_verdict(spark):
    model = urls.train(urls.labelled_urls())
    rows = [(1, "http://weather-station.example.org/en/1"), (None, None), (2, "x" * 100_000), (2, "http://casino-win.example.net/en/2"), (2, "http://casino-win.example.net/en/2"), (3, "http://www.example.com/en/1")]
    df = spark.createDataFrame([(k, u, "own", "own") for k, u in rows], "page_id long, url string, host string, verdict string")
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in urls.filter_urls(df, model).collect()), key=repr)
    expected = []
    for k, u in rows:
        host, path = urls.split_url(u)
        rule = urls.rule_for(host, path)
        expected.append((k, host, rule and rule[0], rule[1] if rule else "block" if model.probability(host, path) >= 0.5 else "allow"))
    assert got == sorted(expected, key=repr)
    assert got[0][1:] == ("weather-station.example.org", None, "allow") and (2, "casino-win.example.net", None, "block") in got
    assert urls.filter_urls(df.limit(0), model).count() == 0


def exact(rows, asks, most=5):
    """(query, [(score, id)]) by brute force."""
    good = [(k, np.array(v, dtype=np.float64)) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for k, v in good:
        if asks(k):
            near = {(-round(float(x @ v / math.sqrt(x @ x) / math.sqrt(v @ v)), 12), i) for i, x in good if i != k and len(x) == len(v)}
            out[k] = [(-s, i) for s, i in sorted(near)[:most]]
    return out


def run(spark, rows, asks, **options):
    df = spark.createDataFrame([(k, v, "own", 1.0) for k, v in rows], "vec_id long, embedding array<float>, label string, score double")
    out = {}
    for r in neighbours.search(df, asks, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(r.score, 12), r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_hard_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(40)]
    rows += [(50, None), (100, []), (150, [0.0] * 4), (200, [1.0, None, 0.0, 0.0]), (250, [float("nan"), 1.0, 0.0, 0.0]), (300, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0] * 4), (350, [1.0, 2.0])]
    rows += [(400 + i, rows[0][1]) for i in range(12)] + [(0, rows[0][1]), (600, [1.0, 1.0]), (650, [1e-3, 2e-3])]
    got = run(spark, rows, F.col("vec_id") % 50 == 0, reach=1 - 1e-9)
    assert got == exact(rows, lambda k: k % 50 == 0)
    assert [v for _, v in got[0]] == [400, 401, 402, 403, 404]
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("n, parts", [(500, 1024), (2000, 1024), (3000, 7)])
def test_recall_of_the_index(spark, monkeypatch, n, parts):
    """The same method at every size; with small parts and blocks, many tasks for a cell."""
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", parts)
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 60 if parts == 7 else 1024)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(n)]
    got, expected = run(spark, rows, F.col("vec_id") % 50 == 0), exact(rows, lambda k: k % 50 == 0)
    assert set(got) == set(expected) and all(len(v) == 5 for v in got.values())
    hits = sum(len(set(got[k]) & set(expected[k])) for k in got)
    assert hits / (5 * len(got)) >= 0.9
    scores = {(k, i): s for k, v in got.items() for s, i in v}
    x = {k: np.array(v) for k, v in rows}
    assert all(s == pytest.approx(x[k] @ x[i] / np.sqrt(x[k] @ x[k]) / np.sqrt(x[i] @ x[i]), abs=1e-12) for (k, i), s in scores.items())


def test_cells_are_visited_in_order_of_chance():
    hasher = neighbours.Hasher(8, 2, 3, 1.0, 0.8)
    place = np.array([0.3, 1.9, -2.2])
    seen = hasher.visit(place, 0.9)
    assert tuple(seen[0]) == (0, 1, -3) and len({tuple(c) for c in seen}) == len(seen)
    edge = lambda x: 0.5 * (1 + math.erf(x / 0.8 / math.sqrt(2)))
    chance = [math.prod(edge(c + 1 - p) - edge(c - p) for c, p in zip(cell, place)) for cell in seen]
    assert all(a >= b - 1e-9 for a, b in zip(chance, chance[1:])) and 0.9 <= sum(chance) < 0.95
