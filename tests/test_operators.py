import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.config import BM25Params, ChunkParams, Config, ModelSpec
from gleaner.operators import evaluate as E
from gleaner.operators import index as I
from gleaner.operators import search as Q
from gleaner.operators import stats as S
from gleaner.operators import vectors as V


def plain(c):
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "alpha beta beta"), (2, "alpha gamma"), (3, "beta delta delta delta")]
    return S.analyzed(spark.createDataFrame(rows, "doc_id long, text string"), words=plain).cache()


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "qid int, text string")


def test_statistics(docs):
    assert {r.word: r.df for r in S.document_frequencies(S.term_frequencies(docs)).collect()} == {"alpha": 2, "beta": 2, "gamma": 1, "delta": 1}
    assert tuple(S.corpus_stats(S.document_lengths(docs)).first()) == (3, 3.0)
    assert S.average_size(S.term_frequencies(docs), 3).first()[0] == 3.0
    assert S.document_count(docs).first()[0] == 3


def test_sparse_vectors(docs):
    got = {(r.doc, r.word): (r.tf, r.doc_len, round(r.tf_idf, 9), round(r.bm25, 9)) for r in S.sparse_vectors(docs).collect()}
    assert got == {
        (1, "alpha"): (1, 3, 0.405465108, 0.405465108), (1, "beta"): (2, 3, 0.810930216, 0.557514524), (2, "alpha"): (1, 2, 0.405465108, 0.469485915),
        (2, "gamma"): (1, 2, 1.098612289, 1.272077387), (3, "beta"): (1, 4, 0.405465108, 0.356809295), (3, "delta"): (3, 4, 3.295836866, 1.611298023),
    }
    for (doc, _), (tf, *_rest) in got.items():
        assert sum(v[0] for k, v in got.items() if k[0] == doc) == next(v[1] for k, v in got.items() if k[0] == doc)


def test_empty_documents_count(spark):
    docs = S.analyzed(spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string"), words=plain)
    assert tuple(S.corpus_stats(S.document_lengths(docs)).first()) == (3, 2 / 3)
    assert {r.word: round(r.idf, 6) for r in S.idf(S.document_frequencies(S.term_frequencies(docs)), S.corpus_stats(S.document_lengths(docs))).collect()} == {"a": round(math.log(3), 6), "b": round(math.log(3), 6)}


def test_searches(spark, docs):
    asked = queries(spark, "alpha beta", "alpha", "zzz", "alpha zzz")
    got = [(r.qid, r.doc, r.score, r["rank"]) for r in Q.bm25(docs, asked, 50, words=plain).orderBy("qid", "rank").collect()]
    assert got[:3] == [(1, 1, 0.962979632, 1), (1, 2, 0.469485915, 2), (1, 3, 0.356809295, 3)]
    assert {q for q, *_ in got} == {1, 2, 4}
    got = [(r.qid, r.doc, r.score, r["rank"]) for r in Q.tfidf(docs, asked, 50, words=plain).orderBy("qid", "rank").collect()]
    assert got[:3] == [(1, 1, 0.948683298, 1), (1, 2, 0.707106781, 2), (1, 3, 0.707106781, 3)]
    assert [g[1:] for g in got if g[0] == 2] == [(1, 1.0, 1), (2, 1.0, 2)]
    stored = Q.search_index(S.sparse_vectors(docs), asked, 2, words=plain).orderBy("qid", "rank").collect()
    assert [(r.doc, r.score) for r in stored if r.qid == 1] == [(1, 0.962979632), (2, 0.469485915)]
    assert Q.bm25(docs, asked, 50, words=plain, min_score=0.5).count() == 1
    with pytest.raises(ValueError):
        Q.bm25(docs, asked, 0, words=plain)


def test_parameters_take_effect(spark, docs):
    flat = Q.bm25(docs, queries(spark, "delta"), 5, BM25Params(k1=0.0, b=0.0), words=plain).first()
    assert flat.score == round(math.log(3), 9)


def test_words_in_every_document_have_no_norm(spark):
    docs = S.analyzed(spark.createDataFrame([(1, "a"), (2, "a b")], "doc_id long, text string"), words=plain)
    rows = Q.tfidf(docs, queries(spark, "a"), 5, words=plain).collect()
    assert [(r.doc, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, None), (2, None)]


def test_index(spark, docs):
    ids = I.document_ids(docs)
    assert {r.doc: r.doc_int for r in ids.collect()} == {1: 1, 2: 2, 3: 3}
    lists = I.postings(S.term_frequencies(docs), ids)
    got = {r.word: r.docs for r in lists.collect()}
    assert got == {"alpha": [1, 2], "beta": [1, 3], "gamma": [2], "delta": [3]}
    words = spark.createDataFrame([(1, "alpha"), (1, "gamma"), (2, "zzz")], "qid int, word string")
    assert sorted(tuple(r) for r in I.candidates(words, lists).collect()) == [(1, 1), (1, 2)]
    assert [r.word for r in I.prefix_lookup(lists, "ga").collect()] == ["gamma"]
    assert I.lookup(lists, ["beta", "no"]).count() == 1
    new = spark.createDataFrame([("alpha",), ("eta",)], "word string")
    assert [r.word for r in I.new_words(lists, new).collect()] == ["eta"]


def test_long_lists_have_several_rows(spark):
    tf = spark.createDataFrame([("w", i) for i in range(10)], "word string, doc long")
    got = {r.part: r.docs for r in I.postings(tf, span=4).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}
    words = spark.createDataFrame([(1, "w")], "qid int, word string")
    assert I.candidates(words, I.postings(tf, span=4)).count() == 10
    named = I.postings(tf.select("word", F.concat(F.lit("d"), "doc").alias("doc")))
    assert sorted(d for r in named.collect() for d in r.docs) == sorted(f"d{i}" for i in range(10)) and named.count() > 1


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    return I.build_index(docs, str(tmp_path_factory.mktemp("index")), limit=3)


def test_stored_index_gives_the_same(spark, docs, stored):
    asked = queries(spark, "alpha beta", "alpha", "zzz", "alpha zzz", "delta gamma beta beta")
    for direct, from_index in ((Q.bm25, Q.bm25_stored), (Q.tfidf, Q.tfidf_stored)):
        assert sorted(from_index(stored, asked, 50, words=plain).collect()) == sorted(direct(docs, asked, 50, words=plain).collect())
    assert Q.bm25_stored(stored, queries(spark, "zzz"), 5, words=plain).count() == 0
    flat = Q.bm25_stored(stored, queries(spark, "delta"), 5, BM25Params(k1=0.0, b=0.0), words=plain).first()
    assert flat.score == round(math.log(3), 9)


def test_stored_index_reads_the_words_only(spark, docs, stored, monkeypatch):
    asked = spark.createDataFrame([("beta",)], "word string")
    plan = stored.read(asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan or "shard#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "word" in plan.split("PushedFilters: [")[1].split("]")[0]
    few = {tuple(r) for r in stored.read(asked).collect()}
    monkeypatch.setattr(I.StoredIndex, "MOST_LITERALS", 0)  # words beyond the literals are joined
    assert {tuple(r) for r in stored.read(asked).collect()} == few == {("beta", 2, 1, 2, 3), ("beta", 2, 3, 1, 4)}


def test_the_index_of_other_files_is_another(spark, tmp_path):
    from gleaner.plans import catalog

    for text, n in (("cat dog", 1), ("cat cat bird", 2)):
        spark.createDataFrame([(i, text) for i in range(n)], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert catalog.stored_index(spark, str(tmp_path)).stats.first().corpus_size == n
        assert catalog.stored_index(spark, str(tmp_path)).terms.count() == 2


def greedy(df, limit):
    shards, used = [[]], 0
    for word, n in sorted(df.items(), key=lambda x: (-x[1], x[0])):
        if used and used + n > limit:
            shards.append([])
            used = 0
        shards[-1].append(word)
        used += n
    return {w: i for i, s in enumerate(shards) for w in s}


@pytest.mark.parametrize("df", [
    {"a": 6, "b": 4, "c": 3, "d": 2, "e": 1}, {"a": 12, "b": 4}, {"a": 12, "b": 11, "c": 10, "d": 10, "e": 1}, {f"w{i:03}": 1 + i % 7 for i in range(100)}, {"x": 3, "y": 3, "z": 3, "v": 3, "u": 1},
])
def test_shards(spark, df):
    rows = spark.createDataFrame(list(df.items()), "word string, df long")
    assert {r.word: r.shard for r in I.pack_shards(rows, 10).collect()} == greedy(df, 10)


@pytest.mark.parametrize("length, expected", [
    (100, [(0, 100)]), (511, [(0, 511)]), (512, [(0, 512), (448, 512)]), (513, [(0, 512), (448, 513)]), (960, [(0, 512), (448, 960), (896, 960)]), (961, [(0, 512), (448, 960), (896, 961)]),
])
def test_windows(spark, length, expected):
    got = spark.range(1).select(V.windows(F.lit(length)).alias("w")).first().w
    assert [tuple(w) for w in got] == expected


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "ab  cd ef\n\n\n\n gh"), (2, None), (3, "   ")], "doc int, text string")
    rows = V.chunks(docs, ChunkParams(2, 1)).orderBy("doc", "para", "chunk").collect()
    assert [(r.doc, r.para, r.chunk, r.tokens, r.start, r.end, r.para_offset) for r in rows] == [
        (1, 0, 0, ["ab", "cd"], 0, 6, 0), (1, 0, 1, ["cd", "ef"], 4, 9, 0), (1, 0, 2, ["ef"], 7, 9, 0), (1, 2, 0, ["gh"], 1, 3, 13),
    ]
    text = "ab  cd ef\n\n\n\n gh"
    assert all(text[r.para_offset + r.start : r.para_offset + r.end].split() == r.tokens for r in rows)
    padded = V.chunks(docs, ChunkParams(4, 1), pad="").collect()
    assert all(len(r.tokens) == 4 for r in padded)
    joined = V.chunks(docs, ChunkParams(8, 1), join_paragraphs=True).collect()
    assert [r.tokens for r in joined] == [["ab", "cd", "ef", "gh"]]
    with pytest.raises(ValueError):
        ChunkParams(4, 4)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    lengths = [(7 * i) % 11 for i in range(n)]
    got = spark.createDataFrame([(lengths,)], "a array<bigint>").select(V.running(F.col("a")).alias("r")).first().r
    assert got == [sum(lengths[:i]) for i in range(n)]


def test_spans_of_many_paragraphs_and_tokens(spark):
    text = "\n".join(["a " * 3000, *(f"p{i} x" for i in range(2000)), ""])
    rows = V.chunks(spark.createDataFrame([(1, text)], "doc int, text string"), ChunkParams(64, 8), separator="\n").collect()
    assert len(rows) > 2000 and all(text[r.para_offset + r.start : r.para_offset + r.end].split() == r.tokens for r in rows)


def test_embedding_and_pooling(spark):
    rows = spark.createDataFrame([(1, ["a", "b", ""]), (2, ["a"]), (3, [])], "doc int, tokens array<string>")
    got = {r.doc: r.vector for r in V.embed(rows, V.HashingEncoder(4)).collect()}
    assert len(got[1]) == 4 and got[3] == [0.0] * 4 and got[1] != got[2]
    everything = {r.doc: r.vector for r in V.embed(rows, V.HashingEncoder(4, "all")).collect()}
    assert everything[1] == pytest.approx([x * 2 / 3 for x in got[1]], rel=1e-5)
    pooled = V.mean_pool(spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "g int, vector array<float>"), ["g"]).orderBy("pos").collect()
    assert [r.mean for r in pooled] == [2.0, 3.0]


def test_nearest_and_rerank(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0]), (5, None)], "doc long, vector array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, vector array<float>")
    got = [(r.doc, r.distance, r["rank"]) for r in V.nearest(vectors, asked, 3).orderBy("rank").collect()]
    assert got == [(1, 0.0, 1), (4, 0.0, 2), (3, round(1 - math.sqrt(0.5), 9), 3)]
    keep = spark.createDataFrame([(2,), (3,)], "doc long")
    assert [r.doc for r in V.nearest(vectors, asked, 3, keep=keep).orderBy("rank").collect()] == [3, 2]
    stage1 = spark.createDataFrame([(7, 2), (7, 4), (8, 1)], "qid long, doc long")
    assert [r.doc for r in V.rerank(stage1, vectors, asked, 5).orderBy("rank").collect()] == [4, 2]
    assert V.nearest(vectors, asked, 10_001).count() == 0
    best = V.best_per_doc(V.rerank(stage1, vectors.union(vectors), asked, 5)).collect()
    assert len(best) == 2


def exact_nearest(vectors, asked, k):
    out = {}
    for q, v in asked:
        unit = lambda x: np.array(x) / max(float(np.linalg.norm(x)), 1e-300)
        out[q] = sorted((round(1 - float(unit(v) @ unit(x)), 9), i) for i, x in vectors if x is not None)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.distance, r.doc))
    return out


@pytest.mark.parametrize("name", [int, str])
def test_nearest_in_many_blocks(spark, monkeypatch, name):
    """Ties across blocks go to the smaller id; blocks of queries and vectors don't show."""
    monkeypatch.setattr(V, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(V, "QUERY_BLOCK", 5)
    monkeypatch.setattr(V, "MOST_KEPT", 40)
    rng = np.random.default_rng(3)
    vectors = [(name(i), [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(150)] + [(name(900), None), (name(901), [0.0, 0.0, 0.0])]
    asked = [(i, [float(x) for x in rng.integers(1, 4, 3)]) for i in range(23)]
    kind = "long" if name is int else "string"
    got = V.nearest(spark.createDataFrame(vectors, f"doc {kind}, vector array<float>"), spark.createDataFrame(asked, "qid long, vector array<float>"), 6)
    assert found(got) == exact_nearest(vectors, asked, 6)


def test_nearest_in_cells(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    vectors = [(i, [float(np.float32(x)) for x in centres[i % 8] + 0.3 * rng.normal(size=16)]) for i in range(600)]
    asked = [(i, v) for i, v in vectors[:40]]
    df, queries_ = spark.createDataFrame(vectors, "doc long, vector array<float>"), spark.createDataFrame(asked, "qid long, vector array<float>")
    V.build_cells(df, str(tmp_path / "cells"), 12)
    expected = exact_nearest(vectors, asked, 5)
    assert found(V.nearest_in_cells(spark, str(tmp_path / "cells"), queries_, 5, probes=12)) == expected
    some = found(V.nearest_in_cells(spark, str(tmp_path / "cells"), queries_, 5, probes=3))
    assert sum(len(set(some[q]) & set(expected[q])) for q in expected) / 200 >= 0.9
    plan = V.nearest_in_cells(spark, str(tmp_path / "cells"), queries_.limit(1), 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_questions(spark, docs):
    cases = spark.createDataFrame([(1, "beta"), (3, "delta delta"), (2, "zzz")], "target long, question string")
    r = E.questions(cases, lambda asked: Q.bm25(docs, asked, 50, words=plain)).first()
    assert r.targets == 3 and r.recall_at_5 == pytest.approx(2 / 3)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from gleaner.sources.work import work_folder

    elsewhere = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: SimpleNamespace(get=lambda *a: None)))
    with pytest.raises(ValueError):
        work_folder(elsewhere)
    assert work_folder(spark) == work_folder(spark)


def test_evaluation(spark):
    targets = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "qid int, doc int")
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 7)], "qid int, doc int, rank int")
    ranks = E.target_ranks(targets, results)
    assert {r.qid: r["rank"] for r in ranks.collect()} == {1: 1, 2: 7, 3: -1}
    r = E.recall(ranks).first()
    shares = [r.recall_at_5, r.recall_at_10, r.recall_at_25, r.recall_at_50]
    assert shares == sorted(shares) and shares[0] == pytest.approx(1 / 3) and shares[1] == pytest.approx(2 / 3)
    timing = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "engine string, elapsed double")
    assert E.average_latency(timing).first().avg_elapsed == 2.0
    docs = S.analyzed(spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60))) for i in range(9)], "doc_id long, text string"), words=plain)
    cut = E.exact_passages(docs).collect()
    assert len(cut) == 9 and all(int(r.passage.split()[0][1:]) < 45 for r in cut)
    picked = E.weighted_paragraph(spark.createDataFrame([(1, 0, "a"), (1, 1, "b" * 500), (2, 0, "")], "doc int, para int, text string")).collect()
    assert [r.doc for r in picked] == [1]
    sample = E.sample_documents(spark.range(100).withColumnRenamed("id", "doc_id"))
    assert sample.count() == 5 and sample.collect() == E.sample_documents(spark.range(100).repartition(7).withColumnRenamed("id", "doc_id")).collect()


def test_config():
    config = Config(BM25Params(1.5, 0.5), models={"bert": ModelSpec("bert-base", 512, 768)})
    assert Config.parse(config.dump()) == config
    assert config.at_depth(2).path("/x", "idf") == "/x/depth_2/idf"
    with pytest.raises(ValueError):
        Config(depth=0)
