"""Cases of the reviews: rows that a query once had otherwise than its SQL, and work that it did twice."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.stopwords import ENGLISH
from gleaner.operators import counting as C
from gleaner.operators import index as I
from gleaner.operators import stats as S
from gleaner.operators import vectors as V
from gleaner.plans import catalog
from gleaner.sources import articles as A

SF = "/root/testdata/sf0.001"


def same(spark, tmp_path, name: str, **tables) -> list:
    """The rows of a query over small tables, which must be those of its SQL."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    ours = sorted((tuple(r) for r in df.collect()), key=str)
    sql = con.execute(catalog.SQL[name])
    at = [c[0] for c in sql.description]
    assert ours == sorted((tuple(r[at.index(c)] for c in df.columns) for r in sql.fetchall()), key=str)
    return ours


def test_entities_without_semicolon_stay(spark, tmp_path):
    pages = [(1, "<article>a &amp<p>b &lt; &amp;lt; &nbsp; &#39;&#40;</p></article>"), (2, "<p>no article</p>"), (3, None), (4, "<article>x &ampy &</article>")]
    rows = same(spark, tmp_path, "extract_article_parser", pages=("page_id bigint, html string", pages))
    assert rows[0] == (1, "a &ampb < &lt; &nbsp; '&#40;") and rows[1] == (2, "")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["doc_freq", "term_freq", "idf", "exact_passages", "avg_corpus_size", "candidates_or", "postings"])
def test_a_text_is_analysed_once(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    passages = 2 if name == "candidates_or" else 0  # those are few
    assert plan.count("lower(") == 1 + passages


@pytest.mark.parametrize("name", ["bm25_scan", "tfidf_scan", "bm25_index"])
def test_searches_do_not_analyse_texts_again(spark, name):
    """What is left to the result's plan reads written counts; of the texts it counts the rows at most."""
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert plan.count("lower(") <= plan.count("Relation [item_id")


def test_counting_needs_no_shuffle_of_words(spark):
    plan = catalog.QUERIES["term_freq"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(doc_id" in plan


def test_words_are_cut_the_same(spark):
    odd = ["can,not cannot's CANNOT! (gonna)", "wanna-be’gotta„lemme“", "", None, "a\x0bb\fcc  dd", "x'y don't the; THE,the", "İstanbul ǅ cannot\tgimme", "cannotx xcannot"]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, text string")
    slow = T.remove_stopwords(T.tokens(T.remove_punctuation(F.lower("text"))))
    for r in rows.select(T.simple_words(F.col("text")).alias("a"), slow.alias("b")).collect():
        assert r.a == r.b


def test_postings_hold_frequencies(spark):
    plan = catalog.QUERIES["index_postings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_hot_words_have_several_files(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc"), F.array(F.lit("hot"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("words"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be one task
    try:
        index = I.build_index(docs, str(tmp_path), limit=10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = index.postings.filter("word = 'hot'")
    assert hot.count() == 40 and hot.filter("df = 40").count() == 40 and hot.select(F.input_file_name()).distinct().count() > 1


def test_many_words_do_not_shuffle_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I.StoredIndex, "MOST_LITERALS", 0)
    docs = spark.range(9).select(F.col("id").alias("doc"), F.array(F.lit("hot"), F.lit("cold")).alias("words"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        rows = I.build_index(docs, str(tmp_path)).read(spark.createDataFrame([("hot",)], "word string"))
        assert rows.count() == 9 and "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_token_vectors_are_made_once_and_the_same(monkeypatch):
    made = []
    rng = np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda seed: made.append(seed) or rng(seed))
    V._token_vector.cache_clear()
    lists = [["a", "b", "a", ""] * 30, [], ["b", "é"]]
    got = V.HashingEncoder(16)(lists)
    assert len(made) == 3
    for tokens, row in zip(lists, got):
        total = np.zeros(16)
        for t in filter(None, tokens):
            total += rng(zlib.crc32(t.encode())).standard_normal(16)
        assert (row == total / max(1, len([t for t in tokens if t]))).all()


def test_full_analysis_in_parts(spark, monkeypatch):
    texts = [None, "", *[f"running {i} cannot x{i}" for i in range(2 * T.FULL_ROWS)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    assert "ArrowEvalPython" in (df := rows.select("i", T.full_words()(F.col("text")).alias("w")))._jdf.queryExecution().executedPlan().toString()
    assert {r.i: list(r.w) for r in df.collect()} == {i: T.full_words_of(t) for i, t in enumerate(texts)}


ODD = ["can,not cannot's CANNOT! (gonna)", "wanna-be’gotta„lemme“ can", "", None, "a\x0bb\fcc  dd dd", "x'y don't the; THE,the é éé", "İstanbul ǅ cannot\tgimme ΑΣ", "cannotx xcannot nots not", "日本 日 «日本»日本\x1c日本"]


def test_chunks_of_texts_are_bounded(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc": list(range(9)), "lowered": ["red sun red"] * 4 + [None, "x" * 99] + ["", "a cannot", "moon"]})
    whole = list(C._chunks([batch]))
    monkeypatch.setattr(C, "BYTES", 24)
    parts = list(C._chunks([batch]))
    assert len(whole) == 1 and len(parts) == 4 and [d for p in parts for d in p.doc.to_pylist()] == list(range(9))
    assert np.concatenate([p.lengths for p in parts]).tolist() == whole[0].lengths.tolist() == [3, 3, 3, 3, 0, 1, 0, 1 - len({"can", "not"} & set(ENGLISH)) + 1, 1]
    assert all(sorted(set(p.codes)) == list(range(len(p.distinct))) for p in whole + parts)


def test_words_counted_in_texts_are_those_of_the_analyzer(spark):
    texts = spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string").coalesce(1)
    slow = S.analyzed(texts)
    occurrences = S.occurrences(slow, "doc", F.size("words").cast("bigint").alias("doc_len")).groupBy("doc", "word", "doc_len").count()
    expected = sorted((r.doc, r.word, r["count"], r.doc_len) for r in occurrences.collect())
    for docs in (slow, S.lowered(texts)):
        assert sorted(map(tuple, S.counted(docs).collect())) == expected
        total = S.entries(docs, totals=True).filter("word IS NULL").agg(F.sum("n"), F.sum("occurrences")).first()
        assert tuple(total) == (len(ODD), sum(n for _, _, n, _ in expected))
        lists = S.entries(docs).select("word", F.inline("entries")).select("doc", "word", "tf", "doc_len")
        assert sorted(map(tuple, lists.collect())) == expected
        assert sorted(map(tuple, S.frequencies(docs).collect())) == sorted(map(tuple, slow.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().collect()))


@pytest.mark.parametrize("name", ["doc_freq", "idf", "term_freq", "shard_pack", "bm25_scan"])
def test_pairs_of_document_and_word_are_not_grouped(spark, name):
    """Such a table is many times the texts, and spilled."""
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "Aggregate [doc#" not in plan and not any("doc_id#" in line.split("], [")[0] for line in plan.splitlines() if "Aggregate [" in line and "word" in line)


def test_documents_that_are_there_twice_are_counted_together(spark, tmp_path):
    rows = [(1, "red red sun"), (1, "red moon"), (None, "sun sun"), (2, ""), (None, "sun")]
    for name in ("term_freq", "doc_freq"):
        same(spark, tmp_path / name, name, documents=("doc_id long, text string", rows))
    docs = S.lowered(spark.createDataFrame(rows, "doc_id long, text string"))
    index = I.build_index(docs, str(tmp_path / "index"))
    assert sorted((r.word, r.df, str(r.doc), r.tf) for r in index.postings.collect()) == [("moon", 1, "1", 1), ("red", 1, "1", 3), ("sun", 2, "1", 1), ("sun", 2, "None", 3)]


def test_a_row_of_the_index_has_a_words_postings_in_many_documents(spark, tmp_path):
    docs = spark.range(40).coalesce(1).select(F.col("id").alias("doc"), F.array(F.lit("hot"), F.lit("hot")).alias("words"))
    index = I.build_index(docs, str(tmp_path))
    assert index.lists.count() == 1 and index.postings.filter("tf = 2 AND doc_len = 2 AND df = 40").count() == 40


def test_postings_are_made_of_texts_by_range(spark, tmp_path, monkeypatch):
    plan = catalog.QUERIES["postings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" not in plan and "hashpartitioning(doc#" in plan
    rows = [(i, ["red sun", "red moon red", "", None, "sun cannot"][i % 5]) for i in range(30)] + [(7, "sun")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    ids = I.document_ids(S.lowered(texts))
    monkeypatch.setattr(I, "WITHIN", 8)
    for docs in (S.lowered(texts), S.analyzed(texts)):
        for span in (4, 8, 20):
            ours = {(r.word, r.part): r.docs for r in I.text_postings(docs, ids, span).collect()}
            assert ours == {(r.word, r.part): r.docs for r in I.postings(S.term_frequencies(docs), ids, span).collect()}


def test_packed_lists_are_those_of_the_arrays(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "red red sun"), (-(2**62), "red sun"), (2**62, "red")]
    for kind in ("long", "string"):
        docs = S.lowered(spark.createDataFrame([(d if kind == "long" or d is None else f"d{d}", t) for d, t in rows], f"doc_id {kind}, text string").coalesce(1))
        plain, packed = S.entries(docs), S.entries(docs, packed=True)
        assert C.is_packed(packed) == (kind == "long") and not C.is_packed(plain)
        expected = sorted(map(str, C.opened(plain, "word", "n").collect()))
        assert sorted(map(str, C.opened(packed, "word", "n").collect())) == expected
        asked = spark.createDataFrame([("red",), ("can",), ("nowhere",)], "word string")
        some = S.entries(docs, totals=True, asked=asked, packed=True)
        assert sorted(map(str, C.opened(some.filter("word IS NOT NULL"), "word", "n").collect())) == [r for r in expected if "word='red'" in r or "word='can'" in r]
        assert some.filter("word IS NULL").agg(F.sum("n")).first()[0] == len(rows)


def test_postings_are_opened_from_bytes(spark, monkeypatch):
    """A row of a hot word has thousands of them, a batch thousands of rows."""
    docs = spark.range(50).coalesce(1).select(F.col("id").alias("doc"), F.concat(F.lit("hot w"), F.col("id").cast("string")).alias("lowered"))
    doc, tf, doc_len, lengths = C.unpacked(pa.array([bytes(r.entries) for r in S.entries(docs, packed=True).collect()]))
    assert len(doc) == lengths.sum() == 100 and set(tf) == {1} and set(doc_len) == {2} and max(lengths) == 50
    monkeypatch.setattr(C, "BYTES", 40)
    assert sorted(r.doc for r in C.opened(S.entries(docs, packed=True).filter("word = 'hot'"), "word").collect()) == list(range(50))


@pytest.mark.parametrize("name", ["bm25_scan", "tfidf_scan"])
def test_scans_hand_over_the_words_asked_for_only(spark, tmp_path, name, monkeypatch):
    """Lists of all words used to leave the batches that they were counted in."""
    from gleaner.operators import search as Q

    seen = []
    inner = Q.written
    monkeypatch.setattr(Q, "written", lambda df, what: seen.append(plan_of(df)) or inner(df, what))
    same(spark, tmp_path, name, documents=("doc_id long, text string", [(1, "red sun red"), (2, "moon"), (3, None), (4, "sun")]), benchmark=("item_id long, text string", [(7, "red sun"), (8, "moon dust"), (9, "")]))
    assert seen and "Join" not in seen[0]


def test_an_index_finds_words_above_the_limit_wherever_they_are(spark, tmp_path):
    docs = spark.range(60).repartition(4).select(F.col("id").alias("doc"), F.concat(F.lit("hot "), F.when(F.col("id") < 30, "warm").otherwise("cold")).alias("lowered"))
    index = I.build_index(docs, str(tmp_path), limit=40)
    assert C.is_packed(index.lists)
    terms = {r.word: (r.df, r.shard) for r in index.terms.collect()}
    assert {w: d for w, (d, _) in terms.items()} == {"hot": 60, "warm": 30, "cold": 30}
    assert terms["hot"][1] >= 3 and terms["warm"][1] < 3 and terms["cold"][1] < 3  # 120 postings: 3 shards, then those of hot words
    assert {(r.word, r.df, r.shard) for r in index.lists.collect()} == {(w, *of) for w, of in terms.items()}
    assert tuple(index.stats.first()) == (60, 2.0)


def test_texts_that_no_hit_names_are_not_shuffled(spark, monkeypatch):
    hits = spark.createDataFrame([(1, 3), (1, 9), (2, 3), (2, None)], "qid int, doc long")
    texts = spark.range(40).select(F.col("id").alias("doc"), F.when(F.col("id") != 9, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        df = A.attach_text(hits, texts)
        got = sorted(map(str, df.collect()))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan and "strategy=broadcast" in plan
        monkeypatch.setattr(A, "MOST_BROADCAST", 0)
        assert sorted(map(str, A.attach_text(hits, texts).collect())) == got and len(got) == 4 and sum("t3" in r for r in got) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_verified_where_they_are(spark, tmp_path):
    docs = [(1, "a red sun over the old town rises"), (2, "red sun over the"), (3, None), (4, "the a red  sun over the old town"), (5, "x")]
    passages = [(7, "red sun over the old"), (8, "sun over"), (11, " sun over the"), (12, "sun over\n"), (13, None), (9, "a red sun over the old town rises and"), (10, "the old town")]
    rows = same(spark, tmp_path, "passage_targets", documents=("doc_id long, text string", docs), benchmark=("item_id long, text string", passages))
    assert len(rows) == 9
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["passage_targets"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
