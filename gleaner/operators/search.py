"""Search operators over batches of queries.

A query table is (qid, text). Its words are few and are broadcast only behind a check of their
number; scores are rounded before ranking, so that ties don't hang on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import DEFAULT_RESULTS, BM25Params, check_results
from gleaner.functions.text import simple_words
from gleaner.operators import counting as C
from gleaner.operators import scoring as P
from gleaner.operators import stats as S
from gleaner.operators.index import StoredIndex
from gleaner.sources.work import written

#: Query words that may be broadcast; beyond, the planner joins by shuffle.
MOST_BROADCAST = 200_000
DIGITS = 9


def query_words(queries: DataFrame, words=simple_words) -> DataFrame:
    """(qid, word, qtf)."""
    return queries.select("qid", F.explode(words(F.col("text"))).alias("word")).groupBy("qid", "word").agg(F.count("*").alias("qtf"))


def small(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if a count shows that it is small."""
    return marker(rows)(rows)


def marker(words: DataFrame):
    """What marks frames with at most a row per row of ``words`` for broadcast: checked once, on
    the query's words, whose number bounds all that is derived from them (their frequencies)."""
    return F.broadcast if words.count() <= MOST_BROADCAST else lambda rows: rows


def matching(docs: DataFrame, words: DataFrame, mark=None) -> DataFrame:
    """(word, part, n, entries) of the words asked for: lists of postings in each part of the documents."""
    asked = (mark or marker(words))(words.select("word").distinct())
    return S.entries(docs, packed=True).join(asked, "word", "left_semi").select("word", "part", "n", "entries")


def candidates(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(qid, doc): documents with at least one of a query's words. ``words``: (qid, word)."""
    mark = marker(words)
    return P.asked_for(_asked(matching(docs, words, mark), words.withColumn("weight", F.lit(1.0)), mark))


def weighted_lists(docs: DataFrame, words: DataFrame, mark=None) -> tuple[DataFrame, float | None]:
    """(word, part, idf, entries) of the words asked for, and the documents' average length.

    The document frequency of a word counts all its rows, so the restriction to the words asked
    for changes nothing; the corpus statistics are over all documents, from the same pass over the texts."""
    mark = mark or marker(words)
    asked = words.select("word").distinct()
    few = mark is F.broadcast  # then postings of other words don't leave the batch that they are counted in
    # each part has a row without a word, for the statistics
    rows = written(S.entries(docs, totals=True, asked=asked if few else None, packed=True), "matching")
    size, occurrences = rows.filter("word IS NULL").agg(F.sum("n"), F.sum("occurrences")).first()
    rows = rows.filter("word IS NOT NULL") if few else rows.join(asked, "word", "left_semi")
    idf = rows.groupBy("word").agg(F.log(F.lit(size) / F.sum("n")).alias("idf"))
    return rows.join(mark(idf), "word").select("word", "part", "idf", "entries"), occurrences / size if size else None


def weighted(docs: DataFrame, words: DataFrame, params: BM25Params = BM25Params(), mark=None) -> DataFrame:
    """(word, doc, tf, idf, tf_idf, bm25) of the words asked for: the part of the sparse vectors that a search reads."""
    return _opened(*weighted_lists(docs, words, mark), params)


def _opened(lists: DataFrame, avg_doc_len: float | None, params: BM25Params) -> DataFrame:
    rows = C.opened(lists, "word", "idf").withColumn("tf", F.col("tf").cast("bigint"))
    weight = S.bm25_weight(F.col("tf"), F.col("doc_len"), F.col("idf"), F.lit(avg_doc_len).cast("double"), params)
    return rows.select("word", "doc", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tf_idf"), weight.alias("bm25"))


def top(scored: DataFrame, k: int, score: str = "score", tie: str = "doc", ascending: bool = False) -> DataFrame:
    """The ``k`` best of each query with ``rank`` from 1; nulls last, ties by ``tie``."""
    order = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(order, tie))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= check_results(k))


def bm25(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_RESULTS, params: BM25Params = BM25Params(), words=simple_words, min_score: float | None = None) -> DataFrame:
    """(qid, doc, score, rank): sum of BM25 over a query's distinct words; unknown words add nothing. ``docs``: (doc, words)."""
    asked = query_words(queries, words).select("qid", "word")
    mark = marker(asked)
    return _summed(*weighted_lists(docs, asked, mark), asked, mark, k, params, min_score)


def tfidf(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_RESULTS, words=simple_words, min_score: float | None = None) -> DataFrame:
    """(qid, doc, score, rank): cosine of the query's and the document's TF-IDF over the query's words; null where a norm is 0."""
    asked = query_words(queries, words)
    mark = marker(asked)
    return _cosines(weighted_lists(docs, asked, mark)[0], asked, mark, k, min_score)


def stored_lists(index: StoredIndex, words: DataFrame) -> tuple[DataFrame, float | None]:
    """The same as :func:`weighted_lists` from a stored index, of which only the words' parts are read."""
    stats = index.stats.first()
    idf = F.log(F.lit(stats.corpus_size) / F.col("df"))
    return index.read_lists(words).select("word", "part", idf.alias("idf"), "entries"), stats.avg_doc_len


def stored_weights(index: StoredIndex, words: DataFrame, params: BM25Params = BM25Params()) -> DataFrame:
    """The same as :func:`weighted` from a stored index."""
    return _opened(*stored_lists(index, words), params)


def bm25_stored(index: StoredIndex, queries: DataFrame, k: int = DEFAULT_RESULTS, params: BM25Params = BM25Params(), words=simple_words, min_score: float | None = None) -> DataFrame:
    """:func:`bm25` from a stored index; the parameters take effect, since frequencies and lengths are stored."""
    asked = query_words(queries, words).select("qid", "word")
    return _summed(*stored_lists(index, asked), asked, marker(asked), k, params, min_score)


def tfidf_stored(index: StoredIndex, queries: DataFrame, k: int = DEFAULT_RESULTS, words=simple_words, min_score: float | None = None) -> DataFrame:
    """:func:`tfidf` from a stored index."""
    asked = query_words(queries, words)
    return _cosines(stored_lists(index, asked)[0], asked, marker(asked), k, min_score)


def _asked(lists: DataFrame, asked: DataFrame, mark) -> DataFrame:
    """Lists with those who ask for their word; ``asked``: (qid, word, weight)."""
    return lists.join(mark(asked.groupBy("word").agg(F.collect_list(F.struct("qid", "weight")).alias("asks"))), "word")


def _summed(lists: DataFrame, avg_doc_len: float | None, asked: DataFrame, mark, k: int, params: BM25Params, min_score: float | None) -> DataFrame:
    rows = _asked(lists, asked.withColumn("weight", F.lit(1.0)), mark)
    return top(at_least(P.summed(rows, check_results(k), DIGITS, params, avg_doc_len), min_score), k)


def _cosines(lists: DataFrame, asked: DataFrame, mark, k: int, min_score: float | None) -> DataFrame:
    idf = mark(lists.select("word", "idf").distinct())
    vectors = asked.join(idf, "word").withColumn("qw", F.col("qtf") * F.col("idf"))
    norms = vectors.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    weights = vectors.join(mark(norms), "qid").select("qid", "word", F.coalesce(F.try_divide("qw", "qnorm"), F.lit(float("nan"))).alias("weight"))
    return top(at_least(P.cosines(_asked(lists, weights, mark), check_results(k), DIGITS), min_score), k)


def at_least(scored: DataFrame, min_score: float | None) -> DataFrame:
    """Rows with at least ``min_score``; all of them without one."""
    return scored if min_score is None else scored.filter(F.col("score") >= min_score)


def search_index(sparse: DataFrame, queries: DataFrame, k: int = DEFAULT_RESULTS, words=simple_words, weight: str = "bm25") -> DataFrame:
    """BM25 from stored sparse vectors; the words asked for reach the scan through the join."""
    asked = query_words(queries, words).select("qid", "word")
    scored = sparse.select("word", "doc", F.col(weight).alias("w")).join(small(asked), "word").groupBy("qid", "doc").agg(F.round(F.sum("w"), DIGITS).alias("score"))
    return top(scored, k)
