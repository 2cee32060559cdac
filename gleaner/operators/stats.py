"""Term statistics: frequencies, lengths, inverse document frequencies, sparse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import BM25Params
from gleaner.functions.text import simple_words
from gleaner.operators import counting as C
from gleaner.sources.work import written


def analyzed(docs: DataFrame, doc: str = "doc_id", text: str = "text", words=simple_words) -> DataFrame:
    """(doc, words): every document, those without words too."""
    return docs.select(F.col(doc).alias("doc"), words(F.col(text)).alias("words"))


def lowered(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lowered): documents whose words, in the simple profile, are taken where they are counted."""
    return docs.select(F.col(doc).alias("doc"), F.lower(F.col(text)).alias("lowered"))


def listed(docs: DataFrame) -> DataFrame:
    """(doc, words) of either form of documents."""
    return docs if "words" in docs.columns else docs.select("doc", simple_words(F.col("lowered")).alias("words"))


def occurrences(docs: DataFrame, *columns) -> DataFrame:
    """The ``columns`` and a row for each word. From a plain explode the optimizer infers filters on
    the list, which it moves below the analysis, so that each text would be analysed three times."""
    return docs.select(*columns, F.explode_outer("words").alias("word")).filter(F.col("word").isNotNull())


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(doc, word, tf) from (doc, words)."""
    return counted(docs).select("doc", "word", "tf")


def counted(docs: DataFrame) -> DataFrame:
    """(doc, word, tf, doc_len): the length travels with the words, so that there is no join on the document.
    Words are counted where their document is; only where a document is there more than once the pairs are grouped."""
    if not C.repeated(docs):
        return C.counted(docs)
    docs = listed(docs)
    rows = occurrences(docs, "doc", F.size("words").cast("bigint").alias("doc_len"))
    return rows.groupBy("doc", "word").agg(F.count("*").alias("tf"), F.max("doc_len").alias("doc_len"))


def frequencies(docs: DataFrame) -> DataFrame:
    """(word, df) from (doc, words): summed inside batches of documents first."""
    if C.repeated(docs):
        return document_frequencies(term_frequencies(docs))
    return C.frequencies(docs).groupBy("word").agg(F.sum("n").alias("df"))


def entries(docs: DataFrame, totals: bool = False, asked: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """(word, part, n, occurrences, entries) from (doc, words): lists of postings, a row for each word in
    each part of the documents. A document is in one part. With ``totals`` there are also rows
    without a word, which hold numbers of documents and of their words. Of the words ``asked`` only, if such
    are given: (word), each once, so few that every task may have them. ``packed``: see :func:`counting.entries`."""
    if not C.repeated(docs):
        return C.entries(docs, totals, None if asked is None else [r.word for r in asked.collect()], packed)
    tf = counted(docs) if asked is None else counted(docs).join(F.broadcast(asked), "word", "left_semi")
    one = F.array(F.struct("doc", F.col("tf").cast("int").alias("tf"), F.col("doc_len").cast("int").alias("doc_len")))
    part = F.pmod(F.xxhash64("doc"), F.lit(1024))
    lists = tf.select("word", part.alias("part"), F.lit(1).cast("bigint").alias("n"), F.col("tf").alias("occurrences"), one.alias("entries"))
    if not totals:
        return lists
    every = document_lengths(listed(docs)).agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("occurrences"))
    return lists.unionByName(every.select(F.lit(None).cast("string").alias("word"), F.lit(0).cast("bigint").alias("part"), "n", "occurrences", F.array().cast(lists.schema["entries"].dataType).alias("entries")))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("word").agg(F.count("*").alias("df"))


def merge_frequencies(*parts: DataFrame) -> DataFrame:
    """Document frequencies of disjoint parts of a corpus, summed."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("word").agg(F.sum("df").alias("df"))


def document_lengths(docs: DataFrame) -> DataFrame:
    """(doc, doc_len): words in all; from the arrays, without a shuffle."""
    return docs.select("doc", F.coalesce(F.size("words"), F.lit(0)).cast("bigint").alias("doc_len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: corpus_size and avg_doc_len, over all documents."""
    return lengths.agg(F.count("*").alias("corpus_size"), F.avg("doc_len").alias("avg_doc_len"))


def counted_stats(docs: DataFrame, tf: DataFrame, count: str = "tf") -> DataFrame:
    """:func:`corpus_stats` from term frequencies, in the column ``count``: their sum is that of the lengths, so no text is analysed again."""
    words = tf.agg(F.coalesce(F.sum(count), F.lit(0)).alias("_words"))
    size = docs.agg(F.count("*").alias("corpus_size"))
    return size.join(F.broadcast(words)).select("corpus_size", F.try_divide(F.col("_words").cast("double"), F.col("corpus_size").cast("double")).alias("avg_doc_len"))


def average_size(tf: DataFrame, corpus_size: int) -> DataFrame:
    return tf.agg((F.sum("tf") / F.lit(corpus_size)).alias("avg_doc_len"))


def document_count(rows: DataFrame) -> DataFrame:
    """How many documents have rows."""
    return rows.agg(F.countDistinct("doc").alias("n_docs"))


def idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(word, df, idf = ln(N / df)). ``stats`` is one row."""
    return df.join(F.broadcast(stats)).select("word", "df", F.log(F.col("corpus_size") / F.col("df")).alias("idf"))


def bm25_weight(tf, doc_len, idf_, avg_doc_len, params: BM25Params):
    return idf_ * tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * doc_len / avg_doc_len))


def sparse_vectors(docs: DataFrame, params: BM25Params = BM25Params()) -> DataFrame:
    """(doc, word, tf, doc_len, idf, tf_idf, bm25). The vocabulary grows with the corpus, so it is joined by the planner's choice and never forced to be broadcast."""
    tf = written(counted(docs), "tf")  # read three times
    stats = counted_stats(docs, tf)
    weights = idf(document_frequencies(tf), stats)
    rows = tf.join(weights.select("word", "idf"), "word", "left").join(F.broadcast(stats))
    return rows.select(
        "doc", "word", "tf", "doc_len", "idf", (F.col("tf") * F.col("idf")).alias("tf_idf"), bm25_weight(F.col("tf"), F.col("doc_len"), F.col("idf"), F.col("avg_doc_len"), params).alias("bm25")
    )


def normalised_tf(docs: DataFrame) -> DataFrame:
    """(doc, word, ntf): count over the document's length."""
    return counted(docs).select("doc", "word", (F.col("tf") / F.col("doc_len")).alias("ntf"))


def top_terms(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("df"), "word").limit(k)
