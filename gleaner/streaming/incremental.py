"""Statistics kept up to date from a stream of documents.

The engine's counts are sums over documents, so a micro-batch adds its own: each batch is written
under its number (a batch that is repeated after a failure overwrites itself), and reading sums up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators import stats as S


def _write_batch(root: str, doc: str, text: str):
    def run(batch: DataFrame, number: int) -> None:
        docs = S.analyzed(batch, doc, text)
        docs.persist()
        try:
            S.frequencies(docs).write.mode("overwrite").parquet(f"{root}/df/batch={number}")
            S.document_lengths(docs).agg(F.count("*").alias("docs"), F.sum("doc_len").alias("words")).write.mode("overwrite").parquet(f"{root}/totals/batch={number}")
        finally:
            docs.unpersist()

    return run


def maintain_statistics(stream: DataFrame, root: str, checkpoint: str, doc: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Start a query that keeps document frequencies and totals of the documents of ``stream`` under ``root``; each document must come once."""
    return stream.writeStream.foreachBatch(_write_batch(root, doc, text)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_statistics(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """((word, df), one row of corpus_size and avg_doc_len) as of now."""
    df = spark.read.parquet(f"{root}/df").groupBy("word").agg(F.sum("df").alias("df"))
    totals = spark.read.parquet(f"{root}/totals").agg(F.sum("docs").alias("corpus_size"), (F.sum("words") / F.sum("docs")).alias("avg_doc_len"))
    return df, totals


def windowed_terms(stream: DataFrame, ts: str, text: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, word, n): term counts in event-time windows; events later than ``late`` are dropped."""
    from gleaner.functions.text import simple_words

    words = stream.withWatermark(ts, late).select(F.col(ts).alias("ts"), F.explode(simple_words(F.col(text))).alias("word"))
    return words.groupBy(F.window("ts", window), "word").agg(F.count("*").alias("n"))
