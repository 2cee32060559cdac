"""Evaluation: ranks of targets, recall at cut-offs, query sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTOFFS = (5, 10, 25, 50)


def target_ranks(targets: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, doc, rank): where each target stands among a query's results, -1 if nowhere. ``targets``: (qid, doc)."""
    hits = results.groupBy("qid", "doc").agg(F.max("rank").alias("rank"))
    return targets.join(hits, ["qid", "doc"], "left").select("qid", "doc", F.coalesce("rank", F.lit(-1)).cast("int").alias("rank"))


def recall(ranks: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """One row: targets, and the share of them within each cut-off."""
    return ranks.agg(F.count("*").alias("targets"), *[F.avg(((F.col("rank") > 0) & (F.col("rank") <= k)).cast("double")).alias(f"recall_at_{k}") for k in cutoffs])


def questions(cases: DataFrame, search, cutoffs=CUTOFFS) -> DataFrame:
    """Recall of general questions. ``cases``: (target, question), each question a query of its own;
    ``search``: a function from queries (qid, text) to results (qid, doc, rank)."""
    asked = cases.select(F.xxhash64("target", "question").alias("qid"), F.col("target").alias("doc"), F.col("question").alias("text")).distinct()
    return recall(target_ranks(asked.select("qid", "doc"), search(asked.select("qid", "text"))), cutoffs)


def average_latency(timings: DataFrame) -> DataFrame:
    return timings.groupBy("engine").agg(F.avg("elapsed").alias("avg_elapsed"))


def sample_documents(docs: DataFrame, n: int = 5, seed: int = 4321, doc: str = "doc_id") -> DataFrame:
    """``n`` documents by a seeded hash: the same ones whatever the partitions."""
    return docs.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(doc).cast("string"))), doc).limit(n)


def exact_passages(docs: DataFrame, n_tokens: int = 25, seed: int = 4321, share: float = 0.75) -> DataFrame:
    """(doc, passage): ``n_tokens`` words from a seeded start within the first ``share`` of a document's words. ``docs``: (doc, words)."""
    spot = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.greatest(F.lit(1), F.floor(F.size("words") * share)))
    passage = F.array_join(F.slice("words", (spot + 1).cast("int"), n_tokens), " ")
    # a filter on the words themselves would go below the analysis, and each text be analysed twice
    return docs.select("doc", F.explode_outer(F.when(F.size("words") > 0, F.array(passage))).alias("passage")).filter(F.col("passage").isNotNull())


def weighted_paragraph(paragraphs: DataFrame, seed: int = 4321) -> DataFrame:
    """One paragraph of each document, the longer the likelier: (doc, para, text) in, one row per document out."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc").cast("string"), F.lit(":"), F.col("para").cast("string"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)
    keyed = paragraphs.filter(F.length("text") > 0).withColumn("_key", -F.log(u) / F.length("text"))
    return keyed.groupBy("doc").agg(F.min_by(F.struct("para", "text"), "_key").alias("p")).select("doc", "p.para", "p.text")
