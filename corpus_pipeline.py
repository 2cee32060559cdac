"""The corpus pipeline: quality rules, line dedup, near-duplicate join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows
as Parquet in the shared folder and reads them back for the next. All stages but the last return
the columns of ``documents``; what a stage has written on the way is deleted when its rows are there.

Cases. Null and empty texts fail the quality rules. Null and repeated ids: a row is told apart by its
id and text; of equal rows one stays in the Jaccard stage. Null language or source is a value of its
own. Very long texts are taken whole. Extra columns, also clashing ones, are left out by the first
stage. An empty table gives an empty result of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, lines, mixing, njaccard, quality
from gleaner.llm.common import delete, documents, materialize, release, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the outlier rule rejects go."""
    return quality.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts; a document that consists of repeats only goes."""
    out = lines.dedup_lines(docs.select(*COLUMNS))
    out = out.filter(F.col("_ln_gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("_ln_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest id stays."""
    return njaccard.keep_one(docs.select(*COLUMNS), k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's share of the token budget; a document drawn twice is there twice."""
    rows = mixing.mix(docs.select(*COLUMNS, F.expr(mixing.DOMAIN).alias("domain")), budget_percent=100)
    return rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_mix_copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that they decode to."""
    return bpe.digests(docs, bpe.load())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: The outlier model has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        with written(spark) as paths:
            before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{i}")
        for path in paths:
            if path != docs.written_path:
                delete(spark, path)
        release(before)
    return docs
