"""Sinks and sources of the engine's tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.msgpack import load_msgpack, save_msgpack

FORMATS = ("parquet", "json", "orc", "csv", "avro")


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.format(_known(fmt)).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def load(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(_known(fmt))
    return (reader.schema(schema) if schema else reader).load(path)


def load_map(spark: SparkSession, path: str, value: str = "bigint", fmt: str = "json") -> DataFrame:
    """(key, value) of files that hold one JSON object each, or one MessagePack map."""
    if fmt == "msgpack":
        return load_msgpack(spark, path, value)
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def save_map(df: DataFrame, path: str, formats: tuple[str, ...] = ("json", "msgpack")) -> None:
    """Rows (key, value) as maps, a file for each task, in a folder for each format."""
    key, value = df.columns
    for fmt in formats:
        if fmt not in ("json", "msgpack"):
            raise ValueError(f"unknown format {fmt!r} of a map")
        if fmt == "msgpack":
            save_msgpack(df, f"{path}/msgpack")
            continue

        def run(batches):
            parts = [p for batch in batches for p in batch.column(0).to_pylist()]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(["{" + ",".join(parts) + "}"])], names=["value"])

        # "key":value, as the part of a struct between its braces
        pair = F.concat(F.regexp_replace(F.to_json(F.struct(F.col(key).cast("string").alias("k"))), r"^\{\"k\":|\}$", ""), F.lit(":"), F.coalesce(F.regexp_replace(F.to_json(F.struct(F.col(value).alias("v")), {"ignoreNullFields": "false"}), r"^\{\"v\":|\}$", ""), F.lit("null")))
        df.select(pair.alias("pair")).mapInArrow(run, "value string").write.mode("overwrite").text(f"{path}/json")


def save_postings(postings: DataFrame, path: str) -> None:
    """Postings sorted by word, so that a lookup reads few row groups."""
    postings.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(path)


def clear(spark: SparkSession, path: str) -> bool:
    """Delete what lies at a path; whether there was anything."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class VectorTable:
    """(file, start_end, vector) as Parquet; every vector must have ``dims`` components."""

    SCHEMA = "file string, start_end array<int>, vector array<float>"

    def __init__(self, spark: SparkSession, path: str, dims: int):
        self.spark, self.path, self.dims = spark, path, dims

    def _checked(self, rows: DataFrame) -> DataFrame:
        wrong = F.raise_error(F.concat(F.lit(f"a vector needs {self.dims} components, this has "), F.size("vector").cast("string")))
        rows = rows.select(F.col("file").cast("string"), F.col("start_end").cast("array<int>"), F.col("vector").cast("array<float>"))
        return rows.withColumn("vector", F.when(F.size("vector") == self.dims, F.col("vector")).otherwise(wrong))

    def create(self, rows: DataFrame) -> None:
        self._checked(rows).write.mode("overwrite").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """Add the rows whose (file, start_end) isn't there yet: a run that is repeated adds nothing."""
        there = self.read().select("file", "start_end").distinct()
        self._checked(rows).dropDuplicates(["file", "start_end"]).join(there, ["file", "start_end"], "left_anti").select("file", "start_end", "vector").write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)


def print_results(results: DataFrame, kind: str, n: int = 20, show_text: bool = False) -> None:
    """Console sink; ``kind``: tf-idf, bm25, vector or rerank."""
    if kind not in ("tf-idf", "bm25", "vector", "rerank"):
        raise ValueError(f"unknown search type {kind!r}")
    columns = [c for c in results.columns if show_text or c != "text"]
    results.select(*columns).orderBy("rank").show(n, truncate=not show_text)


def _known(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    return fmt
