"""Shared plumbing of the llm operators: the shared work folder, written tables, sources."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: dict[str, str] = {}
#: Lists that the paths of written tables go to, see written().
_OPEN: list[list[str]] = []

#: One word: a run of anything but ASCII white space (Java and DuckDB regex alike).
WORD = r"[^\x20\x09-\x0D]+"

#: Texts go to Python in batches of about this size (Spark's default is 64 MB for each task and side).
BATCH_BYTES = 8 << 20
#: Output of a Python operator is handed back to Spark in pieces of about this size.
FLUSH_BYTES = 8 << 20


def work_folder(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``. Where it is unset, a
    session on this machine alone gets a temporary folder; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="gleaner-")
    return _OWN_FOLDER[app]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: the lineage ends
    there, so a lost executor costs a read and not a recomputation. Extra attribute
    ``written_path`` is for :func:`release`."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/gleaner/{name}-{uuid.uuid4().hex}"
    for opened in _OPEN:
        opened.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


@contextlib.contextmanager
def written(spark: SparkSession) -> Iterator[list[str]]:
    """The paths of all tables that are written meanwhile; whoever consumes an operator's result
    can :func:`delete` them afterwards, also those that the result itself reads."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not paths]


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame | None) -> None:
    """Delete a table written by :func:`materialize` that no later plan reads."""
    if path := getattr(df, "written_path", None):
        delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def words_array(text) -> F.Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


class Rows:
    """Collects rows column by column and hands out record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.cols, self.size = schema, [[] for _ in schema], 0

    def add(self, row: tuple, size: int = 64) -> None:
        for col, value in zip(self.cols, row):
            col.append(value)
        self.size += size

    def full(self) -> bool:
        return self.size >= FLUSH_BYTES

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(self.cols, self.schema)], schema=self.schema)
            self.cols, self.size = [[] for _ in self.schema], 0


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches hold BATCH_BYTES at most, if they held more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(spark.conf.get(key)).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(run):
    """A function over batches whose worker gives its memory back at the end: idle workers stay for a minute."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped
