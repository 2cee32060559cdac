"""Maps in MessagePack files: rows (key, value) from files that hold one map each, and back.

The format is the public one (nil, booleans, integers, floats, strings, binary, arrays, maps).
Files are read by Spark, from any store; a file is decoded in one task, since a map has no index.
Each task of a write makes one file, so that a table of any size can be written and read again.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: The first byte of values of a kind, and how what follows is read (a number, or a length).
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_LENGTHS = {
    0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"),
    0xDC: (">H", "list"), 0xDD: (">I", "list"), 0xDE: (">H", "map"), 0xDF: (">I", "map"),
}
_ALONE = {0xC0: None, 0xC2: False, 0xC3: True}


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def _take(self, form: str):
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return value

    def head(self) -> tuple[str, object]:
        """What comes next: ("value", it) or its kind and length."""
        first = self._take(">B")
        if first < 0x80 or first >= 0xE0:
            return "value", first if first < 0x80 else first - 256
        if first < 0xC0:
            return ("map", first & 15) if first < 0x90 else ("list", first & 15) if first < 0xA0 else ("str", first & 31)
        if first in _ALONE:
            return "value", _ALONE[first]
        if first in _NUMBERS:
            return "value", self._take(_NUMBERS[first])
        if first in _LENGTHS:
            form, kind = _LENGTHS[first]
            return kind, self._take(form)
        raise ValueError(f"unknown type {first:#x} at {self.at - 1}")

    def value(self):
        kind, n = self.head()
        if kind == "value":
            return n
        if kind in ("str", "bin"):
            self.at += n
            if self.at > len(self.data):
                raise ValueError("the file ends within a value")
            raw = self.data[self.at - n : self.at]
            return raw.decode("utf-8") if kind == "str" else raw
        if kind == "list":
            return [self.value() for _ in range(n)]
        return {self.value(): self.value() for _ in range(n)}

    def entries(self) -> Iterator[tuple]:
        """The pairs of the map that the file holds, one by one."""
        kind, n = self.head()
        if kind != "map":
            raise ValueError("the file holds no map")
        for _ in range(n):
            yield self.value(), self.value()


def encode(value) -> bytes:
    if value is None or value is True or value is False:
        return bytes([{None: 0xC0, False: 0xC2, True: 0xC3}[value]])
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack(">b", value)
        for first in (0xCC, 0xCD, 0xCE, 0xCF) if value >= 0 else (0xD0, 0xD1, 0xD2, 0xD3):
            try:
                return bytes([first]) + struct.pack(_NUMBERS[first], value)
            except struct.error:
                continue
        raise ValueError("an integer needs 64 bits at most")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode("utf-8")
        return _length(len(raw), (0xD9, 0xDA, 0xDB), 0xA0, 32) + raw
    if isinstance(value, (bytes, bytearray)):
        return _length(len(value), (0xC4, 0xC5, 0xC6)) + bytes(value)
    if isinstance(value, dict):
        return _length(len(value), (None, 0xDE, 0xDF), 0x80, 16) + b"".join(encode(k) + encode(v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return _length(len(value), (None, 0xDC, 0xDD), 0x90, 16) + b"".join(map(encode, value))
    raise TypeError(f"no form for {type(value).__name__}")


def _length(n: int, firsts: tuple, short: int = 0, below: int = 0) -> bytes:
    if n < below:
        return bytes([short + n])
    for first, form, most in zip(firsts, (">B", ">H", ">I"), (1 << 8, 1 << 16, 1 << 32)):
        if first and n < most:
            return bytes([first]) + struct.pack(form, n)
    raise ValueError("too long")


def load_msgpack(spark: SparkSession, path: str | list[str], value: str = "bigint") -> DataFrame:
    """(key: string, value) of the maps in the files at ``path``; ``value`` is a Spark type. A map's key that is a number is its digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                keys, values = [], []
                for k, v in Decoder(content.as_py()).entries():
                    keys.append(str(k))
                    values.append(json.dumps(v))
                    if len(keys) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], names=["key", "json"])
                        keys, values = [], []
                yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.string()), pa.array(values, type=pa.string())], names=["key", "json"])

    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("content")
    rows = files.mapInArrow(run, "key string, json string")
    whole = F.from_json(F.concat(F.lit('{"v":'), F.col("json"), F.lit("}")), f"v {value}")
    return rows.select("key", whole["v"].alias("value"))


class _Written(WriterCommitMessage):
    pass


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        body, n = [], 0
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body.append(encode(k) + encode(_plain(v)))
                n += 1
        if n:
            fs, where = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)
            fs.create_dir(where, recursive=True)
            name = f"{where}/part-{uuid.uuid4().hex}.msgpack"
            with fs.open_output_stream(f"{name}.tmp") as out:
                out.write(_length(n, (None, 0xDE, 0xDF), 0x80, 16) + b"".join(body))
            fs.move(f"{name}.tmp", name)  # a file is there whole or not at all
        return _Written()


def _plain(value):
    return dict(value) if isinstance(value, list) and value and all(isinstance(x, tuple) for x in value) else value


class MsgpackSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gleaner_msgpack"

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options["path"])


def save_msgpack(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write rows (key, value) as maps, a file for each task (or ``files``), in a folder that all tasks reach; what lies there goes first."""
    from gleaner.sources.tables import clear

    spark = df.sparkSession
    clear(spark, path)
    spark.dataSource.register(MsgpackSink)
    key, value = df.columns
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    (rows.coalesce(files) if files else rows).write.format("gleaner_msgpack").mode("append").save(path)
