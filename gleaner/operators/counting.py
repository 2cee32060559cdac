"""Words counted inside batches of documents, in Arrow: a table of all pairs of document and word
is neither kept in memory by a task nor shuffled.

Documents are (doc, words), or (doc, lowered): texts in lower case, of which the simple profile's words
are taken here, as bytes. Each document is there once: the callers in ``stats`` look for repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.stopwords import ENGLISH
from gleaner.functions.text import DROPPED, QUOTES, SPACED, TWO_WORDS

#: Words, or bytes of text, that are counted at a time; a longer document is counted by itself.
WORDS = 2_000_000
BYTES = 16 << 20
#: Rows that are handed to Spark at a time.
ROWS = 200_000

_SPACES = bytes(32 if chr(i) in SPACED else i for i in range(256))
_QUOTES = [q.encode() for q in QUOTES]


class Chunk(NamedTuple):
    """Documents with the places of their words: ``codes`` into ``distinct``, ``rows`` into ``doc``."""

    doc: pa.Array
    lengths: np.ndarray
    distinct: pa.Array
    codes: np.ndarray
    rows: np.ndarray

    def pairs(self, by_word: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code, row and number of each pair of word and document, in the order of words or documents."""
        wide = max(1, len(self.doc) if by_word else len(self.distinct))
        key = self.codes * wide + self.rows if by_word else self.rows * wide + self.codes
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        high, low = np.divmod(key[first], wide)
        return *((high, low) if by_word else (low, high)), np.diff(np.concatenate([first, [len(key)]]))

    def only(self, words: pa.Array) -> Chunk:
        """With the places of these words only; lengths stay."""
        keep = pc.is_in(self.distinct, value_set=words).to_numpy(zero_copy_only=False)
        at = keep[self.codes]
        return self._replace(distinct=self.distinct.filter(pa.array(keep)), codes=(np.cumsum(keep) - 1)[self.codes[at]], rows=self.rows[at])


def _coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return coded.dictionary, lengths, codes[codes >= 0], rows[codes >= 0]


def _bytes(text: bytes | None) -> bytes:
    """The words of a text between white space."""
    plain = (text or b"").translate(_SPACES, DROPPED.encode())
    if not plain.isascii():
        for q in _QUOTES:
            plain = plain.replace(q, b" ")
    return plain


def _simple(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The same as :func:`_coded` of the texts' words in the simple profile."""
    plain = pa.array([_bytes(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
    distinct, _, codes, rows = _coded(pc.ascii_split_whitespace(plain))
    halves = {w: two.split() for w, two in TWO_WORDS.items()}
    split = []
    for w, at in zip(halves, pc.index_in(pa.array(list(halves)), value_set=distinct).to_pylist()):
        if at is not None:
            distinct = pa.concat_arrays([distinct, pa.array(halves[w])])  # repeated words are made one below
            where = codes == at
            split.append(at)
            codes = np.concatenate([codes[~where], *(np.full(where.sum(), len(distinct) - i) for i in (2, 1))])
            rows = np.concatenate([rows[~where], rows[where], rows[where]])
    keep = pc.and_(pc.greater(pc.utf8_length(distinct), 1), pc.invert(pc.is_in(distinct, value_set=pa.array(list(ENGLISH))))).to_numpy(zero_copy_only=False).copy()
    keep[split] = False  # each word that is left is there at least once
    kept = distinct.filter(pa.array(keep)).dictionary_encode()
    to = np.full(len(distinct), -1)
    to[keep] = kept.indices.to_numpy(zero_copy_only=False)
    codes = to[codes]
    codes, rows = codes[codes >= 0], rows[codes >= 0]
    return kept.dictionary, np.bincount(rows, minlength=len(texts)), codes, rows


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        listed = "words" in batch.schema.names
        doc, content = batch.column("doc"), batch.column("words" if listed else "lowered")
        sizes, most = (pc.list_value_length(content), WORDS) if listed else (pc.binary_length(content), BYTES)
        ends, start = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")))
            part = content.slice(start, stop - start)
            distinct, lengths, codes, rows = _coded(part) if listed else _simple(part)
            yield Chunk(doc.slice(start, stop - start), lengths, distinct, codes, rows)
            start = stop


def _handed(columns: dict) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_pydict(columns)
    for i in range(0, len(batch), ROWS):
        yield batch.slice(i, ROWS)


def _content(docs: DataFrame) -> DataFrame:
    return docs.select("doc", "words" if "words" in docs.columns else "lowered")


def counted(docs: DataFrame) -> DataFrame:
    """(doc, word, tf, doc_len)."""

    def run(batches):
        for chunk in _chunks(batches):
            doc, length = chunk.doc, chunk.lengths
            code, row, times = chunk.pairs(by_word=False)
            yield from _handed({"doc": doc.take(pa.array(row)), "word": chunk.distinct.take(pa.array(code)), "tf": pa.array(times), "doc_len": pa.array(length[row])})

    kind = docs.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("word", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("doc_len", T.LongType())])
    return _content(docs).mapInArrow(run, schema)


def frequencies(docs: DataFrame) -> DataFrame:
    """(word, n): in how many documents of a chunk a word is; to be summed."""

    def run(batches):
        for chunk in _chunks(batches):
            code, _, _ = chunk.pairs(by_word=True)
            yield from _handed({"word": chunk.distinct, "n": pa.array(np.bincount(code, minlength=len(chunk.distinct)))})

    return _content(docs).mapInArrow(run, "word string, n bigint")


#: Rows of postings of a word.
ENTRIES = "array<struct<doc:{},tf:int,doc_len:int>>"
#: The same as bytes, of documents that are of type bigint: Spark moves and writes a row's postings as one value.
#: The frequency is below 0 where there is no document.
POSTING = np.dtype([("doc", "<i8"), ("tf", "<i4"), ("doc_len", "<i4")])


def _lists(doc: pa.Array, row: np.ndarray, tf: np.ndarray, doc_len: np.ndarray, ends: np.ndarray, packed: bool) -> pa.Array:
    if not packed:
        each = pa.StructArray.from_arrays([doc.take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(doc_len.astype(np.int32))], ["doc", "tf", "doc_len"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each)
    each = np.empty(len(row), POSTING)
    there = doc.is_valid().to_numpy(zero_copy_only=False)[row]
    each["doc"], each["tf"], each["doc_len"] = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False)[row], np.where(there, tf, -tf), doc_len
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * POSTING.itemsize).astype(np.int32)), pa.py_buffer(each.view(np.uint8))])


def unpacked(entries: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """doc, tf and doc_len of all postings in turn, and how many of them each row has."""
    flat = np.frombuffer(b"".join(entries.to_pylist()), POSTING)
    lengths = pc.binary_length(entries).to_numpy(zero_copy_only=False) // POSTING.itemsize
    return pa.array(np.ascontiguousarray(flat["doc"]), mask=flat["tf"] < 0), np.abs(flat["tf"]), np.ascontiguousarray(flat["doc_len"]), lengths


def is_packed(lists: DataFrame) -> bool:
    return isinstance(lists.schema["entries"].dataType, T.BinaryType)


def opened(lists: DataFrame, *columns: str) -> DataFrame:
    """The ``columns`` and (doc, tf, doc_len): a row for each posting, from lists of either form."""
    if not is_packed(lists):
        return lists.select(*columns, F.inline("entries"))

    def run(batches):
        for batch in batches:
            ends, start = np.cumsum(pc.binary_length(batch.column("entries")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while start < len(ends):
                stop = max(start + 1, int(np.searchsorted(ends, BYTES + (ends[start - 1] if start else 0), "right")))
                part = batch.slice(start, stop - start)
                doc, tf, doc_len, lengths = unpacked(part.column("entries"))
                at = pa.array(np.repeat(np.arange(len(part)), lengths))
                yield from _handed({c: part.column(c).take(at) for c in columns} | {"doc": doc, "tf": pa.array(tf), "doc_len": pa.array(doc_len)})
                start = stop

    kinds = [T.StructField(c, lists.schema[c].dataType) for c in columns]
    numbers = [T.StructField("doc", T.LongType()), T.StructField("tf", T.IntegerType()), T.StructField("doc_len", T.IntegerType())]
    return lists.select(*columns, "entries").mapInArrow(run, T.StructType(kinds + numbers))


def entries(docs: DataFrame, totals: bool = False, asked: list[str] | None = None, packed: bool = False) -> DataFrame:
    """(word, part, n, occurrences, entries): a row for each word of a chunk, the ``part``, with its ``n`` postings.
    With ``totals`` a chunk has also a row without a word, with its documents and their words. Of the words
    ``asked`` only, if such are given. Entries are bytes (:data:`POSTING`) if ``packed`` and the documents are texts with whole numbers; lists of
    words keep arrays, which Spark itself opens, so that a posting can be asked for its file."""
    packed = packed and "lowered" in docs.columns and isinstance(docs.schema["doc"].dataType, T.LongType)

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        words = None if asked is None else pa.array(asked, pa.string())
        for i, chunk in enumerate(_chunks(batches)):
            if totals:
                no = np.zeros(0, np.int64)
                none = _lists(chunk.doc.slice(0, 0), no, no, no, np.zeros(2, np.int64), packed)
                yield from _handed({"word": pa.nulls(1, pa.string()), "part": [task + i], "n": [len(chunk.doc)], "occurrences": pa.array([int(chunk.lengths.sum())]), "entries": none})
            chunk = chunk if words is None else chunk.only(words)
            code, row, times = chunk.pairs(by_word=True)
            if not len(code):
                continue
            n = np.bincount(code, minlength=len(chunk.distinct))
            ends = np.concatenate([[0], np.cumsum(n)])
            total = np.add.reduceat(times, ends[:-1])  # each word is there at least once
            each = _lists(chunk.doc, row, times, chunk.lengths[row], ends, packed)
            yield from _handed({"word": chunk.distinct, "part": pa.array(np.full(len(n), task + i)), "n": pa.array(n), "occurrences": pa.array(total), "entries": each})

    kind = "binary" if packed else ENTRIES.format(docs.schema["doc"].dataType.simpleString())
    return _content(docs).mapInArrow(run, f"word string, part bigint, n bigint, occurrences bigint, entries {kind}")


def part_lists(docs: DataFrame, span: int, most: int = 4096) -> DataFrame:
    """(word, part, docs): the sorted documents of each word, from documents that are whole numbers. The texts of a
    part, ``span`` document numbers, are counted together; of a wider part, ``most`` at a time give a row."""

    def run(table: pa.Table) -> pa.Table:
        content = table.column(3).combine_chunks()
        distinct, _, codes, rows = _coded(content) if table.column_names[3] == "words" else _simple(content)
        doc, place = np.unique(table["doc"].to_numpy(), return_inverse=True)
        code, row = np.divmod(np.unique(codes * len(doc) + place[rows]), len(doc))
        ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(distinct)))])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(doc[row]))
        return pa.table({"word": distinct, "part": pa.array(np.full(len(distinct), table["part"][0].as_py())), "docs": lists})

    part = F.floor(F.col("doc") / span).cast("bigint")
    rows = docs.filter("doc IS NOT NULL").select(part.alias("part"), F.floor(F.pmod("doc", F.lit(span)) / most).cast("bigint").alias("within"), F.col("doc").cast("bigint").alias("doc"), docs.columns[1])
    return rows.groupBy("part", "within").applyInArrow(run, "word string, part bigint, docs array<bigint>")


def repeated(docs: DataFrame) -> bool:
    """Whether a document is there more than once; of the documents only their names are read."""
    return bool(docs.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect())
