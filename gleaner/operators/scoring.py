"""Scores of queries in one part of the documents at a time, in Arrow: a table of pairs of query and
document is neither aggregated nor shuffled; only a part's best rows of each query leave it.

Lists are (word, part, idf, entries, asks): the postings of a word in a part, and who asks for the word
with what weight. All postings of a document are in one part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.config import BM25Params
from gleaner.operators import counting as C

#: Cells of queries and documents that are summed at a time.
CELLS = 4_000_000


class Part:
    """The lists of a part as arrays: a slice of ``rows`` (into ``docs``, the sorted documents) for each list."""

    def __init__(self, table: pa.Table):
        if pa.types.is_binary(table.schema.field("entries").type):
            doc, tf, doc_len, self.lengths = C.unpacked(table["entries"])
        else:
            entries = table["entries"].combine_chunks()
            doc, tf, doc_len = (entries.flatten().field(c) for c in ("doc", "tf", "doc_len"))
            self.lengths = pc.list_value_length(entries).to_numpy(zero_copy_only=False)
        coded = doc.dictionary_encode(null_encoding="encode")
        order = pc.array_sort_indices(coded.dictionary, null_placement="at_start")  # as Spark sorts
        self.docs = coded.dictionary.take(order)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        self.rows = place[coded.indices.to_numpy(zero_copy_only=False)]
        self.tf, self.doc_len = np.asarray(tf, float), np.asarray(doc_len, float)
        self.ends = np.cumsum(self.lengths)
        self.idf = np.repeat(table["idf"].to_numpy().astype(float), self.lengths) if "idf" in table.schema.names else None
        asks = table["asks"].combine_chunks()
        each = asks.flatten()
        asked = each.field("qid").dictionary_encode(null_encoding="encode")
        self.qids, qid = asked.dictionary, asked.indices.to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(asks)), pc.list_value_length(asks).to_numpy(zero_copy_only=False))
        order = np.argsort(qid, kind="stable")
        self.qid, self.list, self.weight = qid[order], of[order], each.field("weight").to_numpy(zero_copy_only=False).astype(float)[order]

    def sums(self, *values: tuple[np.ndarray, bool]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """For blocks of queries, from the first of them on: the sums of each of ``values`` (of the postings; and
        whether times the weight of who asks), and which documents have a word of the query."""
        block = max(1, CELLS // max(1, len(self.docs)))
        for low in range(0, len(self.qids), block):
            high = min(low + block, len(self.qids))
            out = [np.zeros((high - low, len(self.docs))) for _ in values]
            seen = np.zeros((high - low, len(self.docs)), bool)
            for i in range(*np.searchsorted(self.qid, [low, high])):
                at, q = self.list[i], self.qid[i] - low
                span = slice(self.ends[at] - self.lengths[at], self.ends[at])
                rows = self.rows[span]  # a document is there once: plain addition
                seen[q, rows] = True
                for total, (value, times) in zip(out, values):
                    total[q, rows] += value[span] * self.weight[i] if times else value[span]
            yield low, out, seen


def _each_part(lists: DataFrame, columns: str, run: Callable[[pa.Table], pa.Table]) -> DataFrame:
    kind = {"doc": T.LongType() if C.is_packed(lists) else lists.schema["entries"].dataType.elementType["doc"].dataType, "qid": lists.schema["asks"].dataType.elementType["qid"].dataType}
    schema = T.StructType([T.StructField(c, kind.get(c, T.DoubleType())) for c in columns.split()])
    return lists.select("part", *(["idf"] if "idf" in lists.columns else []), "entries", "asks").groupBy("part").applyInArrow(run, schema)


def _best(part: Part, low: int, score: np.ndarray, seen: np.ndarray, k: int) -> tuple[list, list, list]:
    """The ``k`` best documents of each query of a block; scores that are no number come last, ties by document."""
    qids, rows, scores = [], [], []
    for q in range(len(score)):
        at = np.flatnonzero(seen[q])
        value = np.where(np.isnan(score[q, at]), -np.inf, score[q, at])
        if len(at) > k:
            bound = np.partition(value, len(value) - k)[len(value) - k]
            at, value = at[value >= bound], value[value >= bound]
        first = np.argsort(-value, kind="stable")[:k]  # documents are sorted
        qids.append(np.full(len(first), low + q)), rows.append(at[first]), scores.append(value[first])
    return qids, rows, scores


def _table(part: Part, found: list[tuple[list, list, list]]) -> pa.Table:
    joined = [np.concatenate([np.zeros(0, np.int64), *(x for lists in f for x in lists)]) for f in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    qid, doc, *score = joined
    columns = {"qid": part.qids.take(pa.array(qid.astype(np.int64))), "doc": part.docs.take(pa.array(doc.astype(np.int64)))}
    if score:
        value = score[0].astype(float)
        columns["score"] = pa.array(value, mask=np.isneginf(value))
    return pa.table(columns)


def summed(lists: DataFrame, k: int, digits: int, params: BM25Params, avg_doc_len: float) -> DataFrame:
    """(qid, doc, score): each part's ``k`` best documents of a query by the sum of BM25."""
    k1, b = params.k1, params.b

    def run(table: pa.Table) -> pa.Table:
        part, found = Part(table), []
        weight = part.idf * part.tf * (k1 + 1) / (part.tf + k1 * (1 - b + b * part.doc_len / avg_doc_len))
        for low, (score,), seen in part.sums((weight, False)):
            found.append(_best(part, low, np.round(score, digits), seen, k))
        return _table(part, found)

    return _each_part(lists, "qid doc score", run)


def cosines(lists: DataFrame, k: int, digits: int) -> DataFrame:
    """(qid, doc, score): each part's ``k`` best documents of a query by the cosine; weights are those of the
    query's words over its norm, null where that is 0."""

    def run(table: pa.Table) -> pa.Table:
        part, found = Part(table), []
        weight = part.tf * part.idf
        for low, (dot, square), seen in part.sums((weight, True), (weight * weight, False)):
            with np.errstate(invalid="ignore", divide="ignore"):
                found.append(_best(part, low, np.round(dot / np.sqrt(square), digits), seen, k))
        return _table(part, found)

    return _each_part(lists, "qid doc score", run)


def asked_for(lists: DataFrame) -> DataFrame:
    """(qid, doc): documents with a word of a query."""

    def run(table: pa.Table) -> pa.Table:
        part, found = Part(table), []
        for low, _, seen in part.sums():
            q, row = np.nonzero(seen)
            found.append(([low + q], [row]))
        return _table(part, found)

    return _each_part(lists, "qid doc", run)
