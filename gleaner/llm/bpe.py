"""Operator 4: byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash (hash, displace, compare) resolves every pre-token that is a
vocabulary entry as it stands; a pre-token that it misses is merged with a heap of ranked pairs
over doubly linked bytes. The vocabulary (bounded: one rank file) is read on the driver, where the
hash is built, and both are sent to the workers; no tokenizer is trained. Pieces met lately are kept,
so that both tiers are asked once for them, until the task ends.

Cases. Null text counts as empty: no ids, empty bytes. Repeated rows and null ids give a row each.
Texts of any length are encoded whole, a bounded number of pre-tokens at a time. Ties: of pairs of
equal rank the leftmost is joined first. Extra columns, also clashing ones, are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Rows, bounded_batches, documents, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _slot(low: int, shift: int, size: int) -> int:
    x = (low + shift * _ODD) & _MASK
    x ^= x >> 32
    return (x * 0xD6E8FEB86659FD93 & _MASK) % size


class MinimalPerfectHash:
    """n keys in n slots: keys are hashed to buckets, and each bucket, largest first, gets the
    first displacement that puts all its keys on free slots. A bucket of one key names its slot."""

    def __init__(self, keys: Iterable[bytes], shift: list[int] | None = None):
        """With ``shift``, the displacements, ``keys`` are in the order of their slots already."""
        keys = list(keys)
        self.size, self.n_buckets = len(keys), len(keys) // 3 + 1
        if shift is not None:
            self.shift, self.keys = shift, keys
            return
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(self.n_buckets)]
        for key in keys:
            high, low = divmod(xxhash.xxh3_128_intdigest(key), 1 << 64)
            buckets[high % self.n_buckets].append((low, key))
        self.shift = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * self.size
        free = iter(range(self.size))
        for b in sorted(range(self.n_buckets), key=lambda i: -len(buckets[i])):
            rows = buckets[b]
            if len(rows) > 1:
                shift = 0
                while True:
                    slots = [_slot(low, shift, self.size) for low, _ in rows]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                    shift += 1
                self.shift[b] = shift
            elif rows:
                slots = [next(s for s in free if self.keys[s] is None)]
                self.shift[b] = -1 - slots[0]
            else:
                continue
            for slot, (_, key) in zip(slots, rows):
                self.keys[slot] = key

    def find(self, key: bytes) -> int:
        """The key's slot, or -1 for what isn't a key."""
        if not self.size:
            return -1
        high, low = divmod(xxhash.xxh3_128_intdigest(key), 1 << 64)
        shift = self.shift[high % self.n_buckets]
        slot = -1 - shift if shift < 0 else _slot(low, shift, self.size)
        return slot if self.keys[slot] == key else -1


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, shift: list[int] | None = None):
        """``shift``: the displacements of the hash, if ``ranks`` are in the order of its slots already."""
        self.ranks, self.pattern = ranks, pattern
        self.whole = MinimalPerfectHash(ranks, shift)
        self.slot_rank = [ranks[k] for k in self.whole.keys]
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token

    def tables(self) -> dict:
        """What makes this object again without building the hash."""
        return {"ranks": {k: self.ranks[k] for k in self.whole.keys}, "pattern": self.pattern, "shift": self.whole.shift}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no vocabulary entry: the pair of lowest rank, leftmost first, is
        joined until none is left. Stale heap entries are known by the end that they noted."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or mid >= j or end[mid] != j:
                continue
            end[i], end[mid] = j, 0
            if j < n:
                before[j] = i
                if (r := ranks.get(piece[i : end[j]])) is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:j])) is not None:
                heapq.heappush(heap, (r, h, j))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token as little-endian unsigned 32-bit integers."""
        raw = text.encode("utf-8", "surrogatepass")
        slot = self.whole.find(raw)
        return np.array([self.slot_rank[slot]] if slot >= 0 else self.merge(raw), dtype="<u4").tobytes()


class _Memo(dict):
    """Pieces met lately; bounded, since it is emptied when full."""

    def __init__(self, bpe: ByteBPE, most: int = 300_000, longest: int = 48):
        self.bpe, self.most, self.longest = bpe, most, longest

    def __missing__(self, text: str) -> bytes:
        ids = self.bpe.piece(text)
        if len(text) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[text] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts with bounded extra memory."""

    BLOCK = 1 << 20

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.compiled, self.memo = bpe, regex.compile(bpe.pattern), _Memo(bpe)

    @staticmethod
    def of(tables: dict) -> Codec:
        """The codec of a worker process: broadcast tables stay there from task to task, and with them the codec. The pieces that it met go with the task."""
        if "codec" not in tables:
            tables["codec"] = Codec(ByteBPE(**tables))
        tables["codec"].memo.clear()
        return tables["codec"]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) <= self.BLOCK:
            return b"".join(map(self.memo.__getitem__, self.compiled.findall(text)))
        found, out = (m[0] for m in self.compiled.finditer(text)), bytearray()
        while block := list(itertools.islice(found, 65536)):
            out += b"".join(map(self.memo.__getitem__, block))
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        get, out = self.bpe.vocabulary.__getitem__, bytearray()
        for at in range(0, len(ids), 4 * self.BLOCK):
            out += b"".join(map(get, np.frombuffer(ids[at : at + 4 * self.BLOCK], dtype="<u4").tolist()))
        return bytes(out)


def load(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """The codec's tables from a rank file; the defaults are the public multilingual file and its pattern."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    return ByteBPE(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, bpe: ByteBPE, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit
    integers, packed) and, if asked for, ``decoded``: the bytes that these ids stand for."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(bpe.tables())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec.of(shared.value)
            schema = pa.schema([(id_col, batch.schema.field(0).type), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())][: 4 if decode else 3])
            rows, keys, texts = Rows(schema), batch.column(0).to_pylist(), batch.column(1)
            for key, text in zip(keys, texts):
                ids = codec.encode(text.as_py())
                got = (codec.decode(ids),) if decode else ()
                rows.add((key, len(ids) // 4, ids, *got), len(ids) + sum(map(len, got)) + 16)
                if rows.full():
                    yield from rows.take()
            yield from rows.take()
        if codec:
            codec.memo.clear()

    shape = f"`{id_col}` {id_type.simpleString()}, n_tokens bigint, ids binary" + ", decoded binary" * decode
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col if text_col != id_col else "_text")).mapInArrow(tidy(run), shape)


def decode_documents(encoded: DataFrame, bpe: ByteBPE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that packed ids stand for, one row per input row; null ids decode to no bytes."""
    bounded_batches(encoded.sparkSession)
    id_type = encoded.schema[id_col].dataType
    shared = encoded.sparkSession.sparkContext.broadcast(bpe.tables())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec.of(shared.value)
            rows = Rows(pa.schema([(id_col, batch.schema.field(0).type), ("decoded", pa.binary())]))
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = codec.decode(ids.as_py() or b"")
                rows.add((key, raw), len(raw) + 16)
                if rows.full():
                    yield from rows.take()
            yield from rows.take()
        if codec:
            codec.memo.clear()

    return encoded.select(id_col, ids_col).mapInArrow(tidy(run), f"`{id_col}` {id_type.simpleString()}, decoded binary")


def digests(docs: DataFrame, bpe: ByteBPE) -> DataFrame:
    both = encode_documents(docs, bpe)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), load())


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
SQL: dict[str, str] = {}
