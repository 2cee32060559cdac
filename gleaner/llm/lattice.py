"""Operator 8: language-model scoring by subword lattices.

The vocabulary is that of a public piece file. Its scores, which are ranks, give a first unigram
distribution (rank to the power -1); rounds of expectation over the training texts' words, with
that distribution as prior, weight the pieces. A text's probability is the marginal over all
segmentations of all its words, by a forward recursion in log space, times that of the end piece.
Pieces don't cross words, so a word's marginal is computed once, wherever it stands.

Flow. One pass over the texts cuts them into bounded chunks and writes, for each chunk, a row per
word (its number in the chunk, its count in training texts) and one row with all postings (document
in the chunk, count) by word number. Word counts are summed, the pieces' expectations are summed to
one row per piece (bounded by the vocabulary, the only thing that comes to the driver), and the
words' values go back to the chunks by a join of the word rows; a frequent word has one narrow row
per chunk there. A chunk's postings then meet its values in one task, sorted by chunk, so that a
task holds one chunk at a time. Texts are never shuffled.

Cases. Null and empty texts are the end token alone. A null id counts as training. Rows with one
id are texts of their own. Texts and words of any length are scored whole: pieces of a word are
looked up for a bounded number of places at a time, and beside them a word takes a few numbers for
each of its characters. Extra columns, also clashing ones, are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import FLUSH_BYTES, Rows, bounded_batches, documents, materialize, release, tidy

VOCABULARY = "piece_bpe_32k.model"
#: Weight of the first distribution, in tokens, against the training texts' expectations.
PRIOR = 2000.0
#: Rounds of expectation.
ROUNDS = 2
#: A chunk ends at so many tokens, or documents.
CHUNK_TOKENS = 2_000_000
CHUNK_DOCS = 65_000
#: Characters of words that are taken together; places (of a character and a piece length) that are looked up together.
PART_CHARS = 1 << 14
PART_PLACES = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
SPACE = "▁"


class Lattice:
    """Pieces by hash, their log probabilities, and the recursions over words of one length."""

    def __init__(self, pieces: list[str], byte_piece: np.ndarray, end: int, logs: np.ndarray):
        """``byte_piece``: the piece of each byte, for characters that are no piece; ``end``: the end piece."""
        self.pieces, self.byte_piece, self.end, self.logs = pieces, byte_piece, end, logs
        special = {end, *byte_piece.tolist()}
        usable = [i for i, p in enumerate(pieces) if p and i not in special and logs[i] > -1e30]
        hashes = np.array([self._hash(pieces[i]) for i in usable], dtype=np.uint64)
        by = np.argsort(hashes)
        self.hashes, self.ids = hashes[by], np.array(usable, dtype=np.int64)[by]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self._spot(self.hashes)] = True
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        self.powers = np.ones(self.longest + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.longest):
                self.powers[i + 1] = self.powers[i] * BASE

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    @staticmethod
    def _spot(hashes: np.ndarray) -> np.ndarray:
        """Where a hash is marked in ``maybe``; most of what is no piece isn't."""
        with np.errstate(over="ignore"):
            return (hashes * MIX) >> np.uint64(44)

    def _prefix(self, codes: np.ndarray) -> np.ndarray:
        n, size = codes.shape
        with np.errstate(over="ignore"):
            prefix = np.zeros((n, size + 1), dtype=np.uint64)
            for j in range(size):
                prefix[:, j + 1] = prefix[:, j] * BASE + codes[:, j] + np.uint64(1)
        return prefix

    def _edges(self, codes: np.ndarray, prefix: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, ends low + 1 ... high, lengths 1 ... span): piece ids (-1: none) and log weights."""
        span = min(self.longest, codes.shape[1])
        ends = np.arange(low + 1, high + 1)
        starts = ends[:, None] - np.arange(1, span + 1)
        with np.errstate(over="ignore"):
            key = prefix[:, ends][:, :, None] - prefix[:, np.maximum(starts, 0)] * self.powers[1 : span + 1]
        some = np.flatnonzero(self.maybe[self._spot(key)] & (starts >= 0))
        these = key.ravel()[some]
        at = np.minimum(np.searchsorted(self.hashes, these), len(self.hashes) - 1)
        hit = self.hashes[at] == these
        some, at = some[hit], self.ids[at[hit]]
        ids, weight = np.full(key.shape, -1, dtype=np.int32), np.full(key.shape, -np.inf)
        ids.ravel()[some], weight.ravel()[some] = at, self.logs[at]
        lone = ids[:, :, 0] < 0
        if lone.any():
            chars, which = np.unique(codes[:, low:high][lone], return_inverse=True)
            weight[lone, 0] = np.array([self.logs[self.byte_piece[list(self._bytes(c))]].sum() for c in chars])[which]
        return ids, weight

    @staticmethod
    def _bytes(code: int) -> bytes:
        return chr(int(code)).encode("utf-8", "surrogatepass")

    def _parts(self, n: int, size: int) -> list[tuple[int, int]]:
        """Ranges of ends that are looked up together."""
        step = max(1, PART_PLACES // (n * min(self.longest, size)))
        return [(low, min(size, low + step)) for low in range(0, size, step)]

    def _alphas(self, codes: np.ndarray, prefix: np.ndarray, parts: list[tuple[int, int]]):
        """Log probabilities of the beginnings of each word, after as many columns of padding as a piece is long, and the last part's edges."""
        n, size = codes.shape
        span = min(self.longest, size)
        a = np.full((n, span + size + 1), -np.inf)
        a[:, span] = 0
        edges = None
        for low, high in parts:
            edges = self._edges(codes, prefix, low, high)
            for j in range(low, high):
                into = a[:, j + 1 : j + 1 + span][:, ::-1] + edges[1][:, j - low]
                most = into.max(axis=1)  # finite: a character has at least the pieces of its bytes
                a[:, span + j + 1] = most + np.log(np.exp(into - most[:, None]).sum(axis=1))
        return a, edges

    def forward(self, codes: np.ndarray) -> np.ndarray:
        """Log marginals of words of one length (rows of code points)."""
        return self._alphas(codes, self._prefix(codes), self._parts(*codes.shape))[0][:, -1]

    def expect(self, codes: np.ndarray, times: np.ndarray, into: np.ndarray) -> None:
        """Adds the pieces' expected counts over words that stand ``times`` times each."""
        n, size = codes.shape
        span, prefix, parts = min(self.longest, size), self._prefix(codes), self._parts(n, size)
        a, edges = self._alphas(codes, prefix, parts)
        b = np.full((n, span + size + 1), -np.inf)
        b[:, -1] = 0
        for low, high in reversed(parts):
            ids, weight = edges if edges is not None else self._edges(codes, prefix, low, high)
            edges, share = None, np.zeros(weight.shape)
            for j in range(high - 1, low - 1, -1):
                through = weight[:, j - low] + b[:, span + j + 1, None]
                before = slice(j + 1, j + 1 + span)
                b[:, before] = np.logaddexp(b[:, before], through[:, ::-1])
                share[:, j - low] = np.exp(a[:, before][:, ::-1] + through - a[:, -1:]) * times[:, None]
            known = ids >= 0
            into += np.bincount(ids[known], share[known], minlength=len(into))
            lone = ~known[:, :, 0]
            if lone.any():
                chars, which = np.unique(codes[:, low:high][lone], return_inverse=True)
                for char, shares in zip(chars, np.bincount(which, share[lone, 0])):
                    for byte in self._bytes(char):
                        into[self.byte_piece[byte]] += shares

    def words(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, code points) of words of one length at a time, with the space piece's sign in front."""
        texts = [SPACE + w.decode("utf-8", "replace") for w in words]
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(sizes, kind="stable")
        cuts = np.nonzero(np.diff(sizes[order]))[0] + 1
        for group in np.split(order, cuts):
            step = max(1, min(4096, PART_CHARS // max(1, sizes[group[0]]))) if len(group) else 1
            for at in range(0, len(group), step):
                part = group[at : at + step]
                joined = "".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass")
                yield part, np.frombuffer(joined, dtype="<u4").reshape(len(part), -1).astype(np.uint64)


def load(path: str | None = None) -> Lattice:
    """Pieces of a sentencepiece file, weighted by rank: the least negative score is the likeliest piece."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte_piece = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    score = np.array([sp.get_score(i) for i in range(n)])
    weight = 1.0 / (np.maximum(0.0, -score) + 10.0)
    for i in range(n):
        if sp.is_control(i) or sp.is_unknown(i):
            weight[i] = 0.0
    weight[byte_piece] = weight[weight > 0].min()
    end = sp.eos_id()
    weight[end] = weight.max()
    with np.errstate(divide="ignore"):
        return Lattice(pieces, byte_piece, end, np.maximum(np.log(weight / weight.sum()), -1e300))


def held_out(key: F.Column) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _postings(docs: DataFrame, id_col: str, text_col: str, held: F.Column) -> DataFrame:
    """Word rows (chunk, word, c: times in training texts, k: number in the chunk), one row of
    postings for each chunk (post, ends: where each word's end) and document rows (chunk, at, id, held, n)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, schema = TaskContext.get().partitionId(), 0, None
        ids, tokens, owners, training, n_tokens = _Ids(), [], [], [], 0

        def made(n: int, **columns) -> pa.RecordBatch:
            tag = pa.array(np.full(n, part << 24 | chunk))
            return pa.RecordBatch.from_arrays([tag, *[columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in list(schema)[1:]]], schema=schema)

        def flush():
            word = np.concatenate(tokens)
            doc = np.repeat(np.arange(len(owners)), owners)
            key, times = np.unique(word.astype(np.int64) << 16 | doc, return_counts=True)
            while (over := times > 65535).any():  # a posting holds 16 bits of count
                key, times = np.concatenate([key, key[over]]), np.concatenate([np.minimum(times, 65535), times[over] - 65535])
                by = np.argsort(key, kind="stable")
                key, times = key[by], times[by]
            of = key >> 16
            counted = np.bincount(of, times * np.array(training, dtype=np.int64)[key & 65535], minlength=len(ids)).astype(np.int64)
            post = ((key & 65535) << 16 | times).astype("<u4")
            ends = np.searchsorted(of, np.arange(1, len(ids) + 1)).astype("<u4")
            yield made(1, post=pa.array([post.tobytes()]), ends=pa.array([ends.tobytes()]))
            words = list(ids)
            size = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 20)
            low = 0
            while low < len(words):
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + FLUSH_BYTES)))
                yield made(min(high, len(words)) - low, word=pa.array(words[low:high], type=pa.binary()), c=pa.array(counted[low:high]), k=pa.array(np.arange(low, min(high, len(words)))))
                low = high

        for batch in batches:
            whole = [("chunk", pa.int64()), ("word", pa.binary()), ("c", pa.int64()), ("k", pa.int32()), ("post", pa.binary()), ("ends", pa.binary())]
            schema = pa.schema([*whole, ("at", pa.int32()), ("id", batch.schema.field(0).type), ("held", pa.bool_()), ("n", pa.int64())])
            rows = Rows(schema)
            for key, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                rows.add((part << 24 | chunk, None, None, None, None, None, len(owners), key, out, len(words) + 1))
                tokens.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words)))
                owners.append(len(words))
                training.append(0 if out else 1)
                n_tokens += len(words)
                if n_tokens >= CHUNK_TOKENS or len(owners) >= CHUNK_DOCS:
                    yield from flush()
                    chunk += 1
                    ids, tokens, owners, training, n_tokens = _Ids(), [], [], [], 0
            yield from rows.take()
        if owners:
            yield from flush()

    shape = f"chunk bigint, word binary, c bigint, k int, post binary, ends binary, at int, id {id_type}, held boolean, n bigint"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), held.alias("_held")).mapInArrow(tidy(run), shape)


def fit(counts: DataFrame, n_train: int, start: Lattice, prior: float = PRIOR, rounds: int = ROUNDS) -> Lattice:
    """Rounds of expectation over ``counts`` (word, c), all of them, with the start as prior."""
    model = start
    for _ in range(rounds):
        model = _round(counts, n_train, model, prior * np.exp(start.logs))
    return model


def _round(counts: DataFrame, n_train: int, start: Lattice, prior: np.ndarray) -> Lattice:
    shared = counts.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, into = shared.value, None
        for batch in batches:
            if into is None:
                into = np.zeros(len(lattice.pieces))
            times = batch.column(1).to_numpy().astype(float)
            for part, codes in lattice.words(batch.column(0).to_pylist()):
                lattice.expect(codes, times[part], into)
        if into is not None:
            some = np.nonzero(into)[0]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(into[some])], names=["piece", "times"])

    rows = counts.select("word", "c").filter("c > 0").mapInArrow(tidy(run), "piece bigint, times double").groupBy("piece").agg(F.sum("times").alias("times"))
    expected = np.zeros(len(start.pieces))
    for piece, times in rows.collect():  # a row per piece of the vocabulary at most
        expected[piece] = times
    expected[start.end] = n_train
    weight = expected + prior
    with np.errstate(divide="ignore"):
        return Lattice(start.pieces, start.byte_piece, start.end, np.maximum(np.log(weight / weight.sum()), -1e300))


def score_words(counts: DataFrame, model: Lattice) -> DataFrame:
    """(word, c) with ``lp``: the log10 of the word's marginal."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for part, codes in shared.value.words(batch.column(0).to_pylist()):
                out[part] = shared.value.forward(codes) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["word", "c", "lp"])

    return counts.select("word", "c").mapInArrow(tidy(run), "word binary, c bigint, lp double")


def _sums(rows: DataFrame, size: float) -> DataFrame:
    """Sums for each document of a chunk from the rows (chunk, k, c, lp) of its words and the row
    (chunk, post, ends) of its postings; a chunk's rows follow each other, in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, values, blob = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if blob is None:
                return
            post, ends = np.frombuffer(blob[0], dtype="<u4"), np.frombuffer(blob[1], dtype="<u4").astype(np.int64)
            each = np.zeros((3, len(ends)))
            for k, c, lp in values:
                each[:, k] = np.log10((c + 1) / size), lp, c > 0
            doc, times = (post >> 16).astype(np.int64), (post & 65535).astype(float)
            word = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            sums = [np.bincount(doc, v[word] * times) for v in each]
            n = len(sums[0])
            arrays = [pa.array(np.full(n, tag)), pa.array(np.arange(n, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1]), pa.array(np.rint(sums[2]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "at", "base", "score", "known"])

        for batch in batches:
            chunk = batch.column(0).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(chunk))[0] + 1).tolist(), len(chunk)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if chunk[low] != tag:
                    yield from done()
                    tag, values, blob = int(chunk[low]), [], None
                part = batch.slice(low, high - low)
                is_word = part.column(1).is_valid()
                some = part.filter(is_word)
                values.append([some.column(i).to_numpy() for i in (1, 2, 3)])
                if some.num_rows < part.num_rows:
                    row = part.filter(pc.invert(is_word))
                    blob = row.column(4)[0].as_py(), row.column(5)[0].as_py()
        yield from done()

    return rows.select("chunk", "k", "c", "lp", "post", "ends").mapInArrow(tidy(run), "chunk bigint, at int, base double, score double, known bigint")


def score_documents(docs: DataFrame, start: Lattice, held: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its scores; the model learns from the rows that ``held`` isn't true for."""
    bounded_batches(docs.sparkSession)
    held = held_out(F.col(id_col)) if held is None else held
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = materialize(_postings(docs, id_col, text_col, held), "lm-rows")
    words = rows.filter("word IS NOT NULL").select("chunk", "word", "c", "k")
    owners = rows.filter("at IS NOT NULL").select("chunk", "at", "id", "held", "n")
    posts = rows.filter("post IS NOT NULL").select("chunk", "post", "ends")
    counts = materialize(words.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    n_words, n_known = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("bigint")), F.lit(0))).first()
    n_train, n_chunks = owners.agg(F.coalesce(F.sum((~F.col("held")).cast("bigint")), F.lit(0)), F.countDistinct("chunk")).first()
    total, distinct = n_words + n_train, n_known + (1 if n_train else 0)
    model = fit(counts, n_train, start)
    valued = materialize(score_words(counts, model), "lm-valued")
    size = float(total + distinct + 1)
    joined = words.select("chunk", "word", "k").join(valued, "word").select("chunk", "k", "c", "lp").unionByName(posts, allowMissingColumns=True)
    # about a chunk for each task, however many there are
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_chunks)
    sums = _sums(joined.repartition(parts, "chunk").sortWithinPartitions("chunk"), size)
    end_base, end_score = float(np.log10((n_train + 1) / size)), float(model.logs[model.end] / np.log(10))
    sums = materialize(sums, "lm-sums")
    for done in (counts, valued):
        release(done)
    out = owners.join(sums, ["chunk", "at"], "left")
    return out.select(
        F.col("id").cast(id_type).alias(id_col),
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.coalesce("known", F.lit(0)) + (1 if n_train else 0)).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.coalesce("base", F.lit(0.0)) + end_base).alias("base_score"),
        (F.coalesce("score", F.lit(0.0)) + end_score).alias("score"),
    )


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), load())


QUERIES = {"op8_lattice_lm": op8_lattice_lm}
SQL: dict[str, str] = {}
