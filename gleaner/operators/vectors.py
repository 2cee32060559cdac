"""Vector operators: chunks, pooling, exact nearest neighbours, re-ranking."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import DEFAULT_RESULTS, MOST_RESULTS, ChunkParams, check_results
from gleaner.functions.text import paragraphs
from gleaner.operators.search import DIGITS, top

#: Vectors of a block, and queries of a block (fewer if many results are asked for): what is compared at once.
VECTOR_BLOCK = 1024
QUERY_BLOCK = 1024
#: Results that a task keeps of a block of queries, and of all blocks.
MOST_KEPT = 1 << 20
#: Parts of a running sum.
RUN = 256


def windows(length: Column, params: ChunkParams = ChunkParams()) -> Column:
    """Token windows [s, e) of a paragraph: one if it is shorter than ``ctx``, else one from every (ctx - overlap)-th token on."""
    step = params.ctx - params.overlap
    one = F.array(F.struct(F.lit(0).alias("s"), length.cast("int").alias("e")))
    # built only where it is taken: a sequence down from 0 would be wrong
    many = F.transform(F.sequence(F.lit(0), F.greatest(length.cast("int") - 1, F.lit(0)), F.lit(step)), lambda i: F.struct(i.alias("s"), F.least(i + params.ctx, length.cast("int")).alias("e")))
    return F.when(length < params.ctx, one).otherwise(many)


def running(lengths: Column) -> Column:
    """Sums of all elements before each one. Sums of RUN elements come first, so that an element adds
    up those of its part and the sums of the parts before: no list is copied at each step."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    n_parts = F.floor(F.greatest(F.size(lengths) - 1, F.lit(0)) / RUN).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n_parts), lambda b: total(F.slice(lengths, b * RUN + 1, RUN)))
    held = F.struct(lengths.alias("l"), parts.alias("p"))
    # a list of one element, so that the sums are made once for a row
    return F.flatten(F.transform(F.array(held), lambda h: F.transform(h["l"], lambda _, i: total(F.slice(h["p"], F.lit(1), F.floor(i / RUN).cast("int"))) + total(F.slice(h["l"], (F.floor(i / RUN) * RUN + 1).cast("int"), (i % RUN).cast("int"))))))


def chunks(docs: DataFrame, params: ChunkParams = ChunkParams(), separator: str = "\n\n", pad: str | None = None, join_paragraphs: bool = False) -> DataFrame:
    """(doc, para, chunk, tokens, start, end, para_offset) from (doc, text).

    Tokens are runs without white space. ``start`` and ``end`` are the span of the chunk's tokens
    in the paragraph, in characters; with ``para_offset`` added, in the article. Chunks without a
    token are left out. With ``pad``, tokens are filled up to ``ctx``."""
    text = F.array(F.array_join(paragraphs(F.col("text"), separator), " ")) if join_paragraphs else F.split("text", _quoted(separator))
    parts = docs.select("doc", text.alias("_all")).withColumn("_at", running(F.transform("_all", lambda p: (F.length(p) + len(separator)).cast("bigint"))))
    parts = parts.select("doc", F.posexplode(F.arrays_zip(F.col("_all").alias("p"), F.col("_at").alias("at"))).alias("para", "x")).select("doc", "para", "x.p", F.col("x.at").cast("int").alias("para_offset"))
    parts = parts.filter((F.col("p") != "") & (F.col("p") != "\n"))
    # tokens with the gaps before them give the offsets
    parts = parts.withColumn("t", F.regexp_extract_all("p", F.lit(r"\S+"), F.lit(0))).withColumn("g", F.split("p", r"\S+", -1)).filter(F.size("t") > 0)
    steps = F.zip_with("t", F.slice("g", F.lit(1), F.size("t")), lambda t, g: (F.length(g) + F.length(t)).cast("bigint"))
    parts = parts.withColumn("steps", steps).withColumn("before", running(F.col("steps")))
    ends = F.zip_with(F.zip_with("before", "steps", lambda a, b: a + b), "t", lambda e, t: F.struct((e - F.length(t)).cast("int").alias("s"), e.cast("int").alias("e")))
    parts = parts.withColumn("spans", ends)
    rows = parts.select("doc", "para", "para_offset", "t", "spans", F.posexplode(windows(F.size("t"), params)).alias("chunk", "w"))
    tokens = F.slice("t", F.col("w.s") + 1, F.col("w.e") - F.col("w.s"))
    if pad is not None:
        tokens = F.concat(tokens, F.array_repeat(F.lit(pad), params.ctx - (F.col("w.e") - F.col("w.s"))))
    return rows.select("doc", "para", "chunk", tokens.alias("tokens"), F.element_at("spans", F.col("w.s") + 1)["s"].alias("start"), F.element_at("spans", F.col("w.e"))["e"].alias("end"), "para_offset")


def _quoted(separator: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in separator)


@lru_cache(maxsize=100_000)
def _token_vector(token: str, dims: int) -> np.ndarray:
    """Seeding takes most of an encoder's time, so the tokens met last are kept, a bounded number of them."""
    return np.random.default_rng(zlib.crc32(token.encode())).standard_normal(dims)


class HashingEncoder:
    """A stand-in for a neural encoder: each token is a fixed pseudo-random vector; ``pool`` takes the mean over its tokens, or over all ``size`` places with "all"."""

    def __init__(self, dims: int = 64, pool: str = "masked"):
        if pool not in ("masked", "all"):
            raise ValueError("pool is masked or all")
        self.dims, self.pool = dims, pool

    def __call__(self, batch: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(batch), self.dims))
        for i, tokens in enumerate(batch):
            real = [t for t in tokens if t]
            if real:
                out[i] = np.add.reduce([_token_vector(t, self.dims) for t in real], axis=0)
            out[i] /= max(1, len(real) if self.pool == "masked" else len(tokens))
        return out


def embed(rows: DataFrame, encoder: Callable[[list[list[str]]], np.ndarray], tokens: str = "tokens", batch_size: int = 64) -> DataFrame:
    """Rows with ``vector``; the encoder gets batches of token lists, and no component may be NaN."""

    @F.pandas_udf("array<float>")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in frames:
            lists = [list(t) if t is not None else [] for t in series]
            parts = [encoder(lists[i : i + batch_size]) for i in range(0, len(lists), batch_size)]
            made = np.concatenate(parts) if parts else np.zeros((0, 1))
            if np.isnan(made).any():
                raise ValueError("the encoder gave NaN")
            yield pd.Series(list(made.astype(np.float32)), dtype=object)

    return rows.withColumn("vector", run(F.col(tokens)))


def mean_pool(rows: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """(by, pos, mean): component-wise means of the vectors of a group, a row per component."""
    each = rows.select(*by, F.posexplode(vector).alias("pos", "x"))
    return each.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_RESULTS, id_col: str = "doc", vec_col: str = "vector", keep: DataFrame | None = None, per_query: DataFrame | None = None) -> DataFrame:
    """(qid, id, distance, rank): exact cosine distance, ascending. ``queries``: (qid, vector).

    Vectors and queries are packed into blocks, and each block of vectors meets each block of
    queries. A task keeps the k best so far of each query, so what is shuffled is bounded by tasks x
    queries x k. ``keep`` (id) restricts the vectors before the search; ``per_query`` (qid, id)
    restricts them for each query. Null vectors take no part."""
    check_results(k)
    if keep is not None:
        vectors = vectors.join(keep.select(id_col).distinct(), id_col, "left_semi")
    spark = vectors.sparkSession
    if k > MOST_RESULTS:
        return spark.createDataFrame([], f"qid {_type(queries, 'qid')}, `{id_col}` {_type(vectors, id_col)}, distance double, rank int")
    if per_query is not None:
        pairs = per_query.select("qid", id_col).distinct().join(vectors.select(id_col, F.col(vec_col).alias("_v")), id_col).join(queries.select("qid", F.col("vector").alias("_q")), "qid")
        return top(pairs.select("qid", id_col, F.round(cosine_distance(F.col("_v"), F.col("_q")), DIGITS).alias("distance")), k, "distance", id_col, ascending=True)
    blocks = packed(vectors.select(id_col, vec_col), VECTOR_BLOCK)
    asked = packed(queries.select("qid", "vector"), max(1, min(QUERY_BLOCK, MOST_KEPT // k)))
    # a query set against all rows, in blocks: a row here is a pair of blocks
    both = blocks.crossJoin(asked.select(F.col("ids").alias("qids"), F.col("data").alias("qdata")))
    return top(_compared(both, k, id_col, _type(vectors, id_col), _type(queries, "qid")), k, "distance", id_col, ascending=True)


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def packed(rows: DataFrame, size: int, key: str | None = None) -> DataFrame:
    """(key, ids, data) from (id, vector), in blocks of up to ``size`` neighbouring vectors of one
    length and one value of ``key``: their ids, and their components as unit vectors in one string of doubles."""
    id_col, vec_col = [c for c in rows.columns if c != key]
    key_column = F.col(key).cast("bigint") if key else F.lit(0).cast("bigint")
    rows = rows.filter(F.col(vec_col).isNotNull()).select(key_column.alias("key"), id_col, F.col(vec_col).cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, lists = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            sizes, flat = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            cuts = np.nonzero((np.diff(keys) != 0) | (np.diff(sizes) != 0))[0] + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                for at in range(low, high, size):
                    n = min(high, at + size) - at
                    x = flat[starts[at] : starts[at] + n * sizes[at]].reshape(n, -1)
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    some = pa.ListArray.from_arrays(pa.array([0, n], type=pa.int32()), ids.slice(at, n))
                    yield pa.RecordBatch.from_arrays([pa.array([keys[at]]), some, pa.array([x.tobytes()], type=pa.binary())], names=["key", "ids", "data"])

    return rows.mapInArrow(run, f"key bigint, ids array<{_type(rows, id_col)}>, data binary")


class _Best:
    """The k nearest so far of a block of queries."""

    def __init__(self, qids, k: int):
        self.qids, self.k, self.distance, self.names = qids, k, None, None

    def add(self, distance: np.ndarray, names: np.ndarray) -> None:
        """``distance``: (queries, vectors). The order is by distance, then by name."""
        by = np.argsort(names, kind="stable")
        # distances have DIGITS places: with the place by name they make whole numbers without ties
        key = np.rint(distance[:, by] * 10**DIGITS).astype(np.int64) * len(by) + np.arange(len(by))
        n = min(self.k, len(by))
        pick = np.sort(np.partition(key, n - 1, axis=1)[:, :n], axis=1)
        near, who = pick // len(by), names[by][pick % len(by)]
        if self.distance is not None:
            near, who = np.concatenate([self.distance, near], axis=1), np.concatenate([self.names, who], axis=1)
            order = np.lexsort((who, near), axis=-1)[:, : self.k]
            near, who = np.take_along_axis(near, order, axis=1), np.take_along_axis(who, order, axis=1)
        self.distance, self.names = near, who

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        n = self.distance.shape[1]
        qids = self.qids.take(pa.array(np.repeat(np.arange(len(self.qids)), n)))
        return pa.RecordBatch.from_arrays([qids.cast(schema[0].type), pa.array(self.names.ravel()).cast(schema[1].type), pa.array(np.round(self.distance.ravel() / 10**DIGITS, DIGITS))], schema=schema)


def _compared(both: DataFrame, k: int, id_col: str, id_type: str, qid_type: str) -> DataFrame:
    """The best of each pair of blocks (ids, data, qids, qdata), merged within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, _Best] = {}
        schema = None
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            schema = schema or pa.schema([("qid", columns["qids"].type.value_type), (id_col, columns["ids"].type.value_type), ("distance", pa.float64())])
            for i in range(batch.num_rows):
                names, qids, qdata = columns["ids"][i].values, columns["qids"][i].values, columns["qdata"][i].as_py()
                x = np.frombuffer(columns["data"][i].as_py()).reshape(len(names), -1)
                q = np.frombuffer(qdata).reshape(len(qids), -1)
                if x.shape[1] != q.shape[1]:
                    continue
                at = (qdata, *qids.to_pylist())
                if at not in best and (len(best) + 1) * len(qids) * k > MOST_KEPT:
                    yield from (b.rows(schema) for b in best.values())
                    best = {}
                found = names.to_numpy(zero_copy_only=False)
                best.setdefault(at, _Best(qids, k)).add(np.round(1 - q @ x.T, DIGITS), found.astype(str) if found.dtype == object else found)
        yield from (b.rows(schema) for b in best.values())

    return both.select("ids", "data", "qids", "qdata").mapInArrow(run, f"qid {qid_type}, `{id_col}` {id_type}, distance double")


def build_cells(vectors: DataFrame, path: str, cells: int, id_col: str = "doc", vec_col: str = "vector", sample: int = 20_000, rounds: int = 10, seed: int = 7) -> None:
    """Write an approximate index: ``centres`` (cell, vector) of a k-means on a bounded sample, and
    ``vectors`` (id, vector), all of them, in a folder for each cell of their nearest centre."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(vec_col).isNotNull())
    picked = rows.select(vec_col).orderBy(F.xxhash64(F.lit(seed), F.col(id_col))).limit(sample).collect()  # bounded by ``sample``
    x = np.array([r[0] for r in picked], dtype=np.float64)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if len(x) else np.zeros((1, 1))
    centres = x[: max(1, min(cells, len(x)))].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(centres)], "cell bigint, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    placed = rows.select(id_col, vec_col, _cells(centres, 1)(F.col(vec_col))[0].alias("cell"))
    placed.repartitionByRange("cell", id_col).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")


def _cells(centres: np.ndarray, n: int):
    """A function of a vector column that gives the ``n`` cells of the nearest centres, nearest first."""

    @F.pandas_udf("array<bigint>")
    def near(vectors: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(vectors), 4096):
            x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors[at : at + 4096]])
            out += list(np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n])
        return pd.Series(out, dtype=object)

    return near


def nearest_in_cells(spark: SparkSession, path: str, queries: DataFrame, k: int = DEFAULT_RESULTS, probes: int = 8, id_col: str = "doc", vec_col: str = "vector") -> DataFrame:
    """The search of :func:`nearest` in the ``probes`` cells next to each query; exact if these are all cells. Only the folders of these cells are read."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # a row per cell
    asked = queries.filter(F.col("vector").isNotNull()).select("qid", "vector", F.explode(_cells(np.array([r.vector for r in centres]), check_results(probes))(F.col("vector"))).alias("cell"))
    vectors = spark.read.parquet(f"{path}/vectors")
    wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # no more than there are cells
    blocks = packed(vectors.filter(F.col("cell").isin(wanted)).select("cell", id_col, vec_col), VECTOR_BLOCK, "cell")
    asked = packed(asked.repartition("cell").sortWithinPartitions("cell").select("cell", "qid", "vector"), max(1, min(QUERY_BLOCK, MOST_KEPT // k)), "cell")
    both = blocks.join(asked.select("key", F.col("ids").alias("qids"), F.col("data").alias("qdata")), "key")
    return top(_compared(both, k, id_col, _type(vectors, id_col), _type(queries, "qid")), k, "distance", id_col, ascending=True)


def cosine_distance(a: Column, b: Column) -> Column:
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y)

    def dot(x: Column, y: Column) -> Column:
        return total(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")))

    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rerank(stage1: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = DEFAULT_RESULTS, id_col: str = "doc", vec_col: str = "vector") -> DataFrame:
    """Second stage: vectors of each query's first-stage documents by cosine distance. The unit is
    a vector, so a document with several may come several times; see :func:`best_per_doc`."""
    return nearest(vectors, query_vectors, k, id_col, vec_col, per_query=stage1.select("qid", F.col("doc").alias(id_col)))


def best_per_doc(results: DataFrame, doc: str = "doc") -> DataFrame:
    return results.groupBy("qid", doc).agg(F.min("distance").alias("distance"))
