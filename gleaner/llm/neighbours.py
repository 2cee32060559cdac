"""Operator 9: approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1. Each table hashes them by a few Gaussian (2-stable) projections cut
into cells. A query visits cells in the order of their estimated chance to hold a neighbour, taking
the projected difference to a neighbour as normal with the neighbours' usual distance, until the
chances sum to ``reach``; candidates of all tables are ranked by exact cosine in double precision
on the original vectors.

Every row is indexed, by the same method at every size. Only the usual distance is fitted on a
sample: that of at most ``MOST_SAMPLE`` rows to their neighbours among all rows. A query that finds fewer neighbours than asked for searches on,
all but everywhere.

Scale. Equal vectors are one entry with its smallest ids (more can't be among the nearest). Queries
of one home cell go together, in parts of bounded size; a cell's vectors go to those parts only of
which a query visits the cell. Cells are cut into blocks of bounded size, hot cells into many; a
task compares one block of vectors with one part of the queries. The number of projections grows
with the logarithm of the rows.

Cases. Vectors that are null, empty, zero or hold null or non-finite components, and null ids, take
no part. Vectors of other lengths are compared among themselves. A query's own id is no candidate,
also where it is repeated; other rows with one id count as one if they are equal. Ties go to the
smaller id. Extra columns, also clashing ones, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import FLUSH_BYTES, materialize, release, table, tidy
from gleaner.llm.graph import salted_join

TABLES = 3
REACH = 0.65
WIDTH = 2.0
CELL_ROWS = 60
MOST_SAMPLE = 200
BLOCK_VECTORS = 1024
BLOCK_QUERIES = 1024
SEED = 41

_SHAPE = "t int, cell bigint, home bigint, id bigint, ids array<bigint>, vec array<double>"
_SCHEMA = pa.schema([("t", pa.int32()), ("cell", pa.int64()), ("home", pa.int64()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("vec", pa.list_(pa.float64()))])


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


class Hasher:
    """Cells of unit vectors, and the order in which to visit cells for a query."""

    def __init__(self, dims: int, tables: int, projections: int, width: float, spread: float, seed: int = SEED):
        rng = np.random.default_rng([seed, dims])
        self.a = rng.standard_normal((tables, projections, dims))
        self.b = rng.random((tables, projections)) * width
        self.tables, self.projections, self.width, self.spread = tables, projections, width, spread

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Positions (vectors, tables, projections), in cells."""
        return (np.einsum("nd,tkd->ntk", unit, self.a) + self.b) / self.width

    @staticmethod
    def names(cells: np.ndarray) -> np.ndarray:
        """64 bits for the cells of (..., projections)."""
        with np.errstate(over="ignore"):
            out = np.zeros(cells.shape[:-1], dtype=np.uint64)
            for i in range(cells.shape[-1]):
                out = (out ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
            return out.view(np.int64)

    def visit(self, place: np.ndarray, reach: float) -> np.ndarray:
        """Cells (n, projections) of one table in falling order of chance, until these sum to ``reach``."""
        k = len(place)
        if not k:
            return np.zeros((1, 0), dtype=np.int64)
        unit = self.spread / self.width
        sides = []
        for x in place:
            lows = np.arange(math.floor(x - 5 * unit), math.floor(x + 5 * unit) + 1)
            cdf = np.array([0.5 * (1 + math.erf((e - x) / unit / math.sqrt(2))) for e in [*lows, lows[-1] + 1]])
            chance = np.maximum(np.diff(cdf), 1e-12)
            by = np.argsort(-chance, kind="stable")
            sides.append((lows[by], np.log(chance[by])))
        start = (0,) * k
        heap, seen, out, total = [(-sum(s[1][0] for s in sides), start)], {start}, [], 0.0
        while heap and total < reach:
            cost, at = heapq.heappop(heap)
            total += math.exp(-cost)
            out.append([sides[i][0][at[i]] for i in range(k)])
            for i in range(k):
                if at[i] + 1 < len(sides[i][0]):
                    after = (*at[:i], at[i] + 1, *at[i + 1 :])
                    if after not in seen:
                        seen.add(after)
                        heapq.heappush(heap, (cost + sides[i][1][at[i]] - sides[i][1][at[i] + 1], after))
        return np.array(out, dtype=np.int64)


def _hashed(rows: DataFrame, options: tuple, reach: float | None) -> DataFrame:
    """Rows (id, ids, vec) with their home cell in each table; with ``reach``, a row for each cell to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            lists = batch.column(2)
            sizes, flat = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes).tolist():
                h = hashers.setdefault(dims, Hasher(dims, *options))
                step = max(1, FLUSH_BYTES // (h.tables * (48 + 8 * dims)))
                mine = np.nonzero(sizes == dims)[0]
                for at in range(0, len(mine), step):
                    yield from spread(h, batch, mine[at : at + step], flat[starts[mine[at : at + step], None] + np.arange(dims)])

    def spread(h: Hasher, batch: pa.RecordBatch, mine: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        place = h.places(x / np.linalg.norm(x, axis=1, keepdims=True))
        own = np.concatenate([np.full((*place.shape[:2], 1), x.shape[1]), np.floor(place)], axis=2)
        home = h.names(own)
        if reach is None:
            who, table, cell = np.repeat(np.arange(len(x)), h.tables), np.tile(np.arange(h.tables), len(x)), home.ravel()
        else:
            seen = [h.visit(place[i, t], reach) for i in range(len(x)) for t in range(h.tables)]
            which = np.repeat(np.arange(len(seen)), [len(c) for c in seen])
            who, table = which // h.tables, which % h.tables
            cells = np.concatenate(seen)
            cell = h.names(np.concatenate([np.full((len(cells), 1), x.shape[1]), cells], axis=1))
        step = max(1, FLUSH_BYTES // (48 + 8 * x.shape[1]))
        for at in range(0, len(who), step):
            w, t = who[at : at + step], table[at : at + step]
            some = batch.take(pa.array(mine[w]))
            arrays = [pa.array(t.astype(np.int32)), pa.array(cell[at : at + step]), pa.array(home[w, t]), some.column(0), some.column(1), some.column(2)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, _SCHEMA)], schema=_SCHEMA)

    return rows.select("id", "ids", "vec").mapInArrow(tidy(run), _SHAPE)


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row in one order of addition, whatever the number of rows."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _compare(most: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("ids").combine_chunks()
        is_query = np.array(ids.is_null())
        vec = group.column("vec").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1) if group.num_rows else np.zeros((0, 1))
        x, q = vec[~is_query], vec[is_query]
        out: tuple[list, list, list] = ([], [], [])
        if len(x) and len(q):
            own, names = group.column("id").to_numpy()[is_query], ids.filter(pa.array(~is_query)).to_pylist()
            near = (q / np.sqrt((q * q).sum(axis=1))[:, None]) @ (x / np.sqrt((x * x).sum(axis=1))[:, None]).T
            wide = min(len(x), most + 8)
            for i in range(len(q)):
                # all that could be among the first when added up in the other order
                cut = np.partition(near[i], len(x) - wide)[len(x) - wide] - 1e-9
                pick = np.nonzero(near[i] >= cut)[0]
                scores = cosine(x[pick], q[i])
                rows = sorted((-s, v) for p, s in zip(pick.tolist(), scores.tolist()) for v in names[p] if v != own[i])[:most]
                out[0].extend([own[i]] * len(rows))
                out[1].extend(v for _, v in rows)
                out[2].extend(-s for s, _ in rows)
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _spread(entries: DataFrame, most: int) -> float:
    """The usual distance of a unit vector's ``most``-th neighbour: that of a bounded sample of vectors among all vectors."""
    rows = entries.select("id", "vec").orderBy(F.xxhash64("id")).limit(MOST_SAMPLE).collect()
    sizes = [len(r.vec) for r in rows]
    dims = max(set(sizes), key=sizes.count) if sizes else 0
    rows = [r for r in rows if len(r.vec) == dims]
    if not rows:
        return 1.0
    probes = np.array([r.vec for r in rows])
    probes = probes / np.abs(probes).max(axis=1, keepdims=True)
    probes /= np.linalg.norm(probes, axis=1, keepdims=True)
    shared, own = entries.sparkSession.sparkContext.broadcast(probes), np.array([r.id for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(own), most), -2.0)
        for batch in batches:
            sizes, flat = pc.list_value_length(batch.column(1)).to_numpy(), batch.column(1).flatten().to_numpy()
            mine = np.nonzero(sizes == dims)[0]
            if not len(mine):
                continue
            x = flat[(np.cumsum(sizes) - sizes)[mine, None] + np.arange(dims)]
            x = x / np.abs(x).max(axis=1, keepdims=True)
            near = shared.value @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            near[own[:, None] == batch.column(0).to_numpy()[mine]] = -2.0
            best = np.sort(np.concatenate([best, near], axis=1), axis=1)[:, -most:]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own)), most)), pa.array(best.ravel())], names=["probe", "near"])

    found = entries.select("id", "vec").mapInArrow(tidy(run), "probe bigint, near double").filter("near > -2")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("near")))
    last = [r.near for r in found.withColumn("rank", rank).filter(F.col("rank") == most).select("near").collect()]  # a number for each probe
    return max(0.05, float(np.sqrt(max(0.0, 2 - 2 * np.quantile(last, 0.25))))) if last else 1.0


def search(vectors: DataFrame, queries: Column, most: int = 5, tables: int = TABLES, reach: float = REACH, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``most`` nearest found for the rows that ``queries`` is true for."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(queries, F.lit(False)).alias("ask")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    # equal vectors: their smallest ids, cut down before the shuffle (window group limit)
    ranked = rows.select("id", "vec").withColumn("r", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= most + 1)
    entries = materialize(ranked.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "vec"), "ann-entries")
    asked = materialize(rows.filter("ask").dropDuplicates(["id", "vec"]).select("id", F.lit(None).cast("array<bigint>").alias("ids"), "vec"), "ann-queries")
    n, n_asked = entries.count(), asked.count()
    options = (tables, max(1, round(math.log(max(n, 1) / CELL_ROWS, 4)) if n else 1), WIDTH, _spread(entries, most))
    index = materialize(_hashed(entries, options, None).drop("home"), "ann-index")
    sizes = materialize(index.groupBy("t", "cell").agg(F.expr(f"cast(ceil(count(*) / {BLOCK_VECTORS}) as int)").alias("blocks")), "ann-sizes")
    query_parts = max(1, -(-n_asked // BLOCK_QUERIES))
    columns = ["t", "cell", "block", "part", "id", "ids", "vec"]

    def found(some: DataFrame, how_far: float) -> DataFrame:
        probes = materialize(_hashed(some, options, how_far), "ann-probes")
        # queries of one home go together; a home of many is split
        homes = materialize(probes.groupBy("t", "home").agg(F.expr(f"cast(ceil(approx_count_distinct(id) / {BLOCK_QUERIES}) as int)").alias("split")), "ann-homes")
        part = F.struct(F.pmod(F.xxhash64("t", "home"), F.lit(query_parts)).alias("group"), F.pmod(F.xxhash64("id"), F.col("split")).alias("split"))
        probes = salted_join(probes, homes, ["t", "home"], ["id", "cell"]).withColumn("part", part)
        # the parts that visit a cell: no more than there are parts of queries
        asking = materialize(probes.groupBy("t", "cell").agg(F.collect_set("part").alias("parts")).join(sizes, ["t", "cell"]), "ann-asking")
        probes = salted_join(probes, sizes, ["t", "cell"], ["id"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = salted_join(index, asking, ["t", "cell"], ["id"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        both = dealt.withColumn("part", F.explode("parts")).select(*columns).unionByName(probes.select(*columns))
        each = both.groupBy("t", "cell", "block", "part").applyInArrow(_compare(most), "query_id bigint, vec_id bigint, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)

    first = materialize(found(asked, reach), "ann-found")
    # queries in sparse surroundings: search on, all but everywhere
    full = first.groupBy("query_id").count().filter(F.col("count") >= most)
    sparse = materialize(asked.join(full.select(F.col("query_id").alias("id")), "id", "left_anti"), "ann-sparse")
    if not sparse.isEmpty():
        more = materialize(found(sparse, 1 - 1e-9), "ann-more")
        first = first.join(sparse.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    for done in (entries, asked, index, sizes):
        release(done)
    return first.select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op9_nearest": op9_nearest}
SQL: dict[str, str] = {}
