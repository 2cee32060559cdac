"""Operator 7: n-gram Jaccard join with a prefix tree.

A document's set is its distinct k-word shingles; two documents link at 100 * intersection >=
percent * union. Every link is found:

1. Texts become sets of 64-bit shingle hashes, ordered by hash (the global order). Equal sets are
   one node from here on, whatever their number.
2. Signatures split the hash range into so many parts that two sets that link must agree on
   several whole parts (pigeonhole over their symmetric difference). Pairs of sets that may agree
   on enough of them tie blocks together. This step reads signatures only.
3. In a block the ordered sets are put into a trie whose levels are parts of the hash range. A set
   walks down the trie, so that sets which share a beginning share its partial overlap; a subtree is
   left where that overlap and the remaining lengths, its own and the set's, can't reach the threshold.
4. Blocks above a bound are dealt out as pairs of bounded batches: no task holds more than two.

Cases. Null and empty texts have no shingles, link with nothing and are their own class. Null ids
never name a class that has other ids. Rows with one id are rows of their own. Texts with fewer
than k words have their word sequence as one shingle. Texts of any length are taken whole: a set has
8 bytes for each distinct shingle. Extra columns, also clashing ones, are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Rows, bounded_batches, documents, materialize, release, tidy
from gleaner.llm.graph import components, salted_join

#: The least number of parts beyond those that the pigeonhole needs.
SLACK = 12
#: Signatures of more sets than this are never paired out.
LIST = 16
#: Bounds of a batch: sets, and shingles in all of them.
BATCH_SETS = 2000
BATCH_SHINGLES = 2_000_000
#: Members of blocks that may be broadcast to the texts (about 200 bytes each).
MOST_MEMBERS = 50_000
#: Signatures of a bucket.
BUCKET_SIGNATURES = 400_000

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, k: int):
        self.k, self.words = k, _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
        n = len(words)
        if not n:
            return np.empty(0, dtype=np.uint64)
        size = min(self.k, n)
        one = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=n)
        with np.errstate(over="ignore"):
            out = np.full(n - size + 1, size, dtype=np.uint64)
            for j in range(size):
                out = out * _C1 + one[j : n - size + 1 + j]
            return np.unique(_mix(out))


class Signer:
    """Signatures of a set. Sizes fall into classes, each about percent ** -2 wide; a set has the
    signatures of its class, and of the next one up if a set that links with it can be there.

    Linked sets of a class differ in at most ``differ`` elements, so of differ + 1 + slack parts of
    the hash range they agree on slack + 1 at least, empty ones included. Signatures leave empty
    parts out; the slack is so large that a set seldom has more empty parts than that (one that
    has gives signatures of its empty parts too)."""

    def __init__(self, percent: int):
        self.percent, self.lows, self.highs, self.slacks = percent, [1], [1], [0]

    def _differ(self, c: int) -> int:
        return (100 - self.percent) * 2 * self.highs[c] // (100 + self.percent)

    def _class(self, n: int) -> int:
        while self.highs[-1] < n:
            low = self.highs[-1] + 1
            self.lows.append(low)
            self.highs.append(max(low, low * 10_000 // (self.percent * self.percent)))
            differ, least = self._differ(len(self.highs) - 1), max(1, self.percent * low // 100)
            slack = SLACK if differ else 0
            while differ and slack < least + SLACK:
                # empty parts of the smallest set with signatures of this class, and some more
                empty = (differ + 1 + slack) * math.exp(-least / (differ + 1 + slack))
                if slack >= empty + 3 * math.sqrt(empty) + SLACK / 2:
                    break
                slack += max(1, slack // 16)
            self.slacks.append(slack)
        return bisect.bisect_left(self.highs, n)

    def _parts(self, c: int) -> int:
        return self._differ(c) + 1 + self.slacks[c]

    def _classes(self, n: int) -> range:
        last = self._class(n * 100 // self.percent)
        return range(self._class(n), last + 1) if n else range(0)

    def most(self, n: int) -> int:
        """How many signatures a set of ``n`` has at most."""
        return sum(self._parts(c) for c in self._classes(n))

    def _cuts(self, s: np.ndarray, c: int) -> np.ndarray:
        """Where the parts of a class begin in a set, and its end."""
        parts = self._parts(c)
        edges = np.arange(parts, dtype=np.uint64) * np.uint64((1 << 64) // parts if parts > 1 else 0)
        return np.append(np.searchsorted(s, edges), len(s))

    def agree(self, s: np.ndarray) -> int:
        """On how many signatures, at least, this set agrees with any set that links with it."""
        out = None
        for c in self._classes(len(s)):
            at = self._cuts(s, c)
            here = max(1, self.slacks[c] + 1 - int((at[1:] == at[:-1]).sum()))
            out = here if out is None else min(out, here)
        return out or 1

    def __call__(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if not n:
            return np.empty(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(s + _C1), dtype=np.uint64)])
            out = []
            for c in self._classes(n):
                at = self._cuts(s, c)
                full = at[1:] > at[:-1]
                if len(full) - int(full.sum()) > self.slacks[c]:
                    full[:] = True  # too many empty parts to leave them out
                which = np.nonzero(full)[0]
                out.append(_mix((sums[at[1:]] - sums[at[:-1]])[which] + _mix(np.uint64(c << 32) + which.astype(np.uint64) + np.uint64(1))))
        return np.concatenate(out).view(np.int64)


class PrefixTrie:
    """A trie over sorted sets. Level j holds the tokens of the j-th part of the hash range: a node
    stands for the sets, neighbours in lexical order, that agree on all tokens up to there. Nodes of
    a level are arrays: tokens, least and most size below, tokens left below, range of children."""

    def __init__(self, sets: list[np.ndarray]):
        m = len(sets)
        self.order = np.array(sorted(range(m), key=lambda i: sets[i].astype(">u8").tobytes()), dtype=np.int64)
        self.visited = 0  # nodes whose tokens were counted, over all queries
        rows = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in rows], dtype=np.int64)
        self.levels = min(16, 2 * m.bit_length())
        self.width = np.uint64((1 << 64) // max(1, self.levels) if self.levels > 1 else 0)
        self.nodes: list[tuple] = []
        if not m:
            return
        flat, at = np.concatenate(rows), np.concatenate([[0], np.cumsum(self.size)])
        self.tokens, ids = np.unique(flat, return_inverse=True)
        self.mask = np.zeros(len(self.tokens) + 1, dtype=bool)
        part = np.minimum(flat // self.width, np.uint64(self.levels - 1)).astype(np.int64)
        cut = np.zeros((m, self.levels + 1), dtype=np.int64)
        cut[:, 1:] = np.cumsum(np.bincount(np.repeat(np.arange(m), self.size) * self.levels + part, minlength=m * self.levels).reshape(m, -1), axis=1)
        shared = np.zeros(m, dtype=np.int64)
        for i in range(1, m):
            least = min(self.size[i - 1], self.size[i])
            unlike = rows[i - 1][:least] != rows[i][:least]
            shared[i] = int(unlike.argmax()) if unlike.any() else least
        new = np.ones((m, self.levels), dtype=bool)
        new[1:] = (shared[1:, None] < cut[1:, 1:]) | (cut[1:, 1:] != cut[:-1, 1:])
        node = np.cumsum(new, axis=0) - 1
        for j in range(self.levels):
            first = np.nonzero(new[:, j])[0]
            after = np.append(first[1:], m)
            length = cut[first, j + 1] - cut[first, j]
            spots = np.repeat(at[first] + cut[first, j], length) + _counted(length)
            least, most = np.minimum.reduceat(self.size, first), np.maximum.reduceat(self.size, first)
            down = (node[first, j + 1], node[after - 1, j + 1] + 1) if j + 1 < self.levels else (first, after)
            self.nodes.append((ids[spots], np.concatenate([[0], np.cumsum(length)]), least, most, most - cut[first, j + 1], *down))

    def matches(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Indices (into the given sets) of the sets that link with ``s``."""
        n = len(s)
        if not len(self.size) or not n:
            return np.empty(0, dtype=np.int64)

        def need(size: np.ndarray) -> np.ndarray:  # 100 i >= percent (n + size - i)
            return -(-percent * (n + size) // (100 + percent))

        own = np.searchsorted(self.tokens, s)
        own = own[(own < len(self.tokens)) & (self.tokens[np.minimum(own, len(self.tokens) - 1)] == s)]
        self.mask[own] = True
        upto = np.searchsorted(s, np.arange(1, self.levels, dtype=np.uint64) * self.width)
        left = [*(n - upto).tolist(), 0]
        # both bounds grow or fall with the size, so that one end of a subtree's sizes decides each
        _, _, least, most, _, _, _ = self.nodes[0]
        at = np.nonzero((n >= need(least)) & (most >= need(most)))[0]
        overlap = np.zeros(len(at), dtype=np.int64)
        for j, (tokens, start, least, most, rest, low, high) in enumerate(self.nodes):
            if not len(at):
                break
            self.visited += len(at)
            length = start[at + 1] - start[at]
            hits = np.concatenate([[0], np.cumsum(self.mask[tokens[np.repeat(start[at], length) + _counted(length)]])])
            ends = np.cumsum(length)
            overlap = overlap + hits[ends] - hits[ends - length]
            alive = (overlap + left[j] >= need(least[at])) & (overlap + rest[at] >= need(most[at]))
            at, overlap = at[alive], overlap[alive]
            width = high[at] - low[at]
            at, overlap = np.repeat(low[at], width) + _counted(width), np.repeat(overlap, width)
        self.mask[own] = False
        return self.order[at]


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def join_sets(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``right`` its matches in ``left``; without ``right``, of ``left`` in itself."""
    trie = PrefixTrie(left)
    for i, s in enumerate(left if right is None else right):
        found = trie.matches(s, percent)
        yield i, found if right is not None else found[found != i]


def _scan(docs: DataFrame, k: int, percent: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts, with two kinds of rows. Rows (id, n, f, g, z): set size, 128 bits of
    the set, on how many signatures it agrees with a linked set at least. Rows (bucket, pairs):
    signatures dealt out by bucket, packed as 48 bits of the signature and 48 bits of the set. A set
    that a task has met before isn't sent again. (A signature or set that another one agrees with in
    48 bits only adds a candidate.)"""
    id_type = docs.schema[id_col].dataType.simpleString()

    def packed(sigs: list[np.ndarray], nodes: list[int], rows: Rows) -> None:
        sig = np.concatenate(sigs).view(np.uint64)
        node = np.repeat(np.array(nodes, dtype=np.int64).view(np.uint64), [len(x) for x in sigs])
        bucket = ((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        by = np.argsort(bucket, kind="stable")
        pairs = np.stack([sig[by], node[by]], axis=1).astype("<u8").view(np.uint8).reshape(-1, 2, 8)[:, :, :6].tobytes()
        which, at = np.unique(bucket[by], return_index=True)
        ends = np.append(at[1:], len(sig))
        for b, i, j in zip(which.tolist(), at.tolist(), ends.tolist()):
            rows.add((None, None, None, None, None, b, pairs[12 * i : 12 * j]), 60 + 12 * (j - i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign, met, sigs, nodes, held, rows = Shingler(k), Signer(percent), set(), [], [], 0, None
        for batch in batches:
            if rows is None:
                whole = [(c, pa.int64()) for c in ("n", "f", "g", "z")]
                rows = Rows(pa.schema([("id", batch.schema.field(0).type), *whole, ("bucket", pa.int32()), ("pairs", pa.binary())]))
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle(text.as_py())
                f, g = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64).tolist()
                rows.add((key, len(s), f, g, sign.agree(s), None, None))
                if len(s) and f not in met:
                    if len(met) >= 500_000:
                        met.clear()
                    met.add(f)
                    sigs.append(sign(s))
                    nodes.append(f)
                    held += len(sigs[-1])
                    if held >= 500_000:
                        packed(sigs, nodes, rows)
                        sigs, nodes, held = [], [], 0
                if rows.full():
                    yield from rows.take()
        if nodes:
            packed(sigs, nodes, rows)
        if rows is not None:
            yield from rows.take()

    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(tidy(run), f"id {id_type}, n bigint, f bigint, g bigint, z bigint, bucket int, pairs binary")


def _candidates(signed: DataFrame, buckets: int) -> DataFrame:
    """(sig, a, b): for each set with a signature that another set was first met with, that set (a)
    and this one (b). A task holds one set for each signature of its buckets, however many share it."""
    schema = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hubs = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        pending: list[bytes] = []
        size = 0

        def settle():
            nonlocal seen, hubs
            six = np.frombuffer(b"".join(pending), dtype=np.uint8).reshape(-1, 2, 6)
            wide = np.zeros((len(six), 2, 8), dtype=np.uint8)
            wide[:, :, :6] = six
            sig, node = wide.reshape(-1, 16).view("<u8").T
            by = np.argsort(sig, kind="stable")
            sig, node = sig[by], node[by].astype(np.int64)
            at = np.minimum(np.searchsorted(seen, sig), max(0, len(seen) - 1))
            old = seen[at] == sig if len(seen) else np.zeros(len(sig), dtype=bool)
            first = np.append(True, sig[1:] != sig[:-1])
            head = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))
            hub = node[head]
            if len(seen):
                hub = np.where(old, hubs[at], hub)
            new = first & ~old
            merged = np.concatenate([seen, sig[new]])
            order = np.argsort(merged, kind="stable")
            seen, hubs = merged[order], np.concatenate([hubs, node[new]])[order]
            link = hub != node
            return np.unique(np.stack([sig[link].astype(np.int64), hub[link], node[link]]), axis=1)

        for batch in batches:
            for blob in batch.column(1):
                pending.append(blob.as_py())
                size += len(pending[-1]) // 12
                # about as much as is seen already, so that all is merged a few times only
                if size >= min(600_000, max(250_000, len(seen))):
                    pairs = settle()
                    pending, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], schema=schema)
        if pending:
            pairs = settle()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], schema=schema)

    return signed.repartition(buckets, "bucket").select("bucket", "pairs").mapInArrow(tidy(run), "sig bigint, a bigint, b bigint")


def _blocks(signed: DataFrame, buckets: int, nodes: DataFrame) -> DataFrame:
    """(short, block) for the sets that may link with another one.

    Two sets that link agree on as many signatures as each of them must at least (z). Signatures
    of up to LIST sets are counted for each pair of their sets. Those of more sets aren't: a pair
    may agree on as many of them as either set has. So a pair that shares a short list is kept
    where the short ones and the smaller number of long ones reach the larger z; a pair that shares
    long lists only has as many long ones as z for both. All such sets that share a long list are of
    one block: each set joins its first long list, lists that a set joins to its first one are
    contracted, and each set is tied once, to the least set of its contracted lists."""
    shared = materialize(_candidates(signed, buckets), "njac-shared")
    rows = shared.select("sig", F.col("a").alias("short")).union(shared.select("sig", F.col("b").alias("short"))).distinct()
    rows = materialize(rows, "njac-rows")
    long = materialize(rows.groupBy("sig").count().filter(F.col("count") > LIST).select("sig", F.lit(True).alias("long")), "njac-long")
    rows_of = materialize(salted_join(rows, long, ["sig"], ["short"], "left"), "njac-lists")
    least = nodes.select(F.col("f").bitwiseAND(F.lit((1 << 48) - 1)).alias("short"), "z").groupBy("short").agg(F.min("z").alias("z"))
    # the long lists of a set: no more than it has signatures
    own = rows_of.groupBy("short").agg(F.sort_array(F.collect_list(F.when(F.col("long"), F.col("sig")))).alias("sigs"))
    info = materialize(own.join(least, "short").select("short", "z", F.size("sigs").alias("many"), F.when(F.size("sigs") >= F.col("z"), F.col("sigs")).alias("sigs")), "njac-info")
    lists = rows_of.filter("long IS NULL").groupBy("sig").agg(F.sort_array(F.collect_set("short")).alias("l"))  # LIST sets at most
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = lists.select(F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("times"))
    one = info.select(F.col("short").alias("x"), F.col("z").alias("zx"), F.col("many").alias("mx"))
    two = info.select(F.col("short").alias("y"), F.col("z").alias("zy"), F.col("many").alias("my"))
    kept = pairs.join(one, "x").join(two, "y").filter(F.col("times") >= F.greatest("zx", "zy") - F.least("mx", "my")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    heavy = info.filter("sigs IS NOT NULL").select("short", F.col("sigs")[0].alias("pick"), "sigs")
    joined = components(heavy.select(F.col("pick").alias("a"), F.explode("sigs").alias("b")).distinct()).withColumnsRenamed({"node": "pick"})
    heavy = salted_join(heavy.select("short", "pick"), joined, ["pick"], ["short"], "left").select("short", F.coalesce("label", "pick").alias("label"))
    heavy = materialize(heavy, "njac-heavy")
    hubs = materialize(heavy.groupBy("label").agg(F.min("short").alias("hub")), "njac-hubs")
    tied = salted_join(heavy, hubs, ["label"], ["short"]).select(F.col("hub").alias("a"), F.col("short").alias("b"))
    out = components(kept.union(tied)).withColumnsRenamed({"node": "short", "label": "block"})
    for done in (shared, rows, long, rows_of, info, heavy, hubs):
        release(done)
    return out


def _task(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.i.iloc[0] == pdf.j.iloc[0]
        sides = [pdf] if one else [pdf[pdf.side == pdf.i], pdf[pdf.side == pdf.j]]
        sides = [p.drop_duplicates(["f", "g"]) for p in sides]
        f = np.concatenate([p.f.to_numpy() for p in sides])
        copies = np.concatenate([p.copies.to_numpy() for p in sides])
        sets = [[np.frombuffer(b, dtype="<u8") for b in p.shingles] for p in sides]
        links, root, shift = np.zeros(len(f), dtype=np.int64), list(range(len(f))), len(sets[0])

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, found in join_sets(sets[0], None if one else sets[1], percent):
            i = i if one else i + shift
            links[i] += copies[found].sum()
            if not one:
                links[found] += copies[i]
            for j in found.tolist():
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
        return pd.DataFrame({"f": f, "root": f[[find(i) for i in range(len(f))]], "links": links})

    return run


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (the least id reachable by
    links, its own included) and ``n_links`` (rows that it links with, equal sets included)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    # a text has about one signature for 16 bytes at most; the number only sizes the buckets
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // 16 // BUCKET_SIGNATURES))
    scanned = materialize(_scan(docs, k, percent, buckets, id_col, text_col), "njac-scan")
    rows = scanned.filter("bucket IS NULL")
    nodes = materialize(rows.filter("n > 0").groupBy("f", "g").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.max("n").alias("n"), F.max("z").alias("z")), "njac-nodes")
    blocks = _blocks(scanned.filter("bucket IS NOT NULL").select("bucket", "pairs"), buckets, nodes)
    # the blocks' texts, one for each node, back to sets
    members = materialize(nodes.withColumn("short", F.col("f").bitwiseAND(F.lit((1 << 48) - 1))).join(blocks, "short").drop("short", "z"), "njac-members")
    stats = members.groupBy("block").agg(F.expr(f"cast(greatest(ceil(count(*) / {BATCH_SETS}), ceil(sum(n) / {BATCH_SHINGLES})) as int)").alias("batches"))
    dealt = salted_join(members, stats, ["block"], ["f"]).withColumnsRenamed({"least": "_least"})
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # few members go to the texts, else the texts go to them
    dealt = F.broadcast(dealt) if members.count() <= MOST_MEMBERS else dealt.hint("shuffle_hash")
    texts = texts.join(dealt, texts["_id"].eqNullSafe(dealt["_least"])).select("_text", "f", "g", "n", "copies", "block", "batches")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        schema = pa.schema([(c, pa.int64()) for c in ("f", "g", "copies", "block")] + [("batches", pa.int32()), ("shingles", pa.binary())])
        for batch in batches:
            out, names = Rows(schema), batch.schema.names
            for text, f, g, _, copies, block, n_batches in zip(*[batch.column(c) if c == "_text" else batch.column(c).to_pylist() for c in names]):
                raw = shingle(text.as_py()).tobytes()
                if np.frombuffer(xxhash.xxh3_128_digest(raw), dtype=np.int64).tolist() == [f, g]:
                    out.add((f, g, copies, block, n_batches, raw), 48 + len(raw))
                    if out.full():
                        yield from out.take()
            yield from out.take()

    found = texts.mapInArrow(tidy(again), "f bigint, g bigint, copies bigint, block bigint, batches int, shingles binary")
    side = F.pmod(F.xxhash64("g"), F.col("batches")).cast("int")
    dealt = found.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    dealt = dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    linked = dealt.groupBy("block", "i", "j").applyInPandas(_task(percent), "f bigint, root bigint, links bigint")
    linked = materialize(linked, "njac-linked")
    labels = components(linked.select(F.col("f").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "f"})
    degree = linked.groupBy("f").agg(F.sum("links").alias("links"))
    node = nodes.join(degree, "f", "left").join(labels, "f", "left").select("f", "g", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "f").alias("label"))
    node = materialize(node.filter("copies > 1 OR links > 0"), "njac-node")
    least = node.groupBy("label").agg(F.min("least").alias("component"))
    named = salted_join(node, least, ["label"], ["f"]).select("f", "g", "component", (F.col("links") + F.col("copies") - 1).alias("links"))
    named = materialize(named, "njac-named")
    for done in (nodes, members, linked, node):
        release(done)
    out = salted_join(rows.select("id", "n", "f", "g"), named, ["f", "g"], ["id"], "left")
    return out.select(F.col("id").cast(id_type).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of rows that link over any steps, and all that link with
    nothing: the row with the least id, null last; of those with one id, the one with the least
    hash of the text, then of the row. Columns must be of kinds that can be hashed."""
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"))
    classes = materialize(jaccard_classes(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), k, percent, "_key", "_text").filter("n_links > 0"), "njac-classes")
    lost = classes.filter("component_id <> _key").select("_key").distinct()
    twice = classes.filter("component_id = _key").groupBy("_key").count().filter("count > 1").select("_key")
    own = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"))
    kept = own.join(lost.hint("shuffle_hash"), "_key", "left_anti")
    if not twice.isEmpty():
        twice = materialize(twice, "njac-twice")
        one = own.join(twice.hint("shuffle_hash"), "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
        kept = kept.join(twice.hint("shuffle_hash"), "_key", "left_anti").select("_row").union(one.select("_row"))
    return kept.select("_row.*")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir), k=3, percent=90)


QUERIES = {"op7_ngram_jaccard": op7_ngram_jaccard}
SQL = {
    "op7_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY ALL),
link AS (SELECT x, y FROM p WHERE 100 * i >= 90 * (nx + ny - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, link.y FROM r JOIN link ON link.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
d AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM s JOIN c ON c.x = doc_id LEFT JOIN d ON d.x = doc_id"""
}
