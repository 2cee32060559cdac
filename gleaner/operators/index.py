"""Index operators: document ids, postings, lookups, shards, and the stored index that searches read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators import counting as C
from gleaner.operators import stats as S
from gleaner.sources.work import written

#: Fixed value: postings of a shard; a longer word has a shard of its own.
SHARD_LIMIT = 500_000
#: Part of a stored index's name: another where what is stored changes, so that none of another form is read.
LAYOUT = "index-of-packed-parts"
#: Documents of a row of postings: a word of more documents has several rows.
SPAN = 1 << 20
#: Documents whose texts are counted together for such rows.
WITHIN = 1 << 12


def document_ids(docs: DataFrame) -> DataFrame:
    """(doc, doc_int): dense ids from 1 in document order.

    Ids are numbered within ranges of documents, and each range starts where the ones before it
    end: no task sees more than a range. The ranges are written, so that both readers see the same."""
    rows = docs.select("doc").distinct()
    ranged = written(rows.repartitionByRange("doc").select("doc", F.spark_partition_id().alias("part")), "ranges")
    within = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("doc")))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))  # a row per partition
    starts = sizes.withColumn("start", F.sum("size").over(Window.orderBy("part")) - F.col("size")).drop("size")
    return within.join(F.broadcast(starts), "part").select("doc", (F.col("start") + F.col("n")).cast("bigint").alias("doc_int"))


def postings(tf: DataFrame, ids: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """(word, part, docs): the sorted documents of each word, by number if ``ids`` is given, a row
    for each ``span`` document numbers, so that no word's list is in one row or task. Documents that
    aren't whole numbers are dealt out by hash."""
    rows = tf.select("word", "doc") if ids is None else tf.join(ids, "doc").select("word", F.col("doc_int").alias("doc"))
    whole = rows.schema["doc"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    part = F.floor(F.col("doc") / span).cast("bigint") if whole else F.pmod(F.xxhash64("doc"), F.lit(16))
    return rows.groupBy("word", part.alias("part")).agg(F.sort_array(F.collect_set("doc")).alias("docs"))


def text_postings(docs: DataFrame, ids: DataFrame, span: int = SPAN) -> DataFrame:
    """The same as :func:`postings` by number, from documents: texts are dealt out by their number's range
    and counted there, so that no pairs of document and word are shuffled. A wide range is put together of several lists."""
    content = docs.columns[1]
    rows = docs.join(ids.hint("shuffle_hash"), "doc").select(F.col("doc_int").alias("doc"), content)
    lists = C.part_lists(rows, span, WITHIN)
    if span <= WITHIN:
        return lists
    return lists.groupBy("word", "part").agg(F.flatten(F.sort_array(F.collect_list("docs"))).alias("docs"))  # lists of disjoint ranges


def candidates(words: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, doc): documents with at least one of a query's words. ``words``: (qid, word); ``index``: (word, docs)."""
    return words.join(index, "word").select("qid", F.explode("docs").alias("doc")).distinct()


def build_index(docs: DataFrame, path: str, limit: int = SHARD_LIMIT) -> StoredIndex:
    """Write the index of (doc, words) under ``path``: ``stats`` (one row), ``terms`` (word, df,
    shard), sorted by word, and ``postings`` (word, df, part, entries) in a folder for each shard,
    sorted by word. Postings are collected where the documents are: a row has those of one word in a
    part of the documents, and these rows are dealt out once. Words go to shards of about ``limit``
    postings by hash. A word of more has a shard of its own, which is dealt out by parts, so that it
    has many files. Terms are taken from the postings as written, where a word's frequency is there already."""
    spark = docs.sparkSession
    lists = written(S.entries(docs, totals=True, packed=True), "lists")
    totals = lists.filter("word IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "occurrences")))
    average = F.try_divide(F.col("occurrences").cast("double"), F.col("n").cast("double"))
    totals.select(F.col("n").alias("corpus_size"), average.alias("avg_doc_len")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    parts = lists.filter("word IS NULL").count()
    lists = lists.filter("word IS NOT NULL")
    shards = max(1, -(-(lists.agg(F.sum("n")).first()[0] or 0) // limit))
    # in packed lists a word has a row in a part at most: one above the limit has more than that share of it somewhere
    some = lists.filter(F.col("n") > (limit / max(1, parts) if C.is_packed(lists) else 0)).select("word").distinct()
    hot = lists.join(_few(some), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("df")).filter(F.col("df") > limit)  # ``shards`` rows at most
    hot = written(hot.select("word", F.col("df").alias("hot"), (F.row_number().over(Window.orderBy("word")) + shards - 1).cast("bigint").alias("own")), "hot")
    shard = F.coalesce("own", F.pmod(F.xxhash64("word"), F.lit(shards))).alias("shard")
    slices = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("part"), F.ceil(F.col("hot") / limit))).otherwise(F.lit(0).cast("bigint"))
    placed = lists.join(F.broadcast(hot), "word", "left").select("word", "n", "part", "entries", "hot", shard, slices.alias("slice"))
    # tasks of about as many postings, whatever their number; a word's frequency is summed where its rows are
    together = Window.partitionBy("shard", "slice", "word")
    placed = placed.repartition(shards + hot.count(), "shard", "slice").withColumn("df", F.coalesce("hot", F.sum("n").over(together)))
    placed = placed.sortWithinPartitions("shard", "slice", "word")  # as the window has them; a shard with slices has one word
    placed.select("word", "df", "part", "entries", "shard").write.partitionBy("shard").mode("overwrite").parquet(f"{path}/postings")
    terms = spark.read.schema("word string, df bigint, shard bigint").parquet(f"{path}/postings").groupBy("word").agg(F.max("df").alias("df"), F.max("shard").alias("shard"))
    terms.sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/terms")
    return StoredIndex(spark, path)


def _opened(lists: DataFrame) -> DataFrame:
    """(word, df, doc, tf, doc_len, shard): a row for each posting."""
    rows = C.opened(lists, "word", "df", "shard")
    return rows.select("word", "df", "doc", F.col("tf").cast("bigint").alias("tf"), F.col("doc_len").cast("bigint").alias("doc_len"), "shard")


#: Words of a query set that are broadcast; beyond, the planner joins by shuffle.
MOST_BROADCAST = 200_000


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


class StoredIndex:
    """What :func:`build_index` wrote."""

    #: Words of a query set that go to the scan as literals; more of them are joined.
    MOST_LITERALS = 2_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.stats, self.terms, self.lists = (spark.read.parquet(f"{path}/{name}") for name in ("stats", "terms", "postings"))
        self.postings = _opened(self.lists)

    def read(self, words: DataFrame) -> DataFrame:
        """(word, df, doc, tf, doc_len) of the words asked for: only their shards' folders are listed,
        and in these only the row groups that may hold them are read."""
        return _opened(self.read_lists(words)).drop("shard")

    def read_lists(self, words: DataFrame) -> DataFrame:
        """The same as rows (word, df, part, entries, shard)."""
        asked = words.select("word").distinct()
        some = [r.word for r in asked.limit(self.MOST_LITERALS + 1).collect()]
        if len(some) > self.MOST_LITERALS:
            # a row for each word asked for: broadcast behind a check, else all postings would be shuffled
            terms = self.terms.join(_few(asked), "word", "left_semi").select("shard", "word")
            return self.lists.join(_few(terms), ["shard", "word"], "left_semi").select(*self.lists.columns)
        found = self.terms.filter(F.col("word").isin(some)).collect()  # a row per word asked for
        if not found:
            return self.lists.filter("false")
        return self.lists.filter(F.col("shard").isin(sorted({r.shard for r in found})) & F.col("word").isin([r.word for r in found]))


def lookup(index: DataFrame, words: Iterable[str]) -> DataFrame:
    """Rows of the given words; the filter reaches the scan."""
    return index.filter(F.col("word").isin(list(words)))


def prefix_lookup(index: DataFrame, prefix: str) -> DataFrame:
    return index.filter(F.col("word").startswith(prefix))


def decode(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Numbers back to documents."""
    return rows.join(ids, "doc_int")


def new_words(old: DataFrame, new: DataFrame) -> DataFrame:
    """Words of ``new`` that ``old`` doesn't have."""
    return new.select("word").distinct().join(old.select("word"), "word", "left_anti")


def pack_shards(df: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """(word, df, shard): words by falling frequency, then by name, fill shards up to ``limit`` postings.

    The rule is sequential. Words are first cut into equal frequencies: within one frequency a
    shard takes a fixed number of words, so only the list of distinct frequencies (which grows
    with the root of the corpus) is walked through, and words find their shard by their place
    in their frequency."""
    # the ranges are written, so that both readers see the same
    ranged = written(df.select("word", F.col("df").cast("bigint").alias("df")).repartitionByRange("df", "word").withColumn("part", F.spark_partition_id()), "ranges")
    steps = ranged.groupBy("df").agg(F.count("*").alias("n"))
    walk = F.aggregate(
        F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("neg"), "n"))),
        F.struct(F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<df:bigint,shard:bigint,room:bigint,per:bigint>>").alias("out")),
        lambda acc, x: _step(acc, -x["neg"], x["n"], limit),
        lambda acc: acc["out"],
    )
    plan = steps.agg(walk.alias("plan")).select(F.explode("plan").alias("p")).select("p.*")
    # the place of a word in its frequency: numbered in ranges, then shifted by the ranges before
    within = ranged.withColumn("i", F.row_number().over(Window.partitionBy("part", "df").orderBy("word")))
    before = ranged.groupBy("part", "df").agg(F.count("*").alias("c"))
    before = before.withColumn("skip", F.sum("c").over(Window.partitionBy("df").orderBy("part")) - F.col("c")).drop("c")
    placed = within.join(before, ["part", "df"]).withColumn("i", F.col("i") + F.col("skip") - 1).join(plan, "df")
    shard = F.when(F.col("i") < F.col("room"), F.col("shard")).otherwise(F.col("shard") + 1 + F.floor((F.col("i") - F.col("room")) / F.col("per")))
    return placed.select("word", "df", shard.cast("bigint").alias("shard"))


def _step(acc, freq, n, limit: int):
    """``n`` words of one frequency: so many still fit into the open shard, ``per`` into each further one."""
    freq = freq.cast("bigint")
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / freq)).cast("bigint")
    fit = F.floor((limit - acc["used"]) / freq).cast("bigint")
    # a word above the limit still goes into a shard that is empty
    room = F.when(acc["used"] == 0, F.greatest(F.lit(1), fit)).otherwise(F.greatest(F.lit(0), fit)).cast("bigint")
    rest = F.greatest(F.lit(0).cast("bigint"), n - room)
    more = F.ceil(rest / per).cast("bigint")
    last = (rest - (more - 1) * per).cast("bigint")
    used = F.when(rest == 0, acc["used"] + n * freq).otherwise(last * freq).cast("bigint")
    row = F.struct(freq.alias("df"), acc["shard"].alias("shard"), room.alias("room"), per.alias("per"))
    return F.struct((acc["shard"] + more).cast("bigint").alias("shard"), used.alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))
