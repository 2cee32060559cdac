"""Operator 5: mixing sources to target weights, by DataFrame and SQL functions alone.

Leaves are the combinations of the levels (domain, language, source). A token budget goes down
the tree: each node's share is divided among its children by weight; a child can take no more
than ``max_epochs`` times the tokens below it, and what it can't take is divided among its
siblings, so that a shortage reaches a node's own siblings only when all below it is used up.
A leaf's share is whole epochs plus a prefix of one more epoch, in an order seeded by epoch.

Scale. Totals meet in partial sums; the tree has one row per leaf. A leaf's prefix is found from
sums over 65,536 ranges of the order key, and only the range in which the prefix ends is sorted,
so a leaf with a third of all rows is never in one task. The result of the search is one cut per
leaf, joined to the rows by broadcast behind a check of the number of leaves, else salted.

Cases. Null levels count as ``''``. Null and empty texts have no tokens: they are in a prefix if
their place is. Rows with one id and one leaf share an order key and are taken together. A null id
counts as ``''``. Texts of any length are counted whole. Fractions of tokens are rounded down at
each node; of siblings that fill up alike, the least by name comes first. An empty table gives an
empty result. Clashing extra columns are kept; own columns start with ``_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import documents, materialize, release

LEVELS = ("domain", "lang", "source")
#: The domain of a source, by the number at its end; Spark and DuckDB alike.
DOMAIN = "CASE try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS int) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'other' END"
#: Target weights among siblings: whole numbers up to 1,000; 1 where none is named.
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
#: The budget as a whole percentage of all tokens, the most epochs of a leaf, the seed of the order.
BUDGET_PERCENT = 80
MAX_EPOCHS = 2
SEED = 17
MOST_BROADCAST = 20_000


def count_tokens(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    n = F.size(parts)
    return (n - F.when(parts[0] == "", 1).otherwise(0) - F.when((n > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("bigint")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(f"_mix_{level}") == value, w).otherwise(out)
    return out.cast("bigint")


def budgets(leaves: DataFrame, levels, weights: dict, budget_percent: int, max_epochs: int) -> DataFrame:
    """``leaves``: a row per leaf with ``_mix_<level>`` and ``_mix_tokens``. Adds ``_mix_share``."""
    names = [f"_mix_{level}" for level in levels]
    node = leaves.withColumn("_cap", F.col("_mix_tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("_mix_tokens"), F.lit(0)).alias("_all"))  # one row
    shares = total.select(F.floor(F.col("_all") * budget_percent / F.lit(100)).cast("bigint").alias("_share"), F.lit(0).alias("_root"))
    up: list[str] = ["_root"]
    node = node.withColumn("_root", F.lit(0))
    for depth, level in enumerate(levels):
        down = [*up, names[depth]]
        children = node.groupBy(*down).agg(F.sum("_cap").alias("_c")).withColumn("_w", _weight(level, weights))
        children = children.join(shares.select(*up, F.col("_share").alias("_a")), up)
        # the children that fill up come first: those with the least capacity for their weight
        order = Window.partitionBy(*up).orderBy(F.expr("_c / cast(nullif(_w, 0) as double)").asc_nulls_last(), names[depth])
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = order.rowsBetween(0, Window.unboundedFollowing)
        children = children.select("*", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_below"), F.sum("_w").over(after).alias("_rest"))
        children = children.withColumn("_full", F.expr("_w > 0 and cast(_c as double) * _rest <= cast(_w as double) * (_a - _below)"))
        open_from = Window.partitionBy(*up)
        children = children.withColumn("_used", F.sum(F.expr("if(_full, _c, 0L)")).over(open_from)).withColumn("_left", F.sum(F.expr("if(_full, 0L, _w)")).over(open_from))
        shares = children.select(*down, F.expr("if(_full, _c, coalesce((_w * (_a - _used)) div nullif(_left, 0L), 0L))").alias("_share"))
        up = down
    return node.join(shares, up).select(*names, "_mix_tokens", F.col("_share").alias("_mix_share"))


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit(""))))


def plan(docs: DataFrame, levels=LEVELS, weights=None, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, cuts). Rows: ``docs`` with ``_mix_<level>`` and ``_mix_n`` (tokens) added. Cuts: for
    each leaf ``_mix_epochs``, the whole epochs, and ``_mix_cut``, the last order key of the prefix."""
    weights = WEIGHTS if weights is None else weights
    names = [f"_mix_{level}" for level in levels]
    rows = docs.select("*", *[F.coalesce(F.col(level).cast("string"), F.lit("")).alias(name) for level, name in zip(levels, names)], count_tokens(F.col(text_col)).alias("_mix_n"))
    narrow = materialize(rows.select(F.col(id_col).alias("_mix_id"), *names, "_mix_n"), "mix-rows")
    leaves = materialize(narrow.groupBy(*names).agg(F.sum("_mix_n").alias("_mix_tokens")), "mix-leaves")
    shares = budgets(leaves, levels, weights, budget_percent, max_epochs).select(
        *names, F.expr("coalesce(_mix_share div nullif(_mix_tokens, 0L), 0L)").alias("_mix_epochs"), F.expr("coalesce(_mix_share % nullif(_mix_tokens, 0L), 0L)").alias("_mix_rem")
    )
    shares = materialize(shares, "mix-shares")
    keyed = attach(narrow, shares, names).withColumn("_mix_key", order_key(seed, F.col("_mix_epochs"), F.col("_mix_id"))).withColumn("_mix_range", F.substring("_mix_key", 1, 4))
    ranges = keyed.groupBy(*names, "_mix_range").agg(F.sum("_mix_n").alias("_s"), F.max("_mix_rem").alias("_rem"))
    upto = Window.partitionBy(*names).orderBy("_mix_range")
    # the first range that doesn't fit whole: all ranges before it do
    ends = ranges.withColumn("_below", F.sum("_s").over(upto) - F.col("_s")).filter("_below <= _rem and _below + _s > _rem").groupBy(*names).agg(F.min("_mix_range").alias("_end"), F.min("_below").alias("_below"))
    ends = materialize(ends, "mix-ends")
    last = attach(keyed, ends, names).filter(F.col("_mix_range") == F.col("_end"))
    last = last.groupBy(*names, "_mix_key").agg(F.sum("_mix_n").alias("_s"), F.max("_mix_rem").alias("_rem"), F.max("_below").alias("_below"))
    inner = last.withColumn("_upto", F.col("_below") + F.sum("_s").over(Window.partitionBy(*names).orderBy("_mix_key"))).filter("_upto <= _rem")
    inner = inner.groupBy(*names).agg(F.max("_mix_key").alias("_cut"))
    # without a range that doesn't fit, the remainder is 0 of no tokens at all: everything fits
    cuts = shares.join(ends, names, "left").join(inner, names, "left").select(*names, "_mix_epochs", F.coalesce("_cut", "_end", F.lit("g")).alias("_mix_cut"))
    cuts = materialize(cuts, "mix-cuts")
    for done in (narrow, leaves, shares, ends):
        release(done)
    return rows, cuts


def attach(rows: DataFrame, leaves: DataFrame, names: list[str], spread: str = "_mix_id") -> DataFrame:
    """Join one row per leaf to rows; leaves are broadcast behind a check of their number, else hot leaves are salted over 32 tasks."""
    if leaves.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(leaves), names)
    salted = rows.withColumn("_mix_salt", F.pmod(F.xxhash64(spread), F.lit(32)).cast("int"))
    return salted.join(leaves.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(31)))), [*names, "_mix_salt"]).drop("_mix_salt")


def mix(docs: DataFrame, levels=LEVELS, seed: int = SEED, id_col: str = "doc_id", **options) -> DataFrame:
    """The selected rows of ``docs`` with their columns, ``_mix_n`` and ``_mix_copies``: how many times each is drawn."""
    rows, cuts = plan(docs, levels=levels, seed=seed, id_col=id_col, **options)
    names = [f"_mix_{level}" for level in levels]
    key = order_key(seed, F.col("_mix_epochs"), F.col(id_col))
    # a cut that is a range's name (4 characters) stands below all keys of that range
    drawn = attach(rows, cuts, names, id_col).withColumn("_mix_copies", (F.col("_mix_epochs") + (key <= F.col("_mix_cut")).cast("bigint")).cast("bigint"))
    return drawn.filter("_mix_copies > 0").select(*docs.columns, "_mix_n", "_mix_copies")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.expr(DOMAIN).alias("domain"), "lang", "source")
    return mix(docs).select("doc_id", "domain", "lang", "source", F.col("_mix_n").alias("n_tokens"), F.col("_mix_copies").alias("copies"))


def _case(level: str, column: str) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {w}" for v, w in WEIGHTS[level].items())
    return f"(CASE {column} {whens} ELSE 1 END)" if whens else "1"


def _level_sql(depth: int) -> str:
    """The shares of one level from those of the level above."""
    up, level = [f"k{i}" for i in range(depth)], f"k{depth}"
    part = f"PARTITION BY {', '.join(up)}" if up else ""
    down = ", ".join([*up, level])
    above = f"JOIN s{depth - 1} USING ({', '.join(up)})" if up else f"CROSS JOIN (SELECT CAST(floor(sum(n) * {BUDGET_PERCENT} / 100) AS BIGINT) AS share FROM d)"
    weight = _case(LEVELS[depth], level)
    return f"""
c{depth} AS (SELECT {down}, c, {weight} AS w, share AS a FROM (SELECT {down}, CAST(sum(c) AS BIGINT) AS c FROM leaf GROUP BY {down}) {above}),
f{depth} AS (SELECT *, w > 0 AND CAST(c AS DOUBLE) * (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    <= CAST(w AS DOUBLE) * (a - coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM c{depth}
    WINDOW o AS ({part} ORDER BY c / CAST(w AS DOUBLE), {level})),
s{depth} AS (SELECT {down}, CAST(CASE WHEN full_ THEN c ELSE (w * (a - sum(CASE WHEN full_ THEN c ELSE 0 END) OVER ({part})))
    // nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({part}), 0) END AS BIGINT) AS share FROM f{depth})"""


SQL = {
    "op5_source_mix": f"""
WITH d AS (SELECT doc_id, {DOMAIN} AS domain, lang, source, {DOMAIN} AS k0, coalesce(lang, '') AS k1, coalesce(source, '') AS k2,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM documents),
leaf AS (SELECT k0, k1, k2, CAST(sum(n) AS BIGINT) AS t, CAST(sum(n) AS BIGINT) * {MAX_EPOCHS} AS c FROM d GROUP BY k0, k1, k2),
{_level_sql(0)}, {_level_sql(1)}, {_level_sql(2)},
e AS (SELECT k0, k1, k2, coalesce(share // nullif(t, 0), 0) AS epochs, coalesce(share % nullif(t, 0), 0) AS rem FROM leaf JOIN s2 USING (k0, k1, k2)),
o AS (SELECT d.*, epochs, rem, md5('{SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM d JOIN e USING (k0, k1, k2)),
p AS (SELECT *, sum(n) OVER (PARTITION BY k0, k1, k2 ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o)
SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(epochs + CASE WHEN upto <= rem THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM p WHERE epochs > 0 OR upto <= rem"""
}

QUERIES = {"op5_source_mix": op5_source_mix}
