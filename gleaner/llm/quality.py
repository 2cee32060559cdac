"""Operator 6: quality rules with robust multivariate outliers.

Each text gets a vector of transformed statistics. Per language and source, a minimum covariance
determinant estimate gives centre and scatter: of the subsets of ``KEEP_SHARE`` of a group's rows,
one whose scatter has a least determinant. It is looked for from several deterministic starts
(medians and quartile spreads, with correlations from none, from bounded scores, from spatial signs
and from quadrants); each goes through concentration steps, in which all rows take part, the start
of the least determinant is kept, and steps go on until the determinant doesn't fall any more. A
document is rejected when its squared Mahalanobis distance exceeds ``cutoff``. FLOORS are added to
the deviations wherever a scatter is inverted or its determinant is taken, so that features that
hardly vary (no repeated line in most groups) don't make it singular.

Scale. A concentration step is one aggregation to (group, start, distance bin) rows with counts,
sums and cross products: partial sums meet in the shuffle, so a hot source costs no more than a cold
one. Distances are binned on a log scale, which gives the step's subset without sorting a group.
A group's estimate is averaged with that of its language, and this with that of all rows, which
count as ``prior`` rows each: small groups lean on the larger ones, by degrees.

Cases. Null and empty texts have no words and fail the base rule. Null language or source is a
group of its own. Null ids and repeated rows get a row each. Texts of any length are taken whole.
Rows as near as the last one of a subset (ties) belong to it. Extra columns are kept; those named
``_stats``, ``_base_failed``, ``_distance`` and ``_kept`` are replaced by :func:`judge`, and kept
as they were by :func:`keep_good`. An empty table gives an empty result.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import bounded_batches, documents, materialize, release, tidy

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Features: log word length, log symbol rate, duplicate line share, repeated word share, log words.
#: From so many words on, texts count as equally long: length alone is no defect.
MOST_WORDS = 2_000
#: What each feature may vary by in any group; its square is added to the estimated variance.
FLOORS = (0.06, 0.35, 0.15, 0.10, 0.30)
DIMS = len(FLOORS)
#: The 0.999 quantile of chi-square in 5 dimensions. The floors of the shares let each pass it alone: 1 / 0.15^2 = 44, 0.5^2 / 0.10^2 = 25.
CUTOFF = 20.515
KEEP_SHARE = 0.75
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
#: Starts; steps that each of them takes; most steps of the best one; fall of the log determinant that counts.
STARTS = 4
FIRST_STEPS = 2
MOST_STEPS = 10
LEAST_FALL = 1e-3
#: As many rows the estimate of the level above counts.
PRIOR = 100
#: Groups of which the estimates may be broadcast; beyond, they are joined by a salted shuffle.
MOST_BROADCAST = 20_000
BINS_PER_DOUBLING = 16
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split on exactly the six ASCII white-space characters
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in raw.split(b"\n"):
        if line and line.strip():
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            count = collections.Counter(windows)
            end = 0
            for i, window in enumerate(windows):
                if count[window] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, duplicates, lines, repeated


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in STATS]))
def stats_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    yield from tidy(lambda each: (pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS), dtype="int64") for texts in each))(batches)


#: Marked so that the optimizer doesn't evaluate it once for a filter and once more for what is selected.
stats_udf = stats_udf.asNondeterministic()


def features(s: Column) -> Column:
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(s["n_lines"], F.lit(1)).cast("double")
    return F.array(
        F.log(F.greatest(s["word_chars"], F.lit(1)) / n), F.log(s["n_symbols"] / n + 0.01), s["n_dup_lines"] / lines, s["n_repeat_words"] / n, F.log(F.least(n, F.lit(float(MOST_WORDS))))
    )


def _chi2_cdf(x: float, k: int) -> float:
    """Lower regularised gamma by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 500):
        term *= z / (a + i)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if x > 0 else 0.0


def consistency(share: float, dims: int) -> float:
    """What makes the scatter of the nearest ``share`` of normal rows agree with that of all."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, dims) < share else (low, mid)
    return share / _chi2_cdf(low, dims + 2)


def _levels() -> Column:
    """A row counts for its group, its language and all rows."""
    return F.explode(
        F.array(
            F.struct(F.lit(0).alias("level"), "lang", "source"),
            F.struct(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source")),
            F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
        )
    )


def _estimates(frames):
    """Rows of (key, start, n, centre, scatter) with the inverse and log determinant of the scatter."""
    floor = np.diag(np.square(FLOORS))
    for pdf in frames:
        m = np.stack([np.asarray(x, dtype=float).reshape(DIMS, DIMS) for x in pdf.scatter]) + floor if len(pdf) else np.zeros((0, DIMS, DIMS))
        yield pdf.assign(inverse=[x.ravel().tolist() for x in np.linalg.inv(m)], logdet=np.linalg.slogdet(m)[1])[list(_MODEL_COLUMNS)]


_MODEL = "level int, lang string, source string, start int, n bigint, centre array<double>, scatter array<double>, inverse array<double>, logdet double"
_MODEL_COLUMNS = [c.split()[0] for c in _MODEL.split(", ")]
_KEY = ["level", "lang", "source"]


def _estimated(rows: DataFrame) -> DataFrame:
    return materialize(rows.select(*_MODEL_COLUMNS[:-2]).mapInPandas(_estimates, _MODEL), "quality-model")


def _square(upper) -> Column:
    """A matrix as one array from a function of the pairs on and above its diagonal."""
    return F.array(*[upper(min(i, j), max(i, j)) for i in range(DIMS) for j in range(DIMS)])


def _distance(x: Column, centre: Column, inverse: Column) -> Column:
    d = [x[i] - centre[i] for i in range(DIMS)]
    squares = sum((d[i] * d[i] * inverse[i * DIMS + i] for i in range(DIMS)), F.lit(0.0))
    products = sum((2 * d[i] * d[j] * inverse[i * DIMS + j] for i in range(DIMS) for j in range(i)), F.lit(0.0))
    return F.when(inverse.isNotNull(), F.greatest(F.lit(0.0), squares + products))  # null without an estimate


def _attach(rows: DataFrame, model: DataFrame, on: list[str], x: str) -> DataFrame:
    """Join estimates to rows, as columns ``_m_...``: broadcast behind a check of their number, else by salted keys, so that a hot group spreads over 32 tasks."""
    model = model.select(*[F.col(c).alias(f"_m_{c}") for c in model.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_m_{c.removeprefix('_q_')}")) for c in on]
    if model.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(model), [*same], "left")
    salted = rows.withColumn("_q_salt", F.pmod(F.xxhash64(x), F.lit(32)).cast("int"))
    copies = model.withColumn("_m_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return salted.join(copies, [*same, F.col("_q_salt") == F.col("_m_salt")], "left")


def _starts(keyed: DataFrame) -> DataFrame:
    """The starts of each group."""
    quart = [F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 2000) for i in range(DIMS)]
    spots = keyed.groupBy(*_KEY).agg(*[q.alias(f"q{i}") for i, q in enumerate(quart)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in range(DIMS)]
    spots = materialize(spots.select(*_KEY, F.array(*[F.col(f"q{i}")[1] for i in range(DIMS)]).alias("centre"), F.array(*spread).alias("spread")), "quality-spots")
    z = F.array(*[(F.col("x")[i] - F.col("_m_centre")[i]) / F.col("_m_spread")[i] for i in range(DIMS)])
    rows = _attach(keyed, spots, _KEY, "x").select(*_KEY, "_m_centre", "_m_spread", z.alias("z"))
    norm = F.greatest(F.sqrt(sum((F.col("z")[i] * F.col("z")[i] for i in range(DIMS)), F.lit(0.0))), F.lit(1e-9))
    rows = rows.withColumn("norm", norm)
    kinds = [lambda i: F.tanh(F.col("z")[i]), lambda i: F.col("z")[i] / F.col("norm"), lambda i: F.signum(F.col("z")[i])]
    sums = rows.groupBy(*_KEY).agg(
        F.count("*").alias("n"), F.first("_m_centre").alias("centre"), F.first("_m_spread").alias("spread"),
        *[F.sum(u(i) * u(j)).alias(f"k{k}_{i}_{j}") for k, u in enumerate(kinds) for i, j in PAIRS],
    )

    def scatter(k: int) -> Column:
        def upper(i: int, j: int) -> Column:
            if i == j:
                return F.col("spread")[i] * F.col("spread")[i]
            if k < 0:
                return F.lit(0.0)
            r = F.try_divide(F.col(f"k{k}_{i}_{j}"), F.sqrt(F.col(f"k{k}_{i}_{i}") * F.col(f"k{k}_{j}_{j}")))
            return F.coalesce(r, F.lit(0.0)) * F.col("spread")[i] * F.col("spread")[j]

        return _square(upper)

    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("start"), scatter(k).alias("scatter")) for k in range(-1, STARTS - 1)]))
    out = _estimated(sums.select(*_KEY, "n", "centre", each.alias("s")).select(*_KEY, "s.start", "n", "centre", "s.scatter"))
    release(spots)
    return out


def _step(keyed: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step of each estimate: centre and scatter of the nearest rows."""
    near = _attach(keyed, model.drop("n", "scatter", "logdet"), _KEY, "x").withColumn("d", _distance(F.col("x"), F.col("_m_centre"), F.col("_m_inverse")))
    which = [*_KEY, "start"]
    bins = near.withColumnRenamed("_m_start", "start").withColumn("bin", F.floor(F.log2(F.col("d") + 1e-6) * BINS_PER_DOUBLING)).groupBy(*which, "bin").agg(
        F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(DIMS)], *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in PAIRS]
    )
    # per estimate a few hundred bins at most: the window's input is bounded whatever the rows
    one = Window.partitionBy(*which)
    inside = bins.withColumn("below", F.sum("n").over(one.orderBy("bin")) - F.col("n")).withColumn("total", F.sum("n").over(one)).filter(F.col("below") < KEEP_SHARE * F.col("total"))
    sums = inside.groupBy(*which).agg(F.max("total").alias("n"), F.sum("n").cast("double").alias("h"), *[F.sum(c).alias(c) for c in bins.columns if c[0] in "sp" and c[1].isdigit()])
    centre = F.array(*[F.col(f"s{i}") / F.col("h") for i in range(DIMS)])
    factor = consistency(KEEP_SHARE, DIMS)
    scatter = _square(lambda i, j: (F.col(f"p{i}_{j}") / F.col("h") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("h") / F.col("h")) * factor)
    return _estimated(sums.select(*which, "n", centre.alias("centre"), scatter.alias("scatter")))


def search(keyed: DataFrame) -> DataFrame:
    """For each group of (level, lang, source, x) the estimate of the least determinant found."""
    model = _starts(keyed)
    for _ in range(FIRST_STEPS):
        old, model = model, _step(keyed, model)
        release(old)
    old, model = model, materialize(model.groupBy(*_KEY).agg(F.min_by(F.struct(*_MODEL_COLUMNS[3:]), F.struct("logdet", "start")).alias("m")).select(*_KEY, "m.*"), "quality-best")
    release(old)
    for _ in range(MOST_STEPS):
        after = _step(keyed, model)
        # a step's subset ends with a whole bin, so that it may also lose a little: the better one stays
        both = model.select(*_MODEL_COLUMNS, F.col("logdet").alias("old")).unionByName(after.withColumn("old", F.lit(None).cast("double")))
        best = both.groupBy(*_KEY).agg(F.min_by(F.struct(*_MODEL_COLUMNS[3:]), "logdet").alias("m"), F.max("old").alias("old"))
        best = materialize(best.select(*_KEY, "m.*", "old"), "quality-best")
        fall = best.agg(F.max(F.col("old") - F.col("logdet"))).first()[0]  # one number
        for done in (model, after):
            release(done)
        model = best
        if fall is None or fall < LEAST_FALL:
            break
    return model


def fit(stats: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``stats``: lang, source, x (features), of documents that pass the base rule. Gives one row
    for each group, language and all: centre and inverse scatter."""
    keyed = materialize(stats.select(_levels().alias("k"), "x").select("k.*", "x"), "quality")
    found = search(keyed)
    release(keyed)

    def blend(rows: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
        above = above.select(*[F.col(c).alias(f"_{c}") for c in (*on, "centre", "scatter")])
        mean = lambda c: F.zip_with(c, f"_{c}", lambda own, up: (own * F.col("n") + up * prior) / (F.col("n") + prior))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on] or F.lit(True)
        return rows.join(above, same).withColumn("centre", mean("centre")).withColumn("scatter", mean("scatter")).select(*_MODEL_COLUMNS[:-2])

    every = found.filter("level = 2")  # one row
    langs = blend(found.filter("level = 1"), F.broadcast(every), [])
    groups = blend(found.filter("level = 0"), langs, ["lang"])
    out = _estimated(groups.unionByName(langs).unionByName(every.select(*_MODEL_COLUMNS[:-2])))
    release(found)
    return out


def described(docs: DataFrame) -> DataFrame:
    """(_q_row: the row of ``docs``, _q_stats, _q_lang, _q_source, _q_failed: by the base rule, _q_x: features)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("_q_row"), stats_udf(F.col("text").cast("string")).alias("_q_stats"), F.col("lang").cast("string").alias("_q_lang"), F.col("source").cast("string").alias("_q_source"))
    s = F.col("_q_stats")
    failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    return rows.withColumn("_q_failed", failed).withColumn("_q_x", features(s))


def _judged(rows: DataFrame, cutoff: float, prior: float) -> DataFrame:
    """Described rows with ``_q_distance`` and ``_q_kept``."""
    narrow = materialize(rows.filter("NOT _q_failed").select(F.col("_q_lang").alias("lang"), F.col("_q_source").alias("source"), F.col("_q_x").alias("x")), "quality-x")
    model = fit(narrow, prior).filter("level = 0").select("lang", "source", "centre", "inverse")
    release(narrow)
    out = _attach(rows, model, ["_q_lang", "_q_source"], "_q_x")
    out = out.withColumn("_q_distance", F.when(~F.col("_q_failed"), _distance(F.col("_q_x"), F.col("_m_centre"), F.col("_m_inverse"))))
    return out.withColumn("_q_kept", ~F.col("_q_failed") & (F.col("_q_distance") <= cutoff))


def judge(docs: DataFrame, cutoff: float = CUTOFF, prior: float = PRIOR) -> DataFrame:
    """``docs`` with its columns, plus the struct ``_stats``, ``_base_failed``, ``_distance``
    (squared; null where the base rule failed) and ``_kept``. Statistics cover all rows."""
    return _shown(_judged(described(docs), cutoff, prior))


def judge_texts(docs: DataFrame, cutoff: float = CUTOFF, prior: float = PRIOR) -> DataFrame:
    """The same without the column ``text``: the texts are read once, and their statistics written."""
    rows = described(docs)
    rows = materialize(rows.withColumn("_q_row", F.col("_q_row").dropFields("text")), "quality-rows")
    return _shown(_judged(rows, cutoff, prior))


def _shown(judged: DataFrame) -> DataFrame:
    new = {"_stats": "_q_stats", "_base_failed": "_q_failed", "_distance": "_q_distance", "_kept": "_q_kept"}
    kept = [c for c in judged.schema["_q_row"].dataType.names if c not in new]
    return judged.select(*[F.col("_q_row").getField(c).alias(c) for c in kept], *[F.col(c).alias(name) for name, c in new.items()])


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, prior: float = PRIOR) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns only."""
    return _judged(described(docs), cutoff, prior).filter("_q_kept").select("_q_row.*")


def op6_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge_texts(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return got.select(
        "doc_id",
        *[F.col(f"_stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.col("_distance").alias("distance"),
    )


QUERIES = {"op6_quality_mcd": op6_quality_mcd}
SQL: dict[str, str] = {}
