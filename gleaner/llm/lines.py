"""Operator 2: line dedup, by DataFrame and SQL functions alone.

A document is the sequence of its lines that have a word, each hashed after trimming. A run of
lines is long enough when it has ``min_words`` words or ``MIN_LINES`` lines. Winnowing: of each
shortest long-enough window, the leftmost least line hash is selected; the selected positions of
a document, each with the windows that selected it, are its fingerprints. Any run that two places
share holds a shortest window, so both places have selected its least line: no run is missed.
Fingerprints that stand at one position only are left out. From the joined positions the match is
extended to the left and to the right, line by line as far as the windows of that position reach,
and compared with the first place of each extension. A line goes when a long-enough run around it
stands earlier in the corpus: in a document with a smaller id, or earlier in the same document
without overlap. The union of matching windows is exactly that set of lines.

Hashes are pairs of 64 bits. Scale: a document gives a row for each selected position; positions
are counted and first places found by aggregates before the shuffle (a hot line is one row per
task), and the joins that bring them back are broadcast behind a check of their size, else salted.
A passage's copies are compared with its first place only, whatever their number.

Cases. Null ids come first. Null and empty texts stay as they are. Rows with the same id and text
are one document: they are no repeat of each other and get the same result; rows with one id and
other texts are ordered by a hash of the text. Lines without a word stay where they are. Texts and
lines of any length are taken whole, in time that grows with their length. An empty table gives an
empty result. Extra columns, also clashing ones, are kept; own columns start with ``_ln``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, materialize, release
from gleaner.llm.graph import salted_join

MIN_LINES = 3
MIN_WORDS = 50
#: Deletions that may be broadcast to the texts: documents, and lines in all of them.
MOST_DOCUMENTS = 100_000
MOST_LINES = 1_000_000


def _lines(text: Column) -> Column:
    """Structs of two hashes and words for the lines that have a word."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    full = F.filter(parts, lambda p: p != "")
    return F.transform(full, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(1), p).alias("b"), F.size(F.split(p, r"[\x20\x09-\x0D]+")).alias("w")))


def _least(start: str, n: str) -> str:
    """Place of the leftmost least hash of A in a window of up to three lines."""
    return (
        f"CASE {n} WHEN 1 THEN {start} WHEN 2 THEN IF(A[{start}] <= A[{start} + 1], {start}, {start} + 1) WHEN 3 THEN"
        f" CASE WHEN A[{start}] <= A[{start} + 1] AND A[{start}] <= A[{start} + 2] THEN {start} WHEN A[{start} + 1] <= A[{start} + 2] THEN {start} + 1 ELSE {start} + 2 END END"
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (_ln_id, _ln_t: the document; p: a selected position among its lines with a word; fp:
    the line's hash; W: the shortest windows that selected it, as s: place of the first line, n:
    number of lines, a, b: hashes)."""
    rows = docs.select(F.col(id_col).alias("_ln_id"), F.xxhash64(text_col).alias("_ln_t"), _lines(F.col(text_col)).alias("L")).filter(F.size("L") > 0)
    rows = rows.select("_ln_id", "_ln_t", F.size("L").alias("m"), F.col("L.a").alias("A"), F.col("L.b").alias("B"), F.col("L.w").alias("w"))
    # with at most MIN_LINES = 3 lines to a window, the shortest one from a line on and up to it are spelled out
    ahead = f"CASE WHEN w[i] >= {min_words} THEN 1 WHEN i + 1 < m AND w[i] + w[i + 1] >= {min_words} THEN 2 WHEN i + 2 < m THEN 3 ELSE 0 END"
    back = f"CASE WHEN w[i] >= {min_words} THEN 1 WHEN i >= 1 AND w[i] + w[i - 1] >= {min_words} THEN 2 WHEN i >= 2 THEN 3 ELSE 0 END"
    rows = rows.withColumn("N", F.expr(f"transform(sequence(0, m - 1), i -> struct({ahead} AS f, {back} AS g))"))
    rows = rows.withColumn("V", F.expr(f"transform(N, (x, i) -> struct({_least('i', 'x.f')} AS f, {_least('(i - x.g + 1)', 'x.g')} AS g))"))
    # the windows that begin up to two lines before a position and those that end up to two lines after it
    begin = ", ".join(f"IF(get(V, p - {d}).f = p, struct(p - {d} AS s, N[p - {d}].f AS n), null)" for d in (0, 1, 2))
    end = ", ".join(f"IF(get(V, p + {d}).g = p, struct(p + {d} - N[p + {d}].g + 1 AS s, N[p + {d}].g AS n), null)" for d in (0, 1, 2))
    window = "struct(x.s AS s, x.n AS n, xxhash64(slice(A, x.s + 1, x.n)) AS a, xxhash64(2, slice(B, x.s + 1, x.n)) AS b)"
    chosen = f"filter(transform(A, (fp, p) -> struct(p AS p, fp AS fp, array_distinct(filter(array({begin}, {end}), x -> x IS NOT NULL)) AS W)), x -> size(x.W) > 0)"
    each = rows.select("_ln_id", "_ln_t", "A", "B", F.explode(F.expr(chosen)).alias("c"))
    return each.select("_ln_id", "_ln_t", "c.p", "c.fp", F.expr(f"transform(c.W, x -> {window})").alias("W"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_ln_id, _ln_t, _ln_gone): for each document that repeats something, the sorted places, among its lines with a word, of the lines to delete."""
    every = materialize(fingerprints(docs, id_col, text_col, min_words), "lines")
    # join positions: fingerprints that stand at two positions or more
    spot = F.xxhash64("_ln_id", "_ln_t", "p")
    shared = materialize(every.groupBy("fp").agg(F.min(spot).alias("x"), F.max(spot).alias("y")).filter("x <> y").select("fp"), "lines-shared")
    near = salted_join(every, shared, ["fp"], ["_ln_id", "_ln_t", "p"], "left_semi")
    # extend both ways from a shared position, and find the first place of each extension
    near = materialize(near.select("_ln_id", "_ln_t", "fp", F.inline("W")), "lines-near")
    key = ["fp", "n", "a", "b"]
    place = F.struct("_ln_id", "_ln_t", "s")
    first = near.groupBy(*key).agg(F.min(place).alias("at"), F.max(place).alias("last")).filter(~F.col("at").eqNullSafe(F.col("last"))).drop("last")
    first = materialize(first, "lines-first")
    later = salted_join(near, first, key, ["_ln_id", "_ln_t", "s"]).filter(
        ~(F.col("_ln_id").eqNullSafe(F.col("at._ln_id")) & F.col("_ln_t").eqNullSafe(F.col("at._ln_t"))) | (F.col("s") >= F.col("at.s") + F.col("n"))
    )
    gone = later.select("_ln_id", "_ln_t", F.explode(F.expr("sequence(s, s + n - 1)")).alias("i")).groupBy("_ln_id", "_ln_t").agg(F.sort_array(F.collect_set("i")).alias("_ln_gone"))
    gone = materialize(gone, "lines-gone")
    for done in (every, shared, near, first):
        release(done)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text without its later repeated runs, and ``_ln_gone``: the places of the deleted lines in the text, null if none."""
    gone = repeats(docs, id_col, text_col, min_words).withColumnsRenamed({"_ln_id": "_ln_id2", "_ln_t": "_ln_t2", "_ln_gone": "_ln_spots"})
    n_docs, n_lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("_ln_spots")), F.lit(0))).first()
    gone = F.broadcast(gone) if n_docs <= MOST_DOCUMENTS and n_lines <= MOST_LINES else gone.hint("shuffle_hash")
    rows = docs.withColumn("_ln_t", F.xxhash64(text_col))
    joined = rows.join(gone, rows[id_col].eqNullSafe(gone["_ln_id2"]) & (rows["_ln_t"] == gone["_ln_t2"]), "left")
    out = joined.withColumn("_ln_new", F.when(F.col("_ln_spots").isNotNull(), _without(F.split(text_col, "\n", -1), F.col("_ln_spots"))))
    out = out.withColumn(text_col, F.when(F.col("_ln_spots").isNull(), F.col(text_col)).otherwise(F.col("_ln_new.text")))
    return out.select(*docs.columns, F.col("_ln_new.gone").alias("_ln_gone"))


def _without(lines: Column, spots: Column) -> Column:
    """A text's lines without those at ``spots`` among the ones with a word: ``gone``, their places, and the ``text`` that is left.

    Each step is bound to the element of a list of one: named columns would be put into the functions
    of the elements by the optimizer, and made again for each of them."""

    def bind(parts: Column, then) -> Column:
        return F.transform(F.array(parts), then)[0]

    word = lambda line, i: F.when(line.rlike(r"[^\x20\x09-\x0D]"), i)
    left = lambda h: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(h["lines"]) - 1), h["gone"]), lambda i: h["lines"][i]), "\n")
    return bind(
        F.struct(lines.alias("lines"), spots.alias("spots")),
        lambda a: bind(
            F.struct(a["lines"].alias("lines"), a["spots"].alias("spots"), F.filter(F.transform(a["lines"], word), lambda i: i.isNotNull()).alias("full")),
            lambda b: bind(F.struct(b["lines"].alias("lines"), F.transform(b["spots"], lambda x: b["full"][x]).alias("gone")), lambda h: F.struct(h["gone"].alias("gone"), left(h).alias("text"))),
        ),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = dedup_lines(docs)
    n_gone = F.coalesce(F.size("_ln_gone"), F.lit(0)).cast("bigint")
    return out.select("doc_id", n_gone.alias("n_deleted"), "text")


_TRIM = "regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"
SQL = {
    "op2_line_dedup": f"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS i, {_TRIM} AS s FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM raw)),
f AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) AS w FROM l WHERE s <> ''),
runs AS (
  SELECT doc_id, p, 1 AS n, [i] AS lines, [s] AS c, w >= {MIN_WORDS} AS long_ FROM f
  UNION ALL SELECT x.doc_id, x.p, 2, [x.i, y.i], [x.s, y.s], x.w + y.w >= {MIN_WORDS} FROM f x JOIN f y ON y.doc_id = x.doc_id AND y.p = x.p + 1
  UNION ALL SELECT x.doc_id, x.p, 3, [x.i, y.i, z.i], [x.s, y.s, z.s], true FROM f x JOIN f y ON y.doc_id = x.doc_id AND y.p = x.p + 1 JOIN f z ON z.doc_id = x.doc_id AND z.p = x.p + 2),
firsts AS (SELECT c, min(struct_pack(d := doc_id, p := p)) AS first_ FROM runs WHERE long_ GROUP BY c HAVING count(*) > 1),
later AS (SELECT doc_id, unnest(lines) AS i FROM runs JOIN firsts USING (c) WHERE long_ AND (doc_id <> first_.d OR p >= first_.p + n)),
gone AS (SELECT DISTINCT doc_id, i FROM later),
kept AS (SELECT l0.doc_id, string_agg(l0.line, chr(10) ORDER BY l0.i) FILTER (WHERE g.i IS NULL) AS t, count(g.i) AS k
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM raw) l0 LEFT JOIN gone g ON g.doc_id = l0.doc_id AND g.i = l0.i GROUP BY l0.doc_id)
SELECT d.doc_id, coalesce(k, 0) AS n_deleted, CASE WHEN k > 0 THEN coalesce(t, '') ELSE text END AS text FROM documents d LEFT JOIN kept USING (doc_id)"""
}

QUERIES = {"op2_line_dedup": op2_line_dedup}
