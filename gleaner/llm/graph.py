"""Connected components and salted joins, for graphs with hubs of any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, release

SALTS = 16
#: Rows of the small side that may be broadcast.
MOST_BROADCAST = 200_000


def salted_join(rows: DataFrame, few: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """Join rows to one row per key of ``few``: broadcast behind a check of its number of rows,
    else by shuffle, where the rows of a hot key spread over SALTS tasks by a hash of ``spread``."""
    if few.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(few), on, how)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right.hint("shuffle_hash"), [*on, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: bigint) to (node, label): the label is the least node of the component.

    Contraction: every node joins the least of its neighbours and itself, edges move to the joined
    nodes, loops and repeats go, until no edge is left. Nodes without an edge have no row."""
    spark = edges.sparkSession
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joins = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "cc-joins")
        moved = salted_join(edges, joins, ["a"], ["b"]).select(F.col("to").alias("x"), "b")
        moved = salted_join(moved, joins.withColumnsRenamed({"a": "b", "to": "y"}), ["b"], ["x"]).select("x", "y")
        after = materialize(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        if labels is None:
            new = joins.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            new = salted_join(labels.withColumnRenamed("label", "a"), joins, ["a"], ["node"], "left").select("node", F.coalesce("to", "a").alias("label"))
            new = materialize(new, "cc-labels")
            release(labels)
            release(joins)
        release(edges)
        labels, edges = new, after
    release(edges)
    if labels is None:
        return spark.createDataFrame([], "node bigint, label bigint")
    return labels
