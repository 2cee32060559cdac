"""Sources: articles, article maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.html import article_text
from gleaner.sources.work import written

MISSING = "ERROR: COULD NOT LOCATE ARTICLE AT "
INVALID = "Unable to parse invalid article: "
#: Results whose documents are broadcast; beyond, the planner joins by shuffle.
MOST_BROADCAST = 200_000


def read_articles(spark: SparkSession, paths: str | list[str], glob: str = "*.html") -> DataFrame:
    """(doc: path, html: whole file)."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(paths)
    return rows.select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("html"))


def parse_articles(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """(doc, text) of the pages that can be parsed."""
    return pages.select(F.col(doc).alias("doc"), article_text(F.col(html)).alias("text")).filter(F.col("text").isNotNull())


def read_article_map(spark: SparkSession, path: str, data_dir: str = "./data/") -> DataFrame:
    """(title, path) of a map from titles to structs with a path; ``data_dir`` is cut off the paths; without links between articles ("_to_")."""
    raw = spark.read.option("wholetext", True).text(path)
    parsed = raw.select(F.explode(F.from_json("value", "map<string, struct<path: string>>")).alias("title", "at"))
    return parsed.select("title", F.replace(F.col("at.path"), F.lit(data_dir), F.lit("")).alias("path")).filter(F.col("path").isNotNull() & ~F.col("path").contains("_to_")).orderBy("path")


def existing(paths: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose ``path`` is listed."""
    return paths.join(listed.select("path").distinct(), "path", "left_semi")


def attach_text(results: DataFrame, texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Results with the text of each hit, or what says that it is missing. Results are written first: if they are
    few, only the texts that they name are joined, and the others aren't shuffled."""
    results = written(results, "results")
    named = texts.select(F.col(doc), F.col(text).alias("text"), F.lit(True).alias("_there"))
    if results.count() <= MOST_BROADCAST:
        named = named.join(F.broadcast(results.select(doc).distinct()), doc, "left_semi")
    joined = results.join(named, doc, "left")
    shown = F.when(F.col("_there").isNull(), F.concat(F.lit(MISSING), F.col(doc).cast("string"))).otherwise(F.coalesce("text", F.concat(F.lit(INVALID), F.col(doc).cast("string"))))
    return joined.withColumn("text", shown).drop("_there")


def isolate_redirects(pages: DataFrame, redirect: Column) -> DataFrame:
    """The hashes of redirect pages."""
    return pages.select(redirect.alias("sha1")).filter(F.col("sha1").isNotNull())
