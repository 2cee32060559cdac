"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a session on this machine alone gets a temporary folder; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="gleaner-work-")
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what its plan has numbered by partition stays as it is, whoever reads it and however often."""
    path = f"{work_folder(df.sparkSession)}/gleaner-work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
