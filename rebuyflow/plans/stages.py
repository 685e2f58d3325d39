"""Stored intermediate tables: computed once, read by every later step, and safe when executors are lost."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def stage_folder(spark: SparkSession) -> str:
    """The shared folder named in `spark.checkpoint.dir`; a temporary one only in local mode without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the stage folder.

    A run's stages lie under its application id, so whoever keeps the folder can drop a finished run's as one.
    """
    return f"{stage_folder(spark)}/rebuyflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the stage folder and return it read back.

    Later steps see file statistics (so joins are chosen by real size) and read only the columns they use; the plan
    behind the table is not repeated per consumer. Digests are most of a stored row: zstd halves their hex text, which the
    default codec cannot.
    """
    path = new_folder(df.sparkSession, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

