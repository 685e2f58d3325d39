"""What the operators share: reading the given tables, unique keys, and names that never clash with a caller's columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 500
"""Rows of text in an Arrow batch: some documents are very long, and a worker holds a batch or two at once."""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds, by rows and by bytes, so that long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body): the two columns an operator works on; a null text is an empty one."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(text.cast("string").cast("binary"))


def named(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")



def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: names that no operator's own columns clash with, also where some are equal or hold dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
