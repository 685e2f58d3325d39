"""Scans. Parquet between stages; CSV only at the edges, always with an explicit header."""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebuyflow.functions.calendar import within_local_days

CORRUPT = "_corrupt_record"


def read_text_csv(spark: SparkSession, path: str, header, strict: bool = True, multiline: bool = True) -> DataFrame:
    """All-string CSV with an exact header. Strict mode fails on a malformed record; otherwise it is kept and flagged.

    Line breaks inside quoted fields are legal, so each file is read in one task. Where every record is known to be one
    line, `multiline=False` splits the files among tasks at line ends.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    reader = (spark.read.option("header", True).option("enforceSchema", False).option("multiLine", multiline)
              .option("escape", '"').option("encoding", "UTF-8"))
    if strict:
        return reader.option("mode", "FAILFAST").schema(schema).csv(path)
    flagged = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .schema(flagged).csv(path))


def corrupt_rows(flagged: DataFrame) -> DataFrame:
    """Records whose width differs from the header."""
    return flagged.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def empty_as_null(df: DataFrame) -> DataFrame:
    """Blank text becomes NULL in every string column."""
    return df.select(*[F.when(F.trim(F.col(f.name)) != "", F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def without_contacts(legacy: DataFrame) -> DataFrame:
    """Legacy export without name and contact columns."""
    return legacy.drop("고객명", "연락처")


def orders_in_window(orders: DataFrame, start: date, end: date, time_col: str = "wtime") -> DataFrame:
    """Orders placed on local days start..end inclusive; the range of instants reaches the scan."""
    return orders.filter(within_local_days(F.col(time_col), start, end))


def shard(df: DataFrame, key: str, shards: int, index: int) -> DataFrame:
    """Hash-disjoint share of a table: the same key always falls into the same shard."""
    if not 0 <= index < shards:
        raise ValueError("Shard index out of range")
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("bigint")
    return df.filter(F.pmod(number, F.lit(shards)) == index)


def read_store_rhythm(spark: SparkSession, path: str) -> DataFrame:
    """External per-pair forecast; rows without a cart day are ignored, the last row of a pair in the file is kept."""
    raw = spark.read.option("header", True).csv(path)
    rows = empty_as_null(raw.select("*", file_place().alias("place")))
    typed = rows.select("customer_id", "product_id", F.to_date("cart_on").alias("cart_on"),
                        F.col("cart_quantity").cast("double").cast("bigint").alias("cart_quantity"), "place")
    return one_rhythm_per_pair(typed, "place")


def file_place() -> Column:
    """Where a row of a text file stands: file, start of its split, and the row's number in the task that reads the split.

    Must be selected straight from the scan. A task reads a split front to back, so places of one file order its rows.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("row"))


def one_rhythm_per_pair(rows: DataFrame, place: str | None = None) -> DataFrame:
    """One row per pair: the last by `place`, or without a place (a table has no order) the latest cart day."""
    kept = F.struct("cart_on", "cart_quantity")
    last = F.max(kept) if place is None else F.max_by(kept, F.col(place))
    return (rows.filter(F.col("cart_on").isNotNull()).groupBy("customer_id", "product_id").agg(last.alias("kept"))
            .select("customer_id", "product_id", "kept.cart_on", "kept.cart_quantity"))
