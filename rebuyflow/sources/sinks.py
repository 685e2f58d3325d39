"""Writes. Nothing overwrites a table it has read; every daily table gets a new path."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_new(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet to a path that must not exist, and read it back: later stages start from stored data."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_new_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_role_tables(origins: DataFrame, path: str) -> None:
    """Origins by fit role, plus the overlapping training pool as its own table.

    `role` repartitions nothing: each task writes its rows into the role folders.
    """
    origins.write.mode("errorifexists").partitionBy("fit_role").parquet(f"{path}/origins")
    origins.filter("train_pool").write.mode("errorifexists").parquet(f"{path}/train_pool")


# Columns of the published table.
PUBLISHED = ("suggestion_key", "customer_id", "product_id", "cart_at", "cart_quantity", "predicted_repurchase_on",
             "status", "customer_group", "purchase_stage", "model_version", "ab_group")


def publishable(schedule: DataFrame) -> DataFrame:
    """Open suggestions in the published projection."""
    return schedule.filter("status <> 'closed'").select(*PUBLISHED)


def merge_published(existing: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Keyed overwrite: fresh rows replace those with the same key, all other rows stay."""
    if existing is None:
        return fresh
    return existing.join(fresh.select("suggestion_key"), "suggestion_key", "left_anti").unionByName(fresh)


def publish(spark, schedule: DataFrame, previous_path: str | None, new_path: str, batch_run_at) -> DataFrame:
    """Write the merged published table to a new path (the previous one stays readable)."""
    fresh = publishable(schedule).withColumn("batch_run_at", F.lit(batch_run_at).cast("timestamp"))
    existing = spark.read.parquet(previous_path) if previous_path else None
    return write_new(merge_published(existing, fresh), new_path)


def append_published(schedule: DataFrame, path: str, batch_run_at) -> None:
    """Append variant: every run adds its rows."""
    publishable(schedule).withColumn("batch_run_at", F.lit(batch_run_at).cast("timestamp")).write.mode("append").parquet(path)
