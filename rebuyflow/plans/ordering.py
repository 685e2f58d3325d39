"""A global row position without a single-task window."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.plans.stages import stage


def with_positions(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Every row with its place (from 1) in the ascending order of `order`, absent values first.

    Rows are shuffled into ordered ranges and numbered within each; a range starts after the rows of the ranges before
    it. Only one row per range passes through a window without a key. Rows equal in `order` share a range, and their
    places among each other are open.
    """
    part = "range_of_" + name
    ranged = stage(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(part).agg(F.count("*").alias(name)).select(
        part, F.coalesce(F.sum(name).over(before), F.lit(0)).alias("rows_before_" + name))
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    numbered = ranged.withColumn(name, within).join(F.broadcast(offsets), part)  # one row per range
    return numbered.withColumn(name, F.col(name) + F.col("rows_before_" + name)).select(*rows.columns, name)
