"""Vectors as the vector operators take them."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v double array, dim): one row per id, of vectors without null or non-finite parts and not zero.

    Rows without an id take no part. Where an id repeats, its smallest usable vector (as an array) stands for it.
    """
    v = F.col(vec_col).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.filter(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("v")).withColumn("dim", F.size("v"))


def matrix(column) -> np.ndarray:
    """Rows of a pandas column of arrays, of one length, as doubles."""
    return np.array([np.asarray(x, np.float64) for x in column], np.float64)
