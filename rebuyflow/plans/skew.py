"""Joins that stay balanced when one key holds a large share of the rows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebuyflow.plans.stages import stage

HOT_SHARE = 4
"""A group is hot from a quarter of an even shuffle partition on."""
FEW_FACTS = 200_000
"""Up to so many groups every task can hold the facts, and the rows need no shuffle."""
SMALL_GROUP = 10_000
"""A group of so many rows is small whatever its share."""


def balanced(rows: DataFrame, keys: list[str]) -> bool:
    """Whether no key holds a large share of the rows, so that each may be gathered in one task.

    Rows are counted per hash of the key, in 16 buckets to a hot share: a bucket holds at least the rows of each of its
    keys, so a bucket below the share proves that none of them is hot. What is shuffled is bounded by the buckets.
    """
    shares = HOT_SHARE * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(16 * shares))).agg(F.count("*").alias("n"))
    total, largest = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return largest <= max(SMALL_GROUP, total // shares)


def attach_group_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size_col: str, identity: Column,
                       hot_rows: int | None = None, how: str = "inner", stored: bool = False) -> DataFrame:
    """Give every row the facts of its group (N:1), splitting groups of `hot_rows` rows or more, if there are any.

    `facts` holds one row per key with its row count, which names the hot keys exactly. By default a group is hot when
    it exceeds its share of all rows, total / (HOT_SHARE x shuffle partitions): the hot list, which is broadcast, then
    has at most that many keys by construction. Rows of a hot key are dealt by a hash of their identity to as many
    salts as the group holds shares, so a salt never exceeds a share, and only the facts of hot keys are replicated.
    Results do not depend on which keys are hot.

    The facts are stored first, unless they are `stored` already: finding hot keys is then a filtered read of one column
    set, not a second aggregation. A few facts (at most FEW_FACTS groups, by count) are broadcast instead, unless
    `hot_rows` is given: then the rows stay where they are, however large a group is.
    """
    facts = facts if stored else stage(facts, "facts")
    added = [c for c in facts.columns if c not in keys]
    if hot_rows is None:
        groups, total, largest = facts.agg(F.count("*"), F.coalesce(F.sum(size_col), F.lit(0)), F.coalesce(F.max(size_col), F.lit(0))).first()
        if groups <= FEW_FACTS:
            few = F.broadcast(facts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *added))
            return rows.join(few, _same(keys, "_key_"), how).select(*rows.columns, *added)
        hot_rows = 1 + total // (HOT_SHARE * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        if largest < hot_rows:
            right = facts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *added)
            return rows.join(right, _same(keys, "_key_"), how).select(*rows.columns, *added)
    hot = (facts.filter(F.col(size_col) >= hot_rows)
           .select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col(size_col) / hot_rows).cast("int").alias("_salts")))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    def with_flag(df):
        return df.join(F.broadcast(hot), _same(keys, "_hot_"), "left")
    salt = F.pmod(F.xxhash64(identity), salts).cast("int")
    left = with_flag(rows).select(*rows.columns, salt.alias("_salt"))
    copies = F.sequence(F.lit(0), salts - 1)
    right = with_flag(facts).select(*[F.col(k).alias(f"_key_{k}") for k in keys], *added, F.explode(copies).alias("_key_salt"))
    joined = left.join(right, _same(keys, "_key_") & (F.col("_salt") == F.col("_key_salt")), how)
    return joined.select(*rows.columns, *added)


def _same(keys: list[str], prefix: str) -> Column:
    """Key equality in which NULL equals NULL: a group of rows without a key is a group like any other."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])
