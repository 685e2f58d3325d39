"""Memory of prediction errors between runs, and the per-pair correction drawn from it."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebuyflow.functions.scalars import count_if
from rebuyflow.operators.events import PAIR


def outcomes(previous_schedule: DataFrame, labels: DataFrame) -> DataFrame:
    """Open suggestions of the previous run whose repurchase has now been observed."""
    observed = labels.filter("label_state = 'observed'").select("origin_event_id", "target_gap_days")
    return previous_schedule.filter(F.col("status").isin("due", "scheduled")).join(observed, "origin_event_id")


def pair_errors(rows: DataFrame) -> DataFrame:
    """Error rows of observed outcomes; rows without a positive gap or without a prediction are skipped."""
    usable = rows.filter((F.col("target_gap_days") > 0) & F.col("predicted_gap_days").isNotNull())
    actual, predicted = F.col("target_gap_days").cast("bigint"), F.col("predicted_gap_days").cast("bigint")
    return usable.select("origin_event_id", *PAIR, "origin_on", predicted.alias("predicted_gap"), actual.alias("actual_gap"),
                         (actual - predicted).alias("error_days"), F.datediff("cart_on", "origin_on").cast("bigint").alias("alarm_gap"))


def upsert(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """Memory with fresh rows replacing those of the same origin; repeating a run changes nothing."""
    return memory.join(fresh.select("origin_event_id"), "origin_event_id", "left_anti").unionByName(fresh)


def median_adjustment(memory: DataFrame, cap_days: int = 7, before_on=None) -> DataFrame:
    """Median error as days to move the cart earlier: between -cap and 0, truncated toward zero."""
    rows = memory if before_on is None else memory.filter(F.col("origin_on") < F.lit(before_on).cast("date"))
    typical = F.percentile("error_days", F.lit(0.5))
    value = F.greatest(F.lit(float(-cap_days)), F.least(F.lit(0.0), typical)).cast("bigint")
    return rows.groupBy(*PAIR).agg(value.alias("adjustment_days"))


def ratchet_adjustment(memory: DataFrame, cap_days: int = 21, before_on=None, default_lead_days: int = 7) -> DataFrame:
    """Each purchase before its alarm moves later alarms earlier by the shortfall plus a day, up to the cap.

    Increments are never negative, so capping step by step equals capping the sum: order does not matter.
    """
    rows = memory if before_on is None else memory.filter(F.col("origin_on") < F.lit(before_on).cast("date"))
    alarm = F.coalesce("alarm_gap", F.greatest(F.lit(1), F.col("predicted_gap") - default_lead_days))
    shortfall = F.sum(F.when(F.col("actual_gap") < alarm, alarm - F.col("actual_gap") + 1).otherwise(0))
    return rows.groupBy(*PAIR).agg((-F.least(F.lit(cap_days), shortfall)).cast("bigint").alias("adjustment_days"))


def adjustments(memory: DataFrame, mode: str = "ratchet", cap_days: int = 21, before_on=None) -> DataFrame:
    """Non-zero corrections per pair."""
    if cap_days < 0 or mode not in ("median", "ratchet"):
        raise ValueError("Unknown mode or negative cap")
    rows = median_adjustment(memory, cap_days, before_on) if mode == "median" else ratchet_adjustment(memory, cap_days, before_on)
    return rows.filter("adjustment_days <> 0")


def memory_stats(memory: DataFrame, mode: str = "ratchet", cap_days: int = 21) -> DataFrame:
    """Errors, pairs and adjusted pairs in one row."""
    per_pair = memory.groupBy(*PAIR).agg(F.count("*").alias("errors"))
    return (per_pair.join(adjustments(memory, mode, cap_days), PAIR, "left")
            .agg(F.sum("errors").alias("errors"), F.count("*").alias("pairs"), count_if(F.col("adjustment_days").isNotNull()).alias("adjusted_pairs")))
