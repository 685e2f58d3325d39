"""Transparent forecasts: pair, product or global gap medians, and the candidate grid of rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebuyflow.functions.scalars import half_up_min1


def fold_training_rows(origins: DataFrame, folds, window_days: int, horizon_days: int) -> DataFrame:
    """Mature training rows of every fold in one pass; a row may train several folds."""
    listed = F.array(*[F.struct(F.lit(f.fold).alias("fold"), F.lit(f.train_end).alias("train_end")) for f in folds])
    usable = F.filter(listed, lambda f: F.col("origin_on").between(F.date_sub(f.train_end, window_days - 1),
                                                                   F.date_sub(f.train_end, horizon_days)))
    return (origins.filter((F.col("label_state") == "observed") & F.col("target_gap_days").between(1, horizon_days))
            .withColumn("f", F.explode(usable)).select(*origins.columns, F.col("f.fold").alias("fold")))


def fit_baseline(train: DataFrame, by: str = "fold") -> DataFrame:
    """Gap median and interval count per product and overall (product NULL), for each fold.

    `percentile` keeps one counter per distinct gap and merges before the shuffle; gaps are whole days.
    """
    return (train.groupingSets([[F.col(by), F.col("product_id")], [F.col(by)]], F.col(by), F.col("product_id"))
            .agg(F.percentile("target_gap_days", F.lit(0.5)).alias("gap_median"), F.count("*").alias("interval_count"),
                 F.grouping("product_id").alias("is_global"))
            .select(by, F.when(F.col("is_global") == 0, F.col("product_id")).alias("product_id"), "gap_median", "interval_count",
                    (F.col("is_global") == 1).alias("is_global")))


def predict_baseline(rows: DataFrame, model: DataFrame, product_min_intervals: int = 5, by: str = "fold") -> DataFrame:
    """Quantity = last quantity; gap = pair median, else product median with enough intervals, else global median."""
    products = (model.filter(f"NOT is_global AND interval_count >= {int(product_min_intervals)}")
                .select(by, "product_id", F.col("gap_median").alias("product_gap")))
    overall = model.filter("is_global").select(by, F.col("gap_median").alias("global_gap"))
    # One row per fold: folds are configuration.
    joined = rows.join(products, [by, "product_id"], "left").join(F.broadcast(overall), by, "left")
    has_pair = F.col("gap_count") > 0
    gap = F.when(has_pair, F.col("gap_median_days")).otherwise(F.coalesce("product_gap", "global_gap"))
    source = F.when(has_pair, "pair").when(F.col("product_gap").isNotNull(), "product").otherwise("global")
    return (joined.withColumn("predicted_quantity", F.col("qty_last")).withColumn("predicted_gap_days", half_up_min1(gap))
            .withColumn("gap_source", source).drop("product_gap", "global_gap"))


def invalid_baseline_inputs(rows: DataFrame) -> DataFrame:
    """Rows whose counts and medians contradict each other or whose quantity is not positive."""
    return rows.filter((F.col("qty_last") <= 0) | (F.col("gap_count") < 0)
                       | ((F.col("gap_count") == 0) & F.col("gap_median_days").isNotNull())
                       | ((F.col("gap_count") > 0) & ~F.coalesce(F.col("gap_median_days") > 0, F.lit(False))))


def gap_rules() -> dict[str, Column]:
    """Named gap rules over columns predicted_gap_days (baseline), gap_last_days and recent3_gap."""
    base = F.col("predicted_gap_days")
    return {"pair_median": base,
            "last_gap": F.when(F.col("gap_count") > 0, half_up_min1(F.col("gap_last_days"))).otherwise(base),
            "recent3_gap": F.when(F.col("recent3_gap").isNotNull(), half_up_min1(F.col("recent3_gap"))).otherwise(base),
            "hybrid": hybrid_gap(base)}


def quantity_rules() -> dict[str, Column]:
    return {"last": half_up_min1(F.col("qty_last")), "median_last3": half_up_min1(F.col("qty_median_last3"))}


def hybrid_gap(model_gap: Column) -> Column:
    """Median of the last three gaps when there are three, otherwise the model."""
    return F.when(F.col("gap_count") >= 3, half_up_min1(F.col("recent3_gap"))).otherwise(model_gap)


def candidate_grid(predicted: DataFrame, learned: dict[str, Column] | None = None, prefix: str = "") -> DataFrame:
    """Long table candidate x origin: every gap rule, and every learned gap, with every quantity rule.

    The grid is a constant array exploded in the projection.
    """
    grid = [F.struct(F.lit(f"{prefix}{g}_q{q}").alias("candidate"), gap.cast("bigint").alias("gap"), qty.alias("qty"))
            for g, gap in (gap_rules() | (learned or {})).items() for q, qty in quantity_rules().items()]
    rows = predicted.withColumn("c", F.explode(F.array(*grid)))
    keep = [c for c in predicted.columns if c not in ("predicted_gap_days", "predicted_quantity")]
    return rows.select(*keep, F.col("c.candidate").alias("candidate"), F.col("c.gap").alias("predicted_gap_days"),
                       F.col("c.qty").alias("cart_quantity"))


def scored(predictions: DataFrame, outcome: Column) -> DataFrame:
    """Predictions with their outcome; targets are visible only when observed within the horizon."""
    rows = predictions.withColumn("outcome", outcome)
    observed = F.col("outcome") == "observed"
    return rows.withColumns({c: F.when(observed, F.col(c)) for c in ("target_on", "target_gap_days", "target_quantity")})
