"""Timing experiment: gap rules and learned gaps x training windows x quantity rules x folds, in one ranking.

All fits read one long training table keyed by (window, fold); its features are assembled and stored once. Fits do not
depend on each other, so a few run at a time: one alone leaves most of a cluster idle between its short jobs.
"""
from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.functions.scalars import half_up_min1
from rebuyflow.operators import baseline, features, models
from rebuyflow.plans.stages import stage

MODE = "base"


@dataclass(frozen=True)
class Variant:
    """One way to learn a gap, for a fixed number of rounds."""

    name: str
    depth: int
    rounds: int
    loss: str = "absolute"
    log_target: bool = False


def cell(window_days: int, fold) -> str:
    return f"w{window_days}_{fold.fold}"


def fit_cells(origins: DataFrame, folds, windows, horizon_days: int, variants, cfg: models.TreeConfig, parallel: int = 4) -> dict:
    """Trees per (cell, variant); a cell without training rows is an error."""
    keep = {cell(days, fold): features.in_training_window(fold.train_end, days, horizon_days) for days in windows for fold in folds}
    table = models.labelled(features.training_variants(origins, keep), MODE)
    filled = {row["variant"] for row in table.select("variant").distinct().collect()}  # one row per cell
    if set(keep) - filled:
        raise ValueError(f"No training rows: {', '.join(sorted(set(keep) - filled))}")

    def fit(job):
        name, variant = job
        own = replace(cfg, max_depth=variant.depth, gap_loss=variant.loss)
        return models.fit_fixed(table.filter(F.col("variant") == name), "target_gap_days", own, variant.rounds, variant.log_target)

    jobs = [(name, variant) for name in keep for variant in variants]
    return dict(zip(jobs, models.side_by_side(origins.sparkSession, fit, jobs, parallel)))


def timing_grid(origins: DataFrame, folds, data_end, windows, horizon_days: int, variants, cfg: models.TreeConfig = models.TreeConfig()) -> DataFrame:
    """Long table candidate x origin with outcomes; candidates are named w<window>_<gap>_q<quantity>.

    Besides rules and variants there is `personal_hybrid`: the median of the last three gaps where there are three, the
    first variant elsewhere. `origins` is a stored origin table with all features.
    """
    trees = fit_cells(origins, folds, windows, horizon_days, variants, cfg)
    asked = features.assign_folds(origins, folds)
    parts = []
    for days in windows:
        rules = stage(baseline.predict_baseline(asked, baseline.fit_baseline(baseline.fold_training_rows(origins, folds, days, horizon_days))), "rules")
        for fold in folds:
            rows = rules.filter(F.col("fold") == fold.fold)
            rows = models.predict_values(rows, {f"raw_{variant.name}": (trees[cell(days, fold), variant], variant.log_target) for variant in variants}, MODE)
            learned = {variant.name: half_up_min1(F.col(f"raw_{variant.name}")) for variant in variants}
            learned["personal_hybrid"] = baseline.hybrid_gap(learned[variants[0].name])
            parts.append(baseline.candidate_grid(rows, learned, f"w{days}_").drop(*[f"raw_{variant.name}" for variant in variants]))
    return stage(baseline.scored(reduce(lambda a, b: a.unionByName(b), parts), features.horizon_outcome(data_end, horizon_days)), "timing-grid")


def rank_grid(summary: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Candidates at least as good on quantity as the pair median of their own window, best timing first.

    The summary has one row per candidate, so the ordered window is over a short table.
    """
    guard = F.concat(F.substring_index("candidate", "_", 1), F.lit("_pair_median_qlast"))
    least = summary.select(F.col("candidate").alias("guard"), F.col("quantity_within_1_rate").alias("least"))
    passed = summary.withColumn("guard", guard).join(least, "guard").filter(F.col("quantity_within_1_rate") + tolerance >= F.col("least"))
    best = Window.orderBy(F.round("customer_macro_date_mae", 9), F.round("date_mae", 9), F.round("quantity_within_1_rate", 9).desc(), "candidate")
    return passed.select(F.row_number().over(best).alias("rank"), "candidate", "customer_macro_date_mae", "date_mae", "quantity_within_1_rate")
