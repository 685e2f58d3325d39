"""Learned candidates x windows x folds: same cohorts for all, rules as without them, fits as on their own."""
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rebuyflow.catalog.evaluation import FOLDS, WINDOW_DAYS, grid, predictions
from rebuyflow.catalog.features import HORIZON, LAST_DAY, hist
from rebuyflow.functions.scalars import half_up_min1
from rebuyflow.operators import features, metrics, models, reports
from rebuyflow.plans import timing
from rebuyflow.plans.stages import stage

SF = "/root/testdata/sf0.001"
SMALL = models.TreeConfig(min_instances=2)
VARIANTS = (timing.Variant("absolute_d2", 2, 3), timing.Variant("squared_d3", 3, 3, "squared"), timing.Variant("log_d3", 3, 3, "squared", True))
WINDOWS = (WINDOW_DAYS, 10)


@pytest.fixture(scope="module")
def origins(spark):
    return stage(features.origin_table(stage(hist(spark, SF), "history")), "origins")


@pytest.fixture(scope="module")
def long(origins):
    return timing.timing_grid(origins, FOLDS, LAST_DAY, WINDOWS, HORIZON, VARIANTS, SMALL)


def test_every_candidate_is_scored_on_the_same_origins(long):
    counts = long.groupBy("candidate").agg(F.count("*").alias("n"), F.countDistinct("origin_event_id", "fold").alias("d")).collect()
    assert len(counts) == 2 * (4 + 3 + 1) * 2 and len({(r["n"], r["d"]) for r in counts}) == 1
    assert all(r["n"] == r["d"] for r in counts)


def test_rules_score_as_without_learned_candidates(spark, long):
    alone = metrics.timing_summary(stage(grid(predictions(spark, SF)), "scored"), ["candidate"], HORIZON).withColumn("candidate", F.concat(F.lit(f"w{WINDOW_DAYS}_"), "candidate"))
    got = metrics.timing_summary(long, ["candidate"], HORIZON).join(alone.select("candidate"), "candidate", "left_semi")
    columns = ["candidate", "origins", "n", "date_mae", "quantity_within_1_rate", "customer_macro_date_mae"]
    mine = {r["candidate"]: r for r in got.collect()}
    rows = alone.collect()
    assert len(rows) == len(mine) == 8
    for row in rows:
        assert [mine[row["candidate"]][name] for name in columns[1:]] == pytest.approx([row[name] for name in columns[1:]])


def test_a_cell_is_fitted_as_on_its_own(origins, long):
    fold, days, variant = FOLDS[1], WINDOWS[1], VARIANTS[2]
    own = models.labelled(features.training_window(origins, fold.train_end, days, HORIZON), "base")
    trees = models.fit_fixed(own, "target_gap_days", replace(SMALL, max_depth=variant.depth, gap_loss=variant.loss), variant.rounds, log_target=True)
    rows = origins.filter(F.col("origin_on").between(F.lit(fold.origin_start), F.lit(fold.origin_end)))
    alone = models.predict_value(rows, trees, "base", "raw", log_target=True).select("origin_event_id", half_up_min1(F.col("raw")).alias("gap"))
    there = long.filter((F.col("candidate") == f"w{days}_log_d3_qlast") & (F.col("fold") == fold.fold)).select("origin_event_id", F.col("predicted_gap_days").alias("gap"))
    assert there.count() == alone.count() > 0
    assert there.join(alone.withColumnRenamed("gap", "own"), "origin_event_id").filter("abs(gap - own) > 1").isEmpty()


def test_ranking_keeps_the_guardrail_of_each_window(spark, long):
    summary = metrics.timing_summary(long, ["candidate"], HORIZON)
    ranked = timing.rank_grid(summary).orderBy("rank").collect()
    rates = {r["candidate"]: r["quantity_within_1_rate"] for r in summary.collect()}
    for row in ranked:
        assert rates[row["candidate"]] + 1e-9 >= rates[row["candidate"].split("_")[0] + "_pair_median_qlast"]
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    scores = [round(r["customer_macro_date_mae"], 9) for r in ranked]
    assert scores == sorted(scores)
    one = summary.filter(F.col("candidate").startswith(f"w{WINDOW_DAYS}_"))
    assert [tuple(r) for r in timing.rank_grid(one).select("rank", "candidate").collect()] == [
        tuple(r) for r in reports.rank_candidates(one, f"w{WINDOW_DAYS}_pair_median_qlast").select("rank", "candidate").collect()]


def test_an_empty_training_window_is_an_error(origins):
    with pytest.raises(ValueError, match="No training rows"):
        timing.fit_cells(origins, FOLDS, (HORIZON - 1,), HORIZON, VARIANTS[:1], SMALL)
