"""Queries that train Spark ML models; checked by rows only (no SQL equivalent)."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from rebuyflow.catalog.common import Catalog, rounded
from rebuyflow.catalog.evaluation import FOLDS, WINDOW_DAYS
from rebuyflow.catalog.features import HORIZON, LAST_DAY, SPLIT, origins, stored_hist
from rebuyflow.catalog.schedule import AS_OF, PRODUCTION, SCHEDULE_COLUMNS, as_of, open_rows
from rebuyflow.config import RouterConfig, ScheduleConfig
from rebuyflow.functions.survival import aft_log_survival
from rebuyflow.catalog.survival import MARKS, STEP, curve, followed
from rebuyflow.operators import aft, cadence, features, forest, metrics, models, schedule, survival
from rebuyflow.operators.reports import rank_by
from rebuyflow.plans import champion, timing
from rebuyflow.plans.experiment import run_experiment
from rebuyflow.plans.stages import new_folder, stage

catalog = Catalog()
TREES = models.TreeConfig()
ROUNDS = 60
ROUTER = RouterConfig(weekly_buyer_max_gap_days=3, monitoring_days=5, minimum_group_rows=50, minimum_group_customers=10)


def enriched(spark, sf):
    return stage(features.with_split(cadence.enriched_origins(stored_hist(spark, sf)), SPLIT), "enriched")


@catalog.query("gbt_two_target")
def gbt_two_target(spark, sf):
    """Quantity and gap trees with rounds chosen on the inner split."""
    rows = stage(origins(spark, sf), "origins")
    eligible = rows.filter("role_eligible")
    out = models.two_target(eligible.filter("fit_role = 'train_core'"), eligible.filter("fit_role = 'early_stop'"), rows.filter("train_pool"),
                            eligible.filter("fit_role = 'validation'"), TREES)
    return out.select("origin_event_id", "predicted_quantity", "cart_quantity", "predicted_gap_days", "target_quantity", "target_gap_days")


@catalog.query("specialists")
def specialists(spark, sf):
    """A model per eligible cadence class with a global fallback."""
    rows = enriched(spark, sf)
    out = models.specialists(rows.filter("train_pool"), rows.filter("fit_role = 'validation' AND role_eligible"), "pair_group", TREES, ROUNDS)
    return out.select("origin_event_id", "route", "predicted_gap_days", "target_gap_days")


@catalog.query("residual_quantiles")
def residual_quantiles(spark, sf):
    """Gap quantiles around a point forecast from residuals of the early-stop rows."""
    rows = enriched(spark, sf)
    trees = models.fit_fixed(models.labelled(rows.filter("fit_role = 'train_core' AND role_eligible"), "all"), "target_gap_days", TREES, ROUNDS)
    early = models.predict_value(rows.filter("fit_role = 'early_stop' AND role_eligible"), trees, "all", "raw_gap_days")
    valid = models.predict_value(rows.filter("fit_role = 'validation' AND role_eligible"), trees, "all", "raw_gap_days")
    residuals = models.residual_quantiles(early, "raw_gap_days", "target_gap_days", "pair_group")
    return models.with_gap_quantiles(valid, residuals, "raw_gap_days", "pair_group").select(
        "origin_event_id", "pair_group", "gap_q25", "gap_q50", "gap_q75", "target_gap_days")


@catalog.query("walk_forward")
def walk_forward(spark, sf):
    """Fold-wise refit: all mature rows against pairs with regular history, scored on the same origins."""
    hist = stored_hist(spark, sf)
    rows = features.origin_table(hist).join(cadence.regularity(hist).select("origin_event_id", "status"), "origin_event_id")
    rows = stage(rows, "walk")
    every = models.walk_forward(rows, FOLDS, WINDOW_DAYS, HORIZON, TREES, ROUNDS)
    regular = models.walk_forward(rows, FOLDS, WINDOW_DAYS, HORIZON, TREES, ROUNDS, keep_training=F.col("status") == "regular", candidate="train_regular")
    repeat = models.walk_forward(rows, FOLDS, WINDOW_DAYS, HORIZON, TREES, ROUNDS, keep_training=F.col("episode_purchase_count") >= 2, candidate="train_min2")
    return every.unionByName(regular).unionByName(repeat).select("candidate", "fold", "origin_event_id", "predicted_gap_days", "cart_quantity")


@catalog.query("aft_weibull")
def aft_weibull(spark, sf):
    """Weibull survival regression per fold with seven-day purchase probability."""
    rows = stage(origins(spark, sf), "origins")
    out = None
    for fold in FOLDS:
        train = stage(survival.training_bounds(rows, [fold], WINDOW_DAYS, HORIZON), "bounds")
        valid = rows.filter(F.col("origin_on").between(F.lit(fold.origin_start), F.lit(fold.origin_end)))
        model = models.fit_aft(train)
        scored = models.predict_aft(valid, model).withColumn("fold", F.lit(fold.fold))
        scale = float(model.stages[-1].scale)
        part = scored.select("fold", "origin_event_id", "margin", (1 - F.exp(aft_log_survival(F.col("margin"), F.lit(7), "weibull", scale))).alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


@catalog.query("router_experiment")
def router_experiment(spark, sf):
    """Section report of the walk-forward router experiment over both folds."""
    rows = stage(cadence.with_routes(cadence.enriched_origins(stored_hist(spark, sf)), ROUTER), "routed-origins")
    cfg = ScheduleConfig(first_purchase="skip", second_purchase="model", router=ROUTER)
    out = run_experiment(rows, FOLDS, LAST_DAY, {"irregular": "specialist", "speeding_up": "specialist"}, WINDOW_DAYS, HORIZON, ROUNDS, cfg, TREES, "b")
    return out["report"]


FOREST = forest.ForestConfig()


def forest_rows(spark, sf):
    """Validation origins with gap quantiles from the leaves of a forest on the training pool."""
    rows = stage(features.with_product_targets(enriched(spark, sf)), "forest-rows")
    grown = forest.fit_quantile_forest(rows.filter("train_pool"), "target_gap_days", "everything", FOREST)
    return forest.with_forest_quantiles(rows.filter("fit_role = 'validation' AND role_eligible"), grown)


@catalog.query("quantile_forest")
def quantile_forest(spark, sf):
    """Gap quantiles per origin, read from leaf distributions."""
    return forest_rows(spark, sf).select("origin_event_id", "pair_group", "gap_q25", "gap_q50", "gap_q75", "target_gap_days")


@catalog.query("forest_coverage")
def forest_coverage(spark, sf):
    """Held-out share of gaps between the quartiles, per cadence class."""
    return forest.coverage(forest_rows(spark, sf), ["pair_group"], "target_gap_days")


@catalog.query("survival_candidates")
def survival_candidates(spark, sf):
    """Survival curve and fitted log-normal, log-logistic and Weibull regressions of two training windows, ranked on common landmarks."""
    rows = stage(origins(spark, sf), "origins")
    windows = {days: survival.training_bounds(rows, FOLDS, days, HORIZON).withColumn("trained", F.concat(F.lit(f"w{days}_"), "fold")) for days in (14, 10)}
    fitted = aft.fit_many(windows[14].unionByName(windows[10]), "trained")

    def by_fold(value):
        return F.coalesce(*[F.when(F.col("fold") == fold.fold, value(fold.fold)) for fold in FOLDS])

    names = {f"w{days}_aft_{kind}": (days, kind) for days in windows for kind in aft.DISTRIBUTIONS}
    located = followed(rows).withColumns({name: by_fold(lambda fold: fitted[f"w{days}_{fold}", kind].margin()) for name, (days, kind) in names.items()})
    located = located.withColumns({f"{name}_scale": by_fold(lambda fold: F.lit(fitted[f"w{days}_{fold}", kind].scale)) for name, (days, kind) in names.items()})
    marks = survival.landmarks(stage(located, "aft-margins"), MARKS, STEP)
    for days in windows:
        marks = survival.km_landmark_probability(marks, curve(rows, days), ["fold"], STEP).withColumnRenamed("probability", f"w{days}_km")
    candidates = {f"w{days}_km": F.col(f"w{days}_km") for days in windows} | {
        name: survival.aft_landmark_probability(F.col(name), kind, F.col(f"{name}_scale"), STEP) for name, (_, kind) in names.items()}
    scored = stage(survival.candidate_landmarks(marks, candidates), "survival-candidates")
    return rank_by(survival.brier_macro(scored, ["candidate"]), "landmark_customer_macro_brier")


@catalog.query("champion_schedule")
def champion_schedule(spark, sf):
    """Schedule by a stored champion: trained on the split, saved, promoted, loaded again, asked for the open origins."""
    table = stored_hist(spark, sf)
    store = champion.ModelStore(spark, new_folder(spark, "champions"))
    store.save(champion.train("champion-1", stage(features.with_split(features.origin_table(table), SPLIT), "origins"), TREES))
    store.promote("champion-1", "first version")
    loaded = store.load()
    waiting = stage(open_rows(table, as_of(AS_OF)).drop("champion_gap_days", "champion_quantity"), "waiting")
    rows = waiting.join(loaded(None, waiting, table), "origin_event_id")
    return schedule.build_schedule(rows, as_of(AS_OF), replace(PRODUCTION, model_version=loaded.version)).select("model_version", *SCHEDULE_COLUMNS)


VARIANTS = (timing.Variant("absolute_d2", 2, ROUNDS), timing.Variant("absolute_d4", 4, ROUNDS), timing.Variant("squared_d4", 4, ROUNDS, "squared"),
            timing.Variant("log_d4", 4, ROUNDS, "squared", log_target=True))


@catalog.query("timing_ranking")
def timing_ranking(spark, sf):
    """Gap rules and four learned variants over two training windows and both folds, ranked on the same origins."""
    rows = stage(features.origin_table(stored_hist(spark, sf)), "origins")
    long = timing.timing_grid(rows, FOLDS, LAST_DAY, (WINDOW_DAYS, 10), HORIZON, VARIANTS, TREES)
    return rounded(timing.rank_grid(metrics.timing_summary(long, ["candidate"], HORIZON)))
