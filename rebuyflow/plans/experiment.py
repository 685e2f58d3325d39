"""Walk-forward experiment: champion refit per fold, specialists per cadence class, guard, weekly carts, reports."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebuyflow.config import ScheduleConfig
from rebuyflow.functions.calendar import weekly_cart
from rebuyflow.functions.scalars import half_up_min1
from rebuyflow.operators import models, quality, reports
from rebuyflow.operators.cadence import group_eligibility
from rebuyflow.operators.features import horizon_outcome, training_window
from rebuyflow.operators.schedule import choose_gap, relative_iqr
from rebuyflow.plans.stages import stage


def champion_forecast(train: DataFrame, valid: DataFrame, cfg: models.TreeConfig, rounds: int) -> DataFrame:
    """Gap and quantity of the single-model champion refit on the fold's training rows."""
    train = models.labelled(train, "base")
    targets = {"champion_gap_days": "target_gap_days", "champion_quantity": "target_quantity"}
    fitted = models.side_by_side(train.sparkSession, lambda name: models.fit_fixed(train, targets[name], cfg, rounds), targets)
    valid = models.predict_values(valid, {name: (trees, False) for name, trees in zip(targets, fitted)}, "base")
    return valid.withColumns({name: half_up_min1(F.col(name)) for name in targets})


def agent_forecast(train: DataFrame, valid: DataFrame, routes: dict[str, str], cfg: models.TreeConfig, rounds: int,
                   minimum_rows: int, minimum_customers: int) -> DataFrame:
    """Agent gap, quantity and relative spread for routed classes with enough training data; NULL elsewhere.

    Residuals come from rows their model has not seen: it is fitted on the earlier rows of the window and meets the
    later quarter; the forecast itself uses a model of all rows.
    """
    train = models.labelled(train, "all")
    enough = group_eligibility(train, "route_group", minimum_rows, minimum_customers).filter("eligible").collect()  # one row per class
    served = sorted({r["customer_group"] for r in enough} & {g for g, agent in routes.items() if agent != "champion"})
    none = {"agent_gap_days": F.lit(None).cast("bigint"), "agent_quantity": F.lit(None).cast("bigint"), "relative_iqr": F.lit(None).cast("double")}
    parts = [valid.filter(~models.among(F.col("route_group"), served)).withColumns(none)]
    own = {group: train.filter(F.col("route_group") == group) for group in served}
    later = {group: F.unix_date("origin_on") > rows.agg(F.percentile(F.unix_date("origin_on"), F.lit(0.75))).first()[0] for group, rows in own.items()}
    wanted = {"probe": "target_gap_days", "gap": "target_gap_days", "quantity": "target_quantity"}

    def fit(job):
        group, kind = job
        rows = own[group].filter(~later[group]) if kind == "probe" else own[group]
        return models.fit_fixed(rows, wanted[kind], cfg, rounds, specialist=True)

    jobs = [(group, kind) for group in served for kind in wanted]
    trees = dict(zip(jobs, models.side_by_side(train.sparkSession, fit, jobs)))
    for group in served:
        unseen = trees[group, "probe"].transform(own[group].filter(later[group])).withColumnRenamed("prediction", "raw_gap")
        residuals = models.residual_quantiles(unseen, "raw_gap", "target_gap_days", "route_group")
        rows = models.predict_values(valid.filter(F.col("route_group") == group), {"raw_gap": (trees[group, "gap"], False), "raw_quantity": (trees[group, "quantity"], False)}, "all")
        rows = models.with_gap_quantiles(rows, residuals, "raw_gap", "route_group")
        parts.append(rows.withColumn("agent_gap_days", half_up_min1(F.col("gap_q50"))).withColumn("agent_quantity", half_up_min1(F.col("raw_quantity")))
                     .withColumn("relative_iqr", relative_iqr(F.col("gap_q25"), F.col("gap_q50"), F.col("gap_q75"))).select(*parts[0].columns))
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_experiment(origins: DataFrame, folds, data_end, routes: dict[str, str], window_days: int, horizon_days: int, rounds: int,
                   cfg: ScheduleConfig = ScheduleConfig(first_purchase="skip", second_purchase="model"),
                   trees: models.TreeConfig = models.TreeConfig(), confirm_from: str | None = None) -> dict[str, DataFrame]:
    """Router against champion over all folds.

    `origins` is the stored, enriched and routed origin table. Returns the long records of both candidates, the section
    report, the acceptance row and the routing report.
    """
    router = cfg.router

    def forecast(fold):
        train = stage(training_window(origins, fold.train_end, window_days, horizon_days), f"train-{fold.fold}")
        valid = origins.filter(F.col("origin_on").between(F.lit(fold.origin_start), F.lit(fold.origin_end)))
        quality.enforce({f"overlap {fold.fold}": quality.overlap(train, valid, "origin_event_id"), f"leak {fold.fold}": quality.leaks(train, valid)})
        rows = agent_forecast(train, champion_forecast(train, valid, trees, rounds), routes, trees, rounds, router.minimum_group_rows, router.minimum_group_customers)
        return choose_gap(rows, cfg, routes, "specialist_sample_insufficient").withColumn("fold", F.lit(fold.fold))

    parts = models.side_by_side(origins.sparkSession, forecast, folds, 2)
    hour, limit = router.weekly_release_hour, router.weekly_buyer_max_gap_days
    routed = reduce(lambda a, b: a.unionByName(b), parts).withColumn("outcome", horizon_outcome(data_end, horizon_days))
    observed = F.col("outcome") == "observed"
    routed = routed.withColumns({c: F.when(observed, F.col(c)) for c in ("target_on", "target_gap_days", "target_quantity")})
    routed = stage(routed, "routed")
    # Both candidates are one projection of the same row.
    versions = F.array(F.struct(F.lit("router").alias("candidate"), F.col("predicted_gap_days").alias("gap")),
                       F.struct(F.lit("champion").alias("candidate"), F.col("champion_gap_days").alias("gap")))
    records = (routed.withColumn("v", F.explode(versions)).drop("predicted_gap_days")
               .withColumn("candidate", F.col("v.candidate")).withColumn("predicted_gap_days", F.col("v.gap")).drop("v")
               .withColumn("cart_at", weekly_cart(F.col("origin_on"), F.col("predicted_gap_days"), hour, limit)))
    records = stage(records, "records")
    suggested = records.filter("suggest")
    dimensions = {"group": F.col("route_group"), "stage": F.col("purchase_stage"), "fold": F.col("fold")}
    if confirm_from is not None:
        dimensions["period"] = F.when(F.col("fold") >= confirm_from, "confirm").otherwise("select")
    report = stage(reports.section_report(suggested, dimensions, limit, router.monitoring_days), "report")
    routing = reports.routing_report(suggested.filter("candidate = 'router'").withColumn("reason", F.col("fallback_reason")))
    return {"records": records, "report": report, "acceptance": reports.acceptance(report, "router", "champion"), "routing": routing}
