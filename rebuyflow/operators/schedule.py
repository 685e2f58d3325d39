"""Cart suggestions: one row per open pair, from routed forecasts to release time and status."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebuyflow.config import RouterConfig, ScheduleConfig
from rebuyflow.functions import calendar
from rebuyflow.functions.scalars import ab_group, half_even, half_up_min1, list_key
from rebuyflow.operators.events import PAIR


def open_origins(origins: DataFrame, as_of: Column) -> DataFrame:
    """Latest purchase of each pair without a following event, complete by the given local time."""
    return origins.filter((F.col("label_state") == "right_censored") & (calendar.next_midnight(F.col("origin_on")) <= as_of))


def relative_iqr(q25: Column, q50: Column, q75: Column) -> Column:
    return (q75 - q25) / F.greatest(q50, F.lit(1.0))


def guard(agent_gap: Column, champion_gap: Column, iqr: Column, cfg: RouterConfig, missing_reason: Column) -> Column:
    """struct(gap, reason): the champion's gap when the agent is missing, too uncertain, or (if guarded) later."""
    uncertain = F.coalesce(iqr > cfg.max_relative_iqr, F.lit(False))
    later = F.lit(cfg.late_guard) & (agent_gap > champion_gap)
    reason = (F.when(agent_gap.isNull(), missing_reason).when(uncertain, "high_uncertainty")
              .when(later, "later_than_champion"))
    return F.struct(F.when(reason.isNull(), agent_gap).otherwise(champion_gap).alias("gap"), reason.alias("reason"))


def purchase_rule(pair_count: Column, pair_gap_lag1: Column, group: Column, cfg: RouterConfig) -> dict[str, Column]:
    """Stage by number of purchases since the last hold, whether to suggest, and the fixed gap of second purchases."""
    purchases = pair_count + 1
    stage = (F.when(purchases == 1, "first").when(purchases == 2, "second")
             .when(group == "insufficient", "third_fourth").otherwise("cadence"))
    fixed = F.when((purchases == 2) & F.lit(cfg.second_purchase_last_gap), half_up_min1(pair_gap_lag1))
    return {"purchase_stage": stage, "suggest": (purchases > 1) | F.lit(not cfg.skip_first_purchase), "fixed_gap": fixed}


def short_history(stage: Column, model_gap: Column, item_gap_median: Column, pair_gap_lag1: Column, cfg: ScheduleConfig) -> Column:
    """struct(gap, agent) overriding first and second purchases, NULL where the normal flow stays."""
    first = stage == "first" if cfg.first_purchase == "item_median" else F.lit(False)
    second = stage == "second" if cfg.second_purchase == "last_gap" else F.lit(False)
    def whole(x):
        return F.greatest(F.lit(1), half_even(x)).cast("bigint")
    def choice(gap, agent):
        return F.struct(gap.cast("bigint").alias("gap"), F.lit(agent).alias("agent"))
    return (F.when(first & item_gap_median.isNotNull(), choice(whole(item_gap_median), "first_purchase_item_median"))
            .when(first, choice(model_gap, "first_purchase_model_fallback"))
            .when(second, choice(whole(pair_gap_lag1), "second_purchase_last_gap")))


def choose_gap(rows: DataFrame, cfg: ScheduleConfig, routes: dict[str, str] | None = None, no_agent: str = "specialist_unavailable") -> DataFrame:
    """Gap, stage and agent of every row.

    Needs champion_gap_days, champion_quantity, route_group, pair_count, pair_gap_lag1 and item_gap_median;
    agent_gap_days, agent_quantity and relative_iqr may be NULL. `routes` names the agent per class, `no_agent` the reason where its forecast is missing.
    """
    named = F.lit("champion")
    if routes:
        named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in routes.items() for x in pair]), F.col("route_group")), named)
    missing = F.when(named == "champion", "routed_to_champion").otherwise(no_agent)
    rule = purchase_rule(F.col("pair_count"), F.col("pair_gap_lag1"), F.col("route_group"), cfg.router)
    rows = rows.withColumn("agent", named).withColumns(rule).withColumn(
        "guarded", guard(F.col("agent_gap_days"), F.col("champion_gap_days"), F.col("relative_iqr"), cfg.router, missing))
    rows = rows.withColumn("override", short_history(F.col("purchase_stage"), F.col("champion_gap_days"), F.col("item_gap_median"),
                                                     F.col("pair_gap_lag1"), cfg))
    override, fixed = F.col("override"), F.col("fixed_gap")
    simple = override.isNotNull() | fixed.isNotNull()
    reason = F.when(~simple, F.col("guarded.reason"))
    return (rows.withColumn("predicted_gap_days", F.coalesce(override.gap, fixed, F.col("guarded.gap")).cast("bigint"))
            .withColumn("selected_agent", F.coalesce(override.agent, F.when(fixed.isNotNull(), "second_purchase_last_gap"), "agent"))
            .withColumn("suggest", F.col("suggest") | override.isNotNull())
            .withColumn("fallback_reason", reason).withColumn("fallback_agent", F.when(reason.isNotNull(), "champion"))
            .withColumn("router_quantity", F.when(simple | reason.isNotNull(), F.col("champion_quantity")).otherwise(F.col("agent_quantity")))
            .drop("agent", "guarded", "override", "fixed_gap"))


def build_schedule(rows: DataFrame, as_of: Column, cfg: ScheduleConfig = ScheduleConfig(), adjustments: DataFrame | None = None,
                   rhythm: DataFrame | None = None, routes: dict[str, str] | None = None) -> DataFrame:
    """Schedule of open origins as of a local time.

    Corrections and the external rhythm are one row per pair and join on the pair; a pair has one open origin, so
    neither join can be skewed.
    """
    chosen = choose_gap(rows, cfg, routes)
    if adjustments is not None:
        chosen = chosen.join(adjustments, PAIR, "left")
    if rhythm is not None:
        chosen = chosen.join(rhythm.select(*PAIR, F.col("cart_on").alias("store_rhythm_on"), F.col("cart_quantity").alias("rhythm_quantity")), PAIR, "left")
    for name, kind in (("adjustment_days", "bigint"), ("store_rhythm_on", "date"), ("rhythm_quantity", "bigint")):
        if name not in chosen.columns:
            chosen = chosen.withColumn(name, F.lit(None).cast(kind))
    suggest, gap, origin = F.col("suggest"), F.col("predicted_gap_days"), F.col("origin_on")
    zero = F.lit(0).cast("bigint")
    lead = calendar.extra_lead(gap, cfg.lead_policy, cfg.base_lead_days)
    rows = (chosen.withColumn("pair_adjustment_days", F.when(suggest, F.coalesce("adjustment_days", zero)).otherwise(zero))
            .withColumn("extra_lead", F.when(suggest, lead).otherwise(zero))
            .withColumn("scheduled_gap_days", F.greatest(F.lit(1), gap + F.col("pair_adjustment_days") - F.col("extra_lead"))))
    hour, scheduled = cfg.router.weekly_release_hour, F.col("scheduled_gap_days")
    if cfg.schedule == "days_before":
        cart_on = calendar.days_before(origin, scheduled, cfg.base_lead_days)
        rows = rows.withColumn("cart_on", cart_on).withColumn("cart_at", calendar.at_hour(F.col("cart_on"), cfg.notify_hour))
    else:
        rows = rows.withColumn("cart_at", calendar.weekly_cart(origin, scheduled, hour, cfg.router.weekly_buyer_max_gap_days))
        rows = rows.withColumn("cart_on", calendar.order_day(F.col("cart_at")))
    pull = calendar.pull_forward(F.col("cart_on"), F.col("cart_at"), F.col("store_rhythm_on"), calendar.next_midnight(origin), hour, cfg.max_pull_days)
    rows = rows.withColumn("pull", F.when(suggest & F.col("store_rhythm_on").isNotNull(), pull))
    rows = (rows.withColumn("cart_on", F.coalesce("pull.cart_on", "cart_on")).withColumn("cart_at", F.coalesce("pull.cart_at", "cart_at"))
            .withColumn("store_rhythm_pulled", F.coalesce("pull.pulled", F.lit(False)))
            .withColumn("monitor_until", F.date_add(origin, F.greatest(F.lit(cfg.router.monitoring_days), gap + 7).cast("int"))))
    status = (F.when(~suggest, "no_suggestion_first_purchase").when(as_of.cast("date") > F.col("monitor_until"), "closed")
              .when(F.col("cart_at") <= as_of, "due").otherwise("scheduled"))
    rhythm_quantity = F.when(F.col("rhythm_quantity") != 0, F.col("rhythm_quantity"))
    return rows.select(
        list_key(F.col("customer_id"), F.col("product_id"), F.col("origin_event_id")).alias("suggestion_key"), *PAIR, "origin_event_id",
        "origin_on", F.col("route_group").alias("customer_group"), ab_group(F.col("customer_id")).alias("ab_group"), F.lit(cfg.model_version).alias("model_version"),
        "purchase_stage", "selected_agent", "fallback_agent", "predicted_gap_days",
        F.date_add(origin, gap.cast("int")).alias("predicted_repurchase_on"), "pair_adjustment_days",
        (F.lit(cfg.base_lead_days) + F.col("extra_lead")).alias("lead_days"), "scheduled_gap_days", "store_rhythm_on", "store_rhythm_pulled",
        F.coalesce(rhythm_quantity, F.col("router_quantity")).alias("cart_quantity"), "router_quantity", "cart_on", "cart_at", "monitor_until",
        status.alias("status"), "route_confidence", "route_changed",
        F.coalesce("fallback_reason", F.concat_ws("_", "route_group", F.lit(cfg.router.route_unit))).alias("reason"))
