"""The daily batch: orders to published suggestions, every stage stored under a new run folder."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebuyflow.config import CadenceConfig, ScheduleConfig
from rebuyflow.functions.scalars import packed_id, unpacked_id
from rebuyflow.operators import baseline, cadence, events, features, feedback, ingest, policy, quality, reports, schedule
from rebuyflow.sources.sinks import write_new

HISTORY_START = date(2024, 10, 2)


@dataclass(frozen=True)
class DailyInputs:
    """Source tables of one run; everything but the web orders is optional."""

    order_versions: DataFrame
    app_orders: DataFrame | None = None
    product_exclusions: DataFrame | None = None
    product_list_version: str | None = None
    customer_exclusions: DataFrame | None = None
    store_rhythm: DataFrame | None = None
    previous_schedule: DataFrame | None = None
    error_memory: DataFrame | None = None


def baseline_forecast(origins: DataFrame, waiting: DataFrame, hist: DataFrame) -> DataFrame:
    """Default forecast: pair, product or global gap median fitted on all observed labels (`hist` is not needed)."""
    model = baseline.fit_baseline(origins.filter("label_state = 'observed'").withColumn("fold", F.lit("all")))
    rows = baseline.predict_baseline(waiting.withColumn("fold", F.lit("all")), model)
    return rows.select("origin_event_id", F.col("predicted_gap_days").alias("champion_gap_days"),
                       F.col("predicted_quantity").alias("champion_quantity"))


def clean_items(inputs: DailyInputs, as_of: datetime, out: str, history_start: date = HISTORY_START) -> DataFrame:
    """Extract up to the day before, check, quarantine; the kept item rows."""
    items = write_new(ingest.extract_items(inputs.order_versions, history_start, as_of.date() - timedelta(days=1), inputs.app_orders),
                      f"{out}/items")
    quality.enforce({
        "repeated_section_item": quality.repeated(items, ["order_id", "order_section_item_no"]),
        "repeated_position": quality.repeated(items, ["order_id", "section_position", "item_position"]),
        "bad_quantity": quality.bad_quantity(items), "time": quality.time_errors(items),
        "order_identity": quality.conflicting(items, ["order_id"], ["customer_id", "ordered_at", "ordered_on"])})
    identity = F.concat_ws("|", "order_id", "order_section_item_no")
    checked = write_new(ingest.quarantine(items, identity), f"{out}/quarantined")
    return checked.filter("quarantine_reason IS NULL").drop("quarantine_reason")


def build_events(items: DataFrame, inputs: DailyInputs, out: str) -> DataFrame:
    """Policy rows and daily events, reconciled with each other."""
    for exclusions, version in ((inputs.product_exclusions, inputs.product_list_version),
                                (inputs.customer_exclusions, "test-account-exclusions-v1")):
        if exclusions is not None:
            quality.enforce({"exclusion_list": policy.disallowed_exclusions(exclusions, version)})
    version = policy.policy_version(inputs.product_list_version, inputs.customer_exclusions is not None)
    identity = F.concat_ws("|", "order_id", "order_section_item_no")
    packed = items.withColumn("item_json_sha256", packed_id(F.col("item_json_sha256")))
    rows = write_new(policy.apply_policy(packed, identity, inputs.product_exclusions, inputs.customer_exclusions, version)
                     .withColumn("item_json_sha256", unpacked_id(F.col("item_json_sha256"))), f"{out}/policy")
    made = write_new(events.day_states(rows, stored=True), f"{out}/events")
    links = write_new(events.row_disposition(rows, made, identity, stored=True)
                      .select("order_id", "order_section_item_no", "event_id", "row_disposition", "event_quantity_contribution"), f"{out}/links")
    quality.enforce({"reconciliation": quality.reconciliation_errors(links, made)})
    return made


def run_daily(inputs: DailyInputs, as_of: datetime, out: str, cfg: ScheduleConfig = ScheduleConfig(),
              cadence_cfg: CadenceConfig = CadenceConfig(), base_start: date | None = None,
              forecast: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = baseline_forecast,
              history_start: date = HISTORY_START) -> dict[str, DataFrame]:
    """Run every stage into the new folder `out`; `as_of` is local wall-clock time.

    `forecast` maps (all origins, open origins, their history) to champion gap and quantity: the baseline, or a
    champion loaded from a model store (plans/champion.py). With `base_start` it sees only the history from that day
    on, and only pairs known there are scheduled.
    """
    when = F.lit(as_of.replace(tzinfo=None)).cast("timestamp_ntz")
    day_events = build_events(clean_items(inputs, as_of, out, history_start), inputs, out)
    days = write_new(features.history(events.sequence(events.by_day(day_events))), f"{out}/history")
    origins = write_new(events.named(cadence.with_routes(cadence.pair_profile(features.pair_features(days), cadence_cfg), cfg.router)), f"{out}/origins")
    hist = events.named(days)

    waiting = schedule.open_origins(origins, when)
    known, known_hist = origins, hist
    if base_start is not None:
        short = day_events.filter(F.col("ordered_on") >= F.lit(base_start))
        known_hist = events.named(write_new(features.history(events.sequence(events.by_day(short))), f"{out}/short-history"))
        known = write_new(features.pair_features(known_hist), f"{out}/short-origins")
    champion = forecast(known, schedule.open_origins(known, when), known_hist)

    memory = inputs.error_memory
    if inputs.previous_schedule is not None:
        fresh = feedback.pair_errors(feedback.outcomes(inputs.previous_schedule, origins.select("origin_event_id", "label_state", "target_gap_days")))
        memory = write_new(fresh if memory is None else feedback.upsert(memory, fresh), f"{out}/error-memory")
    corrections = None if memory is None else feedback.adjustments(memory, cfg.adjustment_mode, cfg.adjustment_cap_days)

    speed = cadence.item_speed(hist, cadence_cfg).select("product_id", "origin_on", "item_gap_median")
    none = F.lit(None)
    rows = (waiting.join(champion, "origin_event_id").join(speed, ["product_id", "origin_on"])
            .withColumns({"agent_gap_days": none.cast("bigint"), "agent_quantity": none.cast("bigint"), "relative_iqr": none.cast("double")}))
    planned = write_new(schedule.build_schedule(rows, when, cfg, corrections, inputs.store_rhythm), f"{out}/schedule")
    result = {"events": day_events, "origins": origins, "schedule": planned, "summary": reports.schedule_summary(planned)}
    if memory is not None:
        result["error_memory"] = memory
    return result
