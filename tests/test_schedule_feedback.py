"""Schedule rules, error memory and publishing."""
from datetime import date, datetime

import pytest
from helpers import by
from pyspark.sql import functions as F

from rebuyflow.config import RouterConfig, ScheduleConfig
from rebuyflow.operators import feedback, schedule
from rebuyflow.sources import sinks

MEMORY = "origin_event_id string, customer_id string, product_id string, origin_on date, predicted_gap_days int, target_gap_days int, cart_on date"


def outcome(n, predicted, actual, alarm=None, customer="A"):
    cart = date(2026, 1, n + alarm) if alarm else None
    return (f"{customer}P{n}", customer, "P", date(2026, 1, n), predicted, actual, cart)


def memory(spark, rows):
    return feedback.pair_errors(spark.createDataFrame(rows, MEMORY))


def adjustment(frame, mode, cap, before_on=None):
    return by(feedback.adjustments(frame, mode, cap, before_on), "customer_id", "adjustment_days")


def test_median_mode_only_pulls_earlier_up_to_the_cap(spark):
    late = memory(spark, [outcome(1, 25, 18), outcome(2, 24, 17), outcome(3, 26, 19)])
    assert adjustment(late, "median", 7) == {"A": -7}
    more = feedback.upsert(late, memory(spark, [outcome(4, 40, 10), outcome(5, 40, 10), outcome(6, 40, 10)]))
    assert adjustment(more, "median", 7) == {"A": -7}
    early = memory(spark, [outcome(1, 10, 30, customer="B"), outcome(2, 10, 31, customer="B")])
    assert adjustment(early, "median", 7) == {}
    half = memory(spark, [outcome(1, 10, 8), outcome(2, 10, 7)])   # median -2.5 truncates to -2
    assert adjustment(half, "median", 7) == {"A": -2}
    assert adjustment(late, "median", 7, date(2026, 1, 1)) == {}


def test_ratchet_worked_sequence(spark):
    rows = [outcome(1, 21, 10, 14), outcome(2, 21, 20, 9), outcome(3, 21, 3, 9), outcome(4, 40, 1, 8), outcome(5, 40, 1, 8)]
    assert [adjustment(memory(spark, rows[:k]), "ratchet", 21)["A"] for k in (1, 2, 3, 5)] == [-5, -5, -12, -21]
    assert adjustment(memory(spark, [outcome(1, 21, 10)]), "ratchet", 21) == {"A": -5}   # alarm 14 by default
    with pytest.raises(ValueError):
        feedback.adjustments(memory(spark, rows), "ratchet", -1)


def test_memory_is_idempotent_and_skips_unusable_rows(spark):
    first = memory(spark, [outcome(1, 25, 18), outcome(2, 24, 17), outcome(3, 20, 0), outcome(4, None, 5), outcome(5, 20, None)])
    again = feedback.upsert(first, memory(spark, [outcome(1, 25, 18)]))
    assert (first.count(), again.count()) == (2, 2)
    row = feedback.memory_stats(again, "median", 7).first()
    assert (row["errors"], row["pairs"], row["adjusted_pairs"]) == (2, 1, 1)


ROW = ("origin_event_id string, customer_id string, product_id string, origin_on date, route_group string, route_confidence double, route_changed boolean, pair_count int, "
       "pair_gap_lag1 int, item_gap_median double, champion_gap_days bigint, champion_quantity bigint, agent_gap_days bigint, agent_quantity bigint, relative_iqr double")


def origin(i, group="stable", count=5, lag=9, item=21.4, champion=23, agent=None, iqr=None, on=date(2026, 9, 14)):
    return (i, "c" + i, "p", on, group, 1.0, False, count, lag, item, champion, 4, agent, 6 if agent else None, iqr)


def chosen(spark, rows, cfg, routes=None):
    out = schedule.choose_gap(spark.createDataFrame(rows, ROW), cfg, routes)
    return by(out, "origin_event_id", "predicted_gap_days", "selected_agent", "purchase_stage", "suggest", "fallback_reason", "router_quantity")


def test_short_history_overrides(spark):
    rows = [origin("a", count=0), origin("b", count=0, item=None), origin("c", count=1), origin("d", "insufficient", 3), origin("e")]
    got = chosen(spark, rows, ScheduleConfig())
    assert got["a"][:4] == (21, "first_purchase_item_median", "first", True)
    assert got["b"][:4] == (23, "first_purchase_model_fallback", "first", True)
    assert got["c"][:4] == (9, "second_purchase_last_gap", "second", True)
    assert got["d"] == (23, "champion", "third_fourth", True, "routed_to_champion", 4)
    plain = chosen(spark, rows, ScheduleConfig(first_purchase="skip", second_purchase="model"))
    assert plain["a"][:4] == (23, "champion", "first", False) and plain["c"][:4] == (23, "champion", "second", True)


def test_guard_reasons(spark):
    cfg = ScheduleConfig(router=RouterConfig(max_relative_iqr=0.8, late_guard=True))
    rows = [origin("a", agent=10, iqr=0.9), origin("b", agent=25, iqr=0.1), origin("c", agent=15, iqr=0.1), origin("d", "rebound", agent=15), origin("e", agent=None)]
    got = chosen(spark, rows, cfg, {"stable": "special", "rebound": "champion"})
    assert {k: (v[0], v[4], v[5]) for k, v in got.items()} == {
        "a": (23, "high_uncertainty", 4), "b": (23, "later_than_champion", 4), "c": (15, None, 6), "d": (15, None, 6), "e": (23, "specialist_unavailable", 4)}


def test_schedule_statuses_and_composition(spark):
    when = F.lit("2026-10-10T06:00:00").cast("timestamp_ntz")
    rows = [origin("due", champion=30), origin("later", champion=60), origin("old", on=date(2026, 7, 1)), origin("skip", count=0)]
    cfg = ScheduleConfig(first_purchase="skip")
    moves = spark.createDataFrame([("cdue", "p", -5)], "customer_id string, product_id string, adjustment_days bigint")
    rhythm = spark.createDataFrame([("clater", "p", date(2026, 9, 1), 9)], "customer_id string, product_id string, cart_on date, cart_quantity bigint")
    out = schedule.build_schedule(spark.createDataFrame(rows, ROW), when, cfg, moves, rhythm)
    got = by(out, "origin_event_id", "status", "scheduled_gap_days", "lead_days", "cart_quantity", "pair_adjustment_days")
    assert got["due"] == ("due", 30 - 5 - 2, 9, 4, -5)       # 30 % of 30 days is two days beyond the base lead
    assert got["later"] == ("scheduled", 60 - 7, 14, 9, 0)
    assert got["old"][0] == "closed" and got["skip"][0] == "no_suggestion_first_purchase" and got["skip"][2] == 7
    dates = by(out, "origin_event_id", "cart_on", "predicted_repurchase_on", "monitor_until")
    assert dates["due"] == (date(2026, 9, 30), date(2026, 10, 14), date(2026, 10, 29))


def test_open_origins_wait_for_the_local_midnight(spark):
    df = spark.createDataFrame([("a", "right_censored", date(2026, 10, 9)), ("b", "right_censored", date(2026, 10, 10)), ("c", "observed", date(2026, 10, 1))],
                               "origin_event_id string, label_state string, origin_on date")
    got = schedule.open_origins(df, F.lit("2026-10-10T06:00:00").cast("timestamp_ntz"))
    assert [r["origin_event_id"] for r in got.collect()] == ["a"]


def test_publishing_replaces_equal_keys_on_a_new_path(spark, folder):
    columns = "suggestion_key string, customer_id string, product_id string, cart_at timestamp, cart_quantity bigint, predicted_repurchase_on date, status string, customer_group string, purchase_stage string, model_version string, ab_group string"
    def table(rows):
        return spark.createDataFrame([(k, "c", "p", datetime(2026, 1, 1), q, date(2026, 1, 9), s, "g", "first", "v", "control") for k, q, s in rows], columns)
    at = datetime(2026, 1, 2)
    sinks.publish(spark, table([("a", 1, "due"), ("b", 2, "scheduled"), ("x", 9, "closed")]), None, f"{folder}/one", at)
    second = sinks.publish(spark, table([("b", 5, "due"), ("c", 3, "due")]), f"{folder}/one", f"{folder}/two", at)
    assert by(second, "suggestion_key", "cart_quantity") == {"a": 1, "b": 5, "c": 3}
    with pytest.raises(Exception):
        sinks.write_new(second, f"{folder}/one")
    sinks.append_published(table([("d", 1, "due")]), f"{folder}/log", at)
    sinks.append_published(table([("d", 1, "due")]), f"{folder}/log", at)
    assert spark.read.parquet(f"{folder}/log").count() == 2
