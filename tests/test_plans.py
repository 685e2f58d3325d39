"""Skewed keys, stored stages, plan shape and the daily batch end to end."""
import random
from datetime import date, datetime

import pytest
from helpers import identity, items
from pyspark.sql import functions as F

from rebuyflow.operators import cadence, events, features, ingest, policy
from rebuyflow.plans.daily import DailyInputs, run_daily
from rebuyflow.plans.skew import attach_group_facts
from rebuyflow.plans.stages import stage, stage_folder
from rebuyflow.sources import driver_tables
from rebuyflow.sources.sinks import publishable

SF = "/root/testdata/sf0.001"


def test_hot_groups_are_salted_without_changing_the_result(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 200)}", i, rng.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id int, v int")
    facts = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    plain = df.join(facts, "k").select("id", "total", "n")
    salted = attach_group_facts(df, facts, ["k"], "n", F.col("id"), hot_rows=100)
    assert sorted(plain.collect()) == sorted(salted.select("id", "total", "n").collect())
    left = attach_group_facts(df, facts.filter("k <> 'hot'"), ["k"], "n", F.col("id"), hot_rows=20, how="left")
    assert left.count() == 3000 and left.filter("total IS NULL").count() == sum(k == "hot" for k, *_ in rows)


def test_rows_without_a_key_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, id int")
    facts = df.groupBy("k").agg(F.count("*").alias("n"))
    for hot_rows in (1, 100):
        got = attach_group_facts(df, facts, ["k"], "n", F.col("id"), hot_rows=hot_rows)
        assert sorted((r["id"], r["n"]) for r in got.collect()) == [(1, 2), (2, 2), (3, 1)]


def test_salt_spreads_a_hot_key(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    facts = df.groupBy("k").agg(F.count("*").alias("n"))
    for threshold in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(threshold, "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = (attach_group_facts(df, facts, ["k"], "n", F.col("id"), hot_rows=100)
                 .groupBy(F.spark_partition_id()).count().collect())
    finally:
        for threshold in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(threshold)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 4000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark):
    text = plan(driver_tables.daily_events(spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    text = plan(driver_tables.table(spark, SF, "orders").filter("o_orderkey > 10").select("o_custkey"))
    assert "GreaterThan(o_orderkey,10)" in text


def test_latest_version_combines_before_the_shuffle(spark):
    text = plan(ingest.latest_versions(driver_tables.order_versions(spark, SF)))
    assert text.count("FileScan") == 3 and text.count("partial_max(struct") == 2  # each given table once


def test_paid_window_reaches_the_scan(spark, folder):
    orders = driver_tables.app_orders(spark, SF)
    orders.write.parquet(f"{folder}/app")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(ingest.app_items(spark.read.parquet(f"{folder}/app"), date(1996, 1, 1), date(1996, 2, 1)))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(paid_at" in text and "LessThan(paid_at" in text


def test_history_needs_one_shuffle_after_the_daily_aggregate(spark):
    daily = stage(driver_tables.daily_events(spark, SF), "events")
    text = plan(features.history(events.sequence(daily)))
    assert text.count("Exchange hashpartitioning") == 1
    routed = plan(cadence.with_routes(cadence.pair_profile(features.pair_features(features.history(events.sequence(daily))))))
    assert routed.count("Exchange hashpartitioning") == 1


def test_item_speed_limits_before_the_shuffle(spark):
    text = plan(cadence.item_speed(stage(features.history(events.sequence(driver_tables.daily_events(spark, SF))), "history")))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_no_cross_join_in_policy(spark):
    text = plan(policy.apply_policy(stage(driver_tables.order_items(spark, SF), "items"), identity()))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_stage_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert stage_folder(spark) == shared
    assert stage(spark.range(5), "five").inputFiles()[0].startswith(f"file://{shared}/rebuyflow/{spark.sparkContext.applicationId}/five-")


VERSION = "order_no string, member_code string, channel string, wtime timestamp, updated_at timestamp, total_price bigint, total_payment_price bigint, sections string"


def version(order, member, day, products, status="SHIPPING_COMPLETE"):
    listed = ",".join(f'{{"orderItemCode":"{i}","orderSectionItemNo":"{order}-{i}","qty":"{q}","productInfo":{{"prodNo":"{p}","prodName":"n"}}}}'
                      for i, (p, q) in enumerate(products))
    sections = f'[{{"orderSectionCode":"s","orderSectionNo":"1","orderSectionStatus":"{status}","sectionItems":[{listed}]}}]'
    at = datetime(day.year, day.month, day.day, 3)
    return (order, member, "b2s", at, at, 1, 1, sections)


def weekly_orders(members=6, weeks=8):
    return [version(f"{m}-{w}", f"m{m}", date(2026, 1, 1 + m) .fromordinal(date(2026, 1, 1 + m).toordinal() + 7 * w), [("A", 2 + w % 2), ("B", 1)])
            for m in range(members) for w in range(weeks)]


def test_daily_batch_end_to_end(spark, folder):
    orders = weekly_orders()
    excluded = spark.createDataFrame([("m5", "exclude_internal_test")], "id string, reason string")
    inputs = DailyInputs(spark.createDataFrame(orders, VERSION), customer_exclusions=excluded)
    first = run_daily(inputs, datetime(2026, 2, 14, 6), f"{folder}/one")
    planned = first["schedule"]
    assert planned.count() == 5 * 2 and planned.filter("customer_id = 'm5'").count() == 0
    row = planned.filter("customer_id = 'm0' AND product_id = 'A'").first()
    assert (row["predicted_gap_days"], str(row["origin_on"]), row["status"]) == (7, "2026-02-12", "due")
    assert publishable(planned).count() == 10

    later = DailyInputs(spark.createDataFrame(orders, VERSION), customer_exclusions=excluded, previous_schedule=planned)
    second = run_daily(later, datetime(2026, 3, 20, 6), f"{folder}/two", base_start=date(2026, 1, 20))
    memory = second["error_memory"]
    assert memory.count() == 10 and {r["error_days"] for r in memory.collect()} == {0}
    with pytest.raises(Exception):
        run_daily(later, datetime(2026, 3, 20, 6), f"{folder}/two")


def test_daily_batch_rejects_broken_orders(spark, folder):
    doubled = spark.createDataFrame([version("1", "m", date(2026, 1, 5), [("A", 0)])], VERSION)
    with pytest.raises(ValueError, match="bad_quantity"):
        run_daily(DailyInputs(doubled), datetime(2026, 2, 1, 6), f"{folder}/bad")


def test_policy_holds_on_many_rows_of_one_order(spark):
    many = items(spark, [("2026-01-01", "A", 1, "PURCHASE_CONFIRMATION", "o")] * 500 + [("2026-01-01", "A", 1, "RETURN_COMPLETE", "o")])
    got = policy.apply_policy(many, identity()).groupBy("purchase_decision").count().collect()
    assert [(r["purchase_decision"], r["count"]) for r in got] == [("hold_return_exchange_linked", 501)]


def test_few_facts_leave_the_rows_where_they_are(spark, monkeypatch):
    from rebuyflow.plans import skew
    rows = [("hot" if i % 3 else (f"k{i % 20}" if i % 5 else None), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, id long")
    facts = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("total")).filter("k IS NULL OR k <> 'k3'")
    for how in ("inner", "left"):
        few = attach_group_facts(df, facts, ["k"], "n", F.col("id"), how=how)
        assert "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as many:
            many.setattr(skew, "FEW_FACTS", 3)
            dealt = attach_group_facts(df, facts, ["k"], "n", F.col("id"), how=how)
            assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, dealt.collect()), key=repr)
