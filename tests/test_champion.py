"""The model store, the batch with a stored champion, and the batch's whole orders."""
from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from test_plans import VERSION, weekly_orders

from rebuyflow.catalog.features import SPLIT, hist
from rebuyflow.config import ScheduleConfig
from rebuyflow.operators import features, ingest, models
from rebuyflow.plans import champion
from rebuyflow.plans.daily import DailyInputs, baseline_forecast, run_daily
from rebuyflow.plans.stages import stage
from rebuyflow.sources import driver_tables

SF = "/root/testdata/sf0.001"
SMALL = models.TreeConfig(max_depth=2, max_rounds=4, min_instances=2)


@pytest.fixture(scope="module")
def trained(spark):
    rows = stage(features.with_split(features.origin_table(stage(hist(spark, SF), "history")), SPLIT), "origins")
    return champion.train("v1", rows, SMALL), rows


def test_a_stored_champion_gives_the_same_schedule_in_another_session(spark, trained, folder):
    fresh, _ = trained
    champion.ModelStore(spark, f"{folder}/store").save(fresh)
    champion.ModelStore(spark, f"{folder}/store").promote("v1", "first")
    cfg = replace(ScheduleConfig(), model_version="v1")

    def plan(session, forecast, name):
        inputs = DailyInputs(session.createDataFrame(weekly_orders(), VERSION))
        out = run_daily(inputs, datetime(2026, 2, 14, 6), f"{folder}/{name}", cfg, base_start=date(2026, 1, 10), forecast=forecast)
        return sorted(out["schedule"].collect(), key=lambda row: row["suggestion_key"])

    other = spark.newSession()
    got = plan(other, champion.ModelStore(other, f"{folder}/store").load(), "loaded")
    assert got == plan(spark, fresh, "memory") and len(got) == 12
    assert {row["model_version"] for row in got} == {"v1"}


def test_the_last_promotion_names_the_champion(spark, trained, folder):
    fresh, rows = trained
    store = champion.ModelStore(spark, folder)
    with pytest.raises(ValueError, match="No champion"):
        store.load()
    store.save(fresh)
    store.save(champion.train("v2", rows, replace(SMALL, max_rounds=2)))
    for version in ("v1", "v2", "v1"):
        store.promote(version, "chosen")
        assert store.load().version == store.current() == version
    assert [r["version"] for r in store.promotions().orderBy("number").collect()] == ["v1", "v2", "v1"]
    assert store.load("v2").card["gap_rounds"] <= 2
    assert store.card("v1")["training_rows"] == rows.filter("train_pool").count()
    with pytest.raises(Exception):
        store.save(fresh)  # a version is written once


def test_unfinished_and_changed_versions_are_refused(spark, trained, folder):
    fresh, _ = trained
    store = champion.ModelStore(spark, folder)
    fresh.trees["gap"].write().save(f"{folder}/versions/broken/gap")
    with pytest.raises(ValueError, match="No finished version"):
        store.promote("broken", "no card")
    store.save(champion.Champion("swapped", {"gap": fresh.trees["quantity"], "quantity": fresh.trees["gap"]}, {**fresh.card, "version": "swapped"}))
    with pytest.raises(ValueError, match="differs from its card"):
        store.load("swapped")
    store.save(champion.Champion("other", fresh.trees, {**fresh.card, "version": "other", "features": ["qty_last"]}))
    with pytest.raises(ValueError, match="other inputs"):
        store.load("other")


def test_champion_forecasts_every_open_origin_at_least_one(spark, trained):
    fresh, _ = trained
    table = stage(hist(spark, SF), "history")
    waiting = features.pair_features(table).filter("label_state = 'right_censored'")
    got = fresh(None, waiting, table)
    assert got.count() == waiting.count() > 0
    assert got.filter("champion_gap_days < 1 OR champion_quantity < 1 OR champion_gap_days IS NULL").isEmpty()
    assert got.columns == baseline_forecast(features.pair_features(table), waiting, table).columns


def test_whole_orders_carry_every_item(spark):
    items = driver_tables.order_items(spark, SF)
    names = ["customer_id", "order_id", "product_id", "product_name", "order_item_code", "order_section_item_no", "ordered_at", "ordered_on", "quantity", "section_status"]
    got = ingest.web_items(driver_tables.whole_orders(spark, SF)).select(*names)
    assert got.exceptAll(items.select(*names)).isEmpty() and items.select(*names).exceptAll(got).isEmpty()
    assert ingest.latest_versions(driver_tables.whole_orders(spark, SF)).filter(F.col("same_update_rows") != 1).isEmpty()
