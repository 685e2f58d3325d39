"""What the queries store and send: nothing twice, nothing that a row can make again."""
from datetime import date

import pyarrow.parquet as pq
from helpers import identity, items
from pyspark.sql import functions as F

from rebuyflow.catalog import events as event_queries
from rebuyflow.operators import events, ingest, policy
from rebuyflow.plans.stages import stage
from rebuyflow.sources import driver_tables
from rebuyflow.sources.sinks import write_new

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_are_packed(spark, folder):
    for stored in (stage(spark.range(5), "packed"), write_new(spark.range(5), f"{folder}/packed")):
        columns = pq.ParquetFile(stored.inputFiles()[0].removeprefix("file://")).metadata.row_group(0).column(0)
        assert columns.compression == "ZSTD"


def test_links_make_the_event_id_from_the_row(spark):
    rows = policy.apply_policy(items(spark, [("2026-01-01", "A", 2, "PURCHASE_CONFIRMATION"), ("2026-01-01", "A", 3, "PURCHASE_CONFIRMATION"),
                                             ("2026-01-02", None, 1, "PURCHASE_CONFIRMATION"), ("2026-01-03", "B", 1, "RETURN_COMPLETE")]), identity())
    made = stage(events.day_states(rows), "events")
    linked = events.row_disposition(rows, made, identity(), stored=True)
    assert "event_id" not in plan(linked.drop("event_id"))
    counted = {r["event_id"]: r["count"] for r in linked.groupBy("event_id").count().collect()}
    assert counted == {r["event_id"]: r["source_rows"] for r in made.collect()} and len(counted) == 3


def test_untraced_links_carry_no_row_number(spark):
    stored = event_queries.stored_links(spark, SF, traced=False)[0]
    assert dict(stored.dtypes)["order_section_item_no"] == "bigint" and "section_status" not in stored.columns
    traced = event_queries.links(spark, SF)
    assert stored.groupBy("row_disposition").count().collect().sort() == traced.groupBy("row_disposition").count().collect().sort()
    assert stored.count() == traced.count()


def test_orders_are_nested_in_one_shuffle(spark):
    assert plan(driver_tables.whole_orders(spark, SF)).count("Exchange hashpartitioning(order_id") == 1


def test_manifest_counts_without_expanding_rows(spark):
    day = date(2026, 1, 1)
    rows = spark.createDataFrame([("o", "1", "c", 2, day), ("o", "1", "d", 1, day), ("o", "2", "c", 1, day), ("p", "1", None, 1, date(2026, 1, 3)), (None, "1", "e", 2, day)],
                                 "order_id string, order_item_code string, customer_id string, latest_timestamp_row_count bigint, ordered_on date")
    manifest = ingest.merge_manifest(rows)
    assert "Expand" not in plan(manifest)
    assert manifest.first().asDict() == {"rows": 5, "orders": 2, "customers": 3, "tie_orders": 1, "repeated_order_item_codes": 1,
                                         "date_min": day, "date_max": date(2026, 1, 3)}
    assert ingest.merge_manifest(rows.limit(0)).first()["repeated_order_item_codes"] == 0
