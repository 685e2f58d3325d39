"""Rows that lie by order are grouped where they are; large orders are dealt as before, with the same results."""
from datetime import datetime

import pytest
from helpers import identity, items
from pyspark.sql import functions as F

from rebuyflow.catalog import events as event_queries
from rebuyflow.catalog import schedule, seeded
from rebuyflow.functions.scalars import packed_id, unpacked_id
from rebuyflow.operators import events, features, ingest, policy, quality
from rebuyflow.plans import skew
from rebuyflow.plans.stages import stage
from rebuyflow.sources import driver_tables as tables

LINE = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
DONE = "PURCHASE_CONFIRMATION"


@pytest.fixture
def tables_of(spark, folder):
    """Writes the three tables of the order items: orders 0 to 29 with up to four lines, and one of `hot` lines."""
    def write(hot=0):
        at = datetime(1996, 1, 1)
        lines = [(o, (o * 7 + n) % 5, 3 * n + 1, n, 5.0 + n, 100.5 * o + n, 0.05, 0.01, "N", "F" if o % 2 else "O", at.replace(month=1 + (o + n) % 3))
                 for o in range(30) for n in range(1, 2 + o % 4)]
        lines += [(99, i % 5, 1 + i % 7, 1 + i % 4, 1.0 + i % 3, 10.0 * i, 0.0, 0.0, "N", "F", at.replace(day=1 + i % 9)) for i in range(hot)]
        lines += [(None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", at), (3, None, 1, 9, 1.0, 1.0, 0.0, 0.0, "N", "O", at)]
        spark.createDataFrame(lines, LINE).write.parquet(f"{folder}/lineitem.parquet")
        orders = [(o, o % 6, "F" if o % 3 else "P", 1.0, at, "5-LOW") for o in (*range(30), 99)]
        spark.createDataFrame([*orders, orders[4], (None, 1, "O", 1.0, at, "5-LOW")],
                              "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
        spark.createDataFrame([(p, f"name {p}", f"T{p % 2}") for p in range(5)], "p_partkey bigint, p_name string, p_type string").write.parquet(f"{folder}/part.parquet")
        return folder
    return write


@pytest.fixture
def shuffled(spark):
    """No join is a broadcast unless it is asked for."""
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    yield
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(name)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def bag(df):
    return sorted(map(repr, df.collect()))


def test_versions_need_no_shuffle_beyond_the_joins(spark, tables_of, shuffled):
    sf = tables_of()
    versions = tables.order_versions(spark, sf)
    assert exchanges(versions) == 4  # lines and parts by part, both and orders by order
    assert exchanges(ingest.latest_versions(versions)) == 4 and exchanges(ingest.web_items(versions)) == 4


def test_a_large_order_is_not_gathered(spark, tables_of, shuffled, monkeypatch):
    sf = tables_of(hot=900)
    together = {name: bag(made(spark, sf)) for name, made in (("items", tables.order_items), ("versions", tables.order_versions))}
    monkeypatch.setattr(skew, "SMALL_GROUP", 50)
    assert not skew.balanced(tables.line_orders(spark, sf), ["order_id"])
    apart = {name: bag(made(spark, sf)) for name, made in (("items", tables.order_items), ("versions", tables.order_versions))}
    assert together == apart and len(together["items"]) > 900
    assert exchanges(ingest.latest_versions(tables.order_versions(spark, sf))) == 6  # combined before two shuffles of their own


def test_balance_is_judged_by_the_largest_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_GROUP", 20)
    even = spark.range(4000).select((F.col("id") % 1000).alias("k"))
    assert skew.balanced(even, ["k"]) and skew.balanced(even.limit(0), ["k"])
    for hot in (F.lit(7), F.lit(None).cast("long")):
        assert not skew.balanced(even.unionByName(spark.range(2000).select(hot.alias("k"))), ["k"])


def test_rows_are_decided_where_they_lie(spark, tables_of, shuffled, monkeypatch):
    rows = tables.order_items(spark, tables_of(hot=300))
    lists = {"customer_exclusions": spark.createDataFrame([("1", "exclude_internal_test"), ("1", "exclude_internal_test")], "id string, reason string"),
             "product_exclusions": spark.createDataFrame([("T1", "exclude_sample")], "id string, reason string")}
    rows = rows.withColumn("product_id", F.when(F.col("order_section_item_no") > "2", F.col("product_id")))
    number = F.col("order_section_item_no")
    there = policy.apply_policy(rows, number, **lists)
    assert exchanges(there) == 4  # those of the joins
    monkeypatch.setattr(skew, "SMALL_GROUP", 50)
    monkeypatch.setattr(skew, "FEW_FACTS", 3)
    dealt = policy.apply_policy(rows, number, **lists)
    assert exchanges(dealt) > 4 and there.columns == dealt.columns and bag(there) == bag(dealt)
    assert {"exclude_internal_test", "exclude_sample", "include_completed"} <= {r["purchase_decision"] for r in there.collect()}


def decided(spark):
    """Rows whose events are completed, held, excluded, without a product, and of one day."""
    rows = items(spark, [("2026-01-01", "A", 2, DONE), ("2026-01-01", "A", 3, DONE), ("2026-01-05", "A", 1, DONE), ("2026-01-07", "A", 1, "RETURN_COMPLETE"),
                         ("2026-01-09", "A", 4, DONE), ("2026-01-12", "A", 1, DONE), ("2026-01-13", "A", 1, "CANCEL_COMPLETE"), ("2026-01-02", None, 1, DONE),
                         ("2026-01-04", None, 2, DONE), ("2026-01-06", "B", 1, DONE)])
    return policy.apply_policy(rows.withColumn("ordered_on", F.when(F.col("order_id") != "9", F.col("ordered_on"))), identity())


def test_sequences_know_events_by_their_day(spark):
    made = stage(events.day_states(decided(spark)), "events")
    for whole, short in ((events.sequence(made), events.sequence(made, digests=True)), (events.with_episodes(made), events.with_episodes(made, digests=True)),
                         (events.next_purchase_labels(made), events.next_purchase_labels(made, digests=True)),
                         (features.pair_features(features.history(events.sequence(made))),
                          events.named(features.pair_features(features.history(events.sequence(events.by_day(made))))))):
        assert whole.columns == short.columns and bag(whole) == bag(short) and whole.count() > 5
    sent = events.sequence(made, digests=True)._jdf.queryExecution().executedPlan().toString()
    assert "event_id:string" not in sent[sent.index("ReadSchema"):]  # not even read


def test_stored_events_make_their_ids_again(spark):
    made = events.day_states(decided(spark))
    stored = event_queries.stored_events(made)
    assert stored.columns == made.columns and bag(stored) == bag(made)
    assert "event_id" not in spark.read.parquet(*stored.inputFiles()).columns


def test_labels_and_rows_meet_by_pair_and_day(spark, shuffled):
    rows = decided(spark).withColumn("order_section_item_no", F.concat("order_id", F.lit("x")))
    made = stage(events.day_states(rows), "events")
    links = events.row_disposition(rows, made, identity(), stored=True)
    labels = events.next_purchase_labels(made, digests=True)
    found = events.lineage(labels, links)
    kept = links.filter("event_quantity_contribution > 0").select(F.col("event_id").alias("target_event_id"), "order_id", "order_section_item_no", "section_status", "event_quantity_contribution")
    plain = labels.filter("label_state = 'observed'").select("origin_event_id", "target_event_id", "target_on", "target_quantity").join(kept, "target_event_id")
    assert found.columns == plain.columns and bag(found) == bag(plain) and found.count() == 3
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not any("event_id" in line for line in text.splitlines() if "Exchange" in line)


def test_reconciliation_sends_packed_ids(spark):
    digest = "0a" * 32
    ids = [digest, digest[:32], digest.upper(), digest[:-2], digest + "0a", "e1", "", "é" * 16, None]
    frame = spark.createDataFrame([(i, 2, 5) for i in ids], "event_id string, source_rows long, quantity long")
    back = frame.select("event_id", packed_id(F.col("event_id")).alias("p")).select("event_id", unpacked_id(F.col("p")).alias("again"), F.length("p").alias("n")).collect()
    assert all(r["event_id"] == r["again"] for r in back) and [r["n"] for r in back if r["event_id"] == digest] == [32]
    assert all(r["n"] > 32 for r in back if r["event_id"] not in (digest, digest[:32], None))
    links = spark.createDataFrame([(i, q) for i in ids[:-2] for q in (2, 3)] + [("lost", 1)], "event_id string, event_quantity_contribution long")
    got = quality.reconcile(links, frame)
    assert got.columns == ["event_id", "source_rows", "quantity", "link_rows", "contributed", "ok"]
    assert {r["event_id"]: r["ok"] for r in got.collect()} == {**{i: True for i in ids[:-2]}, "é" * 16: False, None: False, "lost": False}


def test_marked_links_need_no_row_number(spark, tables_of):
    sf = tables_of(hot=40)
    spark.createDataFrame([(c, -950.0 if c == 2 else 5.0) for c in range(6)], "c_custkey bigint, c_acctbal double").write.parquet(f"{sf}/customer.parquet")
    first = F.col("order_section_item_no") < "4"
    marked = event_queries.stored_links(spark, sf, traced=False, early=first)[0]
    traced = event_queries.links(spark, sf)
    assert bag(marked.filter("early").select("event_id", "event_quantity_contribution")) == bag(traced.filter(first).select("event_id", "event_quantity_contribution"))
    assert marked.filter("early").count() not in (0, marked.count())


def test_checked_policy_rows_are_stored_narrow(spark, tables_of, monkeypatch):
    stored = []
    monkeypatch.setattr(seeded, "stage", lambda df, name: stored.append(df.columns) or stage(df, name))
    sf = tables_of()
    spark.createDataFrame([(c, 5.0) for c in range(6)], "c_custkey bigint, c_acctbal double").write.parquet(f"{sf}/customer.parquet")
    counts = {r["check_name"]: r["violations"] for r in seeded.seeded_policy(spark, sf).collect()}
    assert counts.keys() == {"annotation", "exclusion", "quantity"} and counts["annotation"] > 0
    assert "order_section_item_no" not in stored[0] and "product_name" not in stored[0]


def test_history_of_a_run_is_stored_by_day(spark, tables_of):
    made = event_queries.stored_events(events.day_states(decided(spark)))
    table = schedule.stored_history(made)
    assert dict(table.dtypes)["event_id"].startswith("struct<") and table.inputFiles()
    plain = features.history(events.sequence(made))
    assert table.columns == plain.columns and bag(events.named(table)) == bag(plain) == bag(events.named(plain))


def test_days_of_stored_rows_are_made_in_one_shuffle(spark, monkeypatch):
    rows = stage(decided(spark), "policy")
    once = events.day_states(rows, stored=True)
    assert exchanges(once) == 1
    monkeypatch.setattr(skew, "SMALL_GROUP", 1)
    dealt = events.day_states(rows, stored=True)  # two rows of one day are a large group now
    assert exchanges(dealt) == 2 and bag(once) == bag(dealt) == bag(events.day_states(rows))
