"""Policy, daily events and labels on hand-worked rows."""
from datetime import date, datetime

import pytest
from helpers import by, events, identity, items
from pyspark.sql import functions as F

from rebuyflow.operators import events as ev
from rebuyflow.operators import ingest, policy, quality
from rebuyflow.sources.readers import empty_as_null, one_rhythm_per_pair, orders_in_window, read_text_csv, corrupt_rows

DONE, SHIPPED, CANCEL, RETURN = "PURCHASE_CONFIRMATION", "SHIPPING_COMPLETE", "CANCEL_COMPLETE", "RETURN_COMPLETE"


def policy_of(spark, rows, **lists):
    return policy.apply_policy(items(spark, rows), identity(), **lists)


def exclusions(spark, mapping):
    return spark.createDataFrame(list(mapping.items()), "id string, reason string")


@pytest.mark.parametrize("statuses, products, expected", [
    ([DONE, SHIPPED], ["A", "A"], "completed_group_candidate"), ([CANCEL, CANCEL], ["A", "A"], "excluded_cancelled_group"),
    ([DONE, CANCEL], ["A", "A"], "review_partial_cancel_linked"), ([DONE, "SHIPPING"], ["A", "A"], "review_in_progress_linked"),
    ([RETURN, "SHIPPING"], ["A", "A"], "review_return_exchange_linked"), (["MYSTERY", RETURN], ["A", "A"], "review_unknown_status"),
    ([DONE, "MYSTERY"], ["A", "B"], "review_product_identity")])
def test_group_precedence(spark, statuses, products, expected):
    rows = items(spark, [("2026-05-01", p, 1, s, "o") for s, p in zip(statuses, products)]).withColumn("order_item_code", F.lit("c"))
    assert policy.classify_groups(rows, ["order_id", "order_item_code"]).first()["group_decision"] == expected


def test_customer_then_product_then_status(spark):
    rows = [("2026-05-01", "A", 2, DONE), ("2026-05-01", "B", 2, RETURN), ("2026-05-02", "C", 1, CANCEL)]
    products = exclusions(spark, {"B": "exclude_sample"})
    got = by(policy_of(spark, rows, product_exclusions=products), "product_id", "purchase_decision", "eligible_quantity", "sequence_barrier")
    assert got == {"A": ("include_completed", 2, False), "B": ("exclude_sample", None, False), "C": ("exclude_cancelled", None, False)}
    everyone = policy_of(spark, rows, product_exclusions=products, customer_exclusions=exclusions(spark, {"001": "exclude_internal_test"}))
    assert {r["purchase_decision"] for r in everyone.collect()} == {"exclude_internal_test"}


def test_versions_and_allowed_reasons(spark):
    assert [policy.policy_version(None), policy.policy_version("product-exclusions-v1"), policy.policy_version(None, True),
            policy.policy_version("product-exclusions-v2", True), policy.policy_version("product-exclusions-v3")] == [f"purchase-policy-v{i}" for i in range(1, 6)]
    bad = policy.disallowed_exclusions(exclusions(spark, {"a": "exclude_gift", "b": "exclude_prepaid_credit"}), "product-exclusions-v1")
    assert [r["id"] for r in bad.collect()] == ["a"]
    with pytest.raises(ValueError):
        quality.enforce({"exclusions": bad})


def test_same_day_rows_make_one_event(spark):
    rows = policy_of(spark, [("2026-05-01", "A", 2, DONE), ("2026-05-01", "A", 3, SHIPPED), ("2026-05-03", "B", 99, DONE), ("2026-05-10", "A", 4, DONE)])
    made = ev.day_states(rows)
    quantity = {(r["product_id"], str(r["ordered_on"])): r["quantity"] for r in made.collect()}
    assert quantity == {("A", "2026-05-01"): 5, ("B", "2026-05-03"): 99, ("A", "2026-05-10"): 4}
    observed = ev.next_purchase_labels(made).filter("label_state = 'observed'").collect()
    assert [(r["product_id"], r["target_gap_days"], r["target_quantity"]) for r in observed] == [("A", 9, 4)]


def test_return_on_a_completed_day_holds_it(spark):
    rows = policy_of(spark, [("2026-05-01", "A", 2, DONE), ("2026-05-05", "A", 3, DONE), ("2026-05-05", "A", 1, RETURN), ("2026-05-10", "A", 4, DONE), ("2026-05-15", "A", 5, DONE)])
    made = ev.day_states(rows)
    labels = ev.next_purchase_labels(made).orderBy("origin_on").collect()
    assert [r["label_state"] for r in labels] == ["blocked_by_hold", "observed", "right_censored"]
    links = ev.row_disposition(rows, made, identity())
    assert links.filter("row_disposition = 'hold_same_day'").count() == 1
    assert quality.reconciliation_errors(links, made).count() == 0
    broken = links.withColumn("event_quantity_contribution", F.lit(1).cast("bigint"))
    assert quality.reconciliation_errors(broken, made).count() > 0


def test_cancelled_and_excluded_days_are_audit_rows(spark):
    rows = policy_of(spark, [("2026-05-01", "A", 2, DONE), ("2026-05-03", "A", 2, CANCEL), ("2026-05-04", "A", 1, DONE), ("2026-05-04", "B", 1, DONE)],
                     product_exclusions=exclusions(spark, {"B": "exclude_gift"}))
    made = ev.with_episodes(ev.day_states(rows))
    states = {(r["product_id"], str(r["ordered_on"])): (r["event_state"], r["episode_purchase_index"]) for r in made.collect()}
    assert states == {("A", "2026-05-01"): ("completed", 1), ("A", "2026-05-03"): ("cancelled_only", None),
                      ("A", "2026-05-04"): ("completed", 2), ("B", "2026-05-04"): ("excluded_only", None)}


def test_hold_cuts_the_episode(spark):
    rows = [("a", "c", "p", "2026-01-01", "completed", 1), ("b", "c", "p", "2026-01-05", "completed", 2), ("h", "c", "p", "2026-01-06", "held", None),
            ("d", "c", "p", "2026-01-09", "completed", 3), ("e", "c", "p", "2026-01-12", "completed", 4)]
    got = by(ev.sequence(events(spark, rows)), "event_id", "episode_id", "episode_purchase_index", "gap_days", "previous_quantity", "first_of_pair")
    assert got == {"a": ("a", 1, None, None, True), "b": ("a", 2, 4, 1, False), "h": (None, None, None, None, False),
                   "d": ("d", 1, None, None, False), "e": ("d", 2, 3, 3, False)}


def test_quarantine_keeps_later_history(spark):
    rows = items(spark, [("2026-01-01", "A", 1, DONE), ("2026-01-05", "", 1, DONE), ("2026-01-05", "B", 1, DONE), ("2026-01-06", "A", 1, DONE)])
    rows = rows.withColumn("product_id", F.when(F.col("product_id") != "", F.col("product_id")))
    got = [(str(r["ordered_on"]), r["product_id"], r["quarantine_reason"]) for r in ingest.quarantine(rows, identity()).orderBy("order_id").collect()]
    assert got == [("2026-01-01", "A", "prefix_before_unknown_product"), ("2026-01-05", None, "missing_product_id"),
                   ("2026-01-05", "B", "prefix_before_unknown_product"), ("2026-01-06", "A", None)]
    assert ingest.late_cutoffs(rows, date(2026, 1, 4)).count() == 1


def test_lifecycle_quantities_and_pattern(spark):
    rows = items(spark, [("2026-01-01", "A", 2, DONE, "o"), ("2026-01-01", "A", 1, CANCEL, "o"), ("2026-01-01", "A", 3, DONE, "o")]).withColumn("order_item_code", F.lit("c"))
    row = policy.item_lifecycle(rows).first()
    assert row["quantity_by_current_status"] == '{"CANCEL_COMPLETE":1,"PURCHASE_CONFIRMATION":5}'
    assert row["status_pattern"] == "CANCEL_COMPLETE:1 | PURCHASE_CONFIRMATION:2"
    assert row["linked_group_decision"] == "review_partial_cancel_linked"


def test_item_checks_report_conflicts(spark):
    rows = items(spark, [("2026-01-01", "A", 1, DONE, "o"), ("2026-01-02", "B", 1, DONE, "o")]).withColumn("order_item_code", F.lit("c"))
    assert quality.conflicting(rows, ["order_id"], ["customer_id", "ordered_at", "ordered_on"]).count() == 1
    assert quality.conflicting(rows, ["order_id", "order_item_code"], ["product_id"]).count() == 1
    assert quality.repeated(rows, ["order_id"]).count() == 1
    early = rows.withColumn("extracted_at", F.lit(datetime(2025, 1, 1)))
    assert quality.time_errors(early).count() == 2 and quality.time_errors(rows).count() == 0
    odd = spark.createDataFrame([("2", 2), ("2.0", 2), ("2.5", 2), ("x", None), ("0", 0), ("NaN", 1)], "quantity_raw string, quantity bigint")
    assert quality.bad_quantity(odd).count() == 4


def test_shards_must_not_overlap_or_repeat(spark):
    a = items(spark, [("2026-01-01", "A", 1, DONE, "o1")])
    b = items(spark, [("2026-01-01", "A", 1, DONE, "o2")])
    assert quality.overlapping_orders([a, b]).count() == 0 and quality.overlapping_orders([a, b, a]).count() == 1
    assert quality.duplicate_shards([a, b]).count() == 0 and quality.duplicate_shards([a, b, a]).count() == 1
    with pytest.raises(ValueError):
        ingest.merge_shards([a, b.drop("quantity")])


def test_latest_version_tie_break(spark):
    rows = [("1", "m", "b2s", datetime(2026, 1, 1), datetime(2026, 1, 2), 10, 10, "[1]"), ("1", "m", "b2s", datetime(2026, 1, 1), datetime(2026, 1, 3), 20, 20, "[2]"),
            ("1", "m", "b2s", datetime(2026, 1, 1), datetime(2026, 1, 3), 30, 30, "[3]"), ("2", None, "b2s", datetime(2026, 1, 1), datetime(2026, 1, 3), 1, 1, "[]"),
            ("3", "m", "other", datetime(2026, 1, 1), datetime(2026, 1, 3), 1, 1, "[]")]
    df = spark.createDataFrame(rows, "order_no string, member_code string, channel string, wtime timestamp, updated_at timestamp, total_price bigint, total_payment_price bigint, sections string")
    got = by(ingest.latest_versions(df), "order_no", "sections", "same_update_rows", "total_price")
    assert got == {"1": ("[3]", 2, 30), "2": ("[]", 1, 1)}


def test_raw_item_digest_covers_unknown_fields(spark):
    import hashlib
    item = '{"orderItemCode":"c","orderSectionItemNo":"n","qty":2,"productInfo":{"prodNo":7,"prodName":"x"},"extra":[1,2]}'
    sections = f'[{{"orderSectionCode":"s","orderSectionNo":"1","orderSectionStatus":"{DONE}","sectionItems":[{item}]}},{{"sectionItems":[]}}]'
    df = spark.createDataFrame([("1", "m", "b2s", datetime(2026, 1, 1, 16), datetime(2026, 1, 2), 1, 1, sections)],
                               "order_no string, member_code string, channel string, wtime timestamp, updated_at timestamp, total_price bigint, total_payment_price bigint, sections string")
    row = ingest.web_items(df, date(2026, 1, 1), date(2026, 1, 31)).first()
    assert (str(row["ordered_on"]), row["product_id"], row["quantity"], row["section_position"], row["item_position"]) == ("2026-01-02", "7", 2, 0, 0)
    assert row["item_json_sha256"] == hashlib.sha256(item.encode()).hexdigest()
    assert orders_in_window(df, date(2026, 1, 1), date(2026, 1, 1)).count() == 0


def test_strict_csv(spark, tmp_path):
    good, bad, other = (tmp_path / n for n in ("good.csv", "bad.csv", "other.csv"))
    good.write_text('﻿a,b\n1,"x\ny"\n2,\n', encoding="utf-8")
    bad.write_text("a,b\n1,2,3\n4,5\n", encoding="utf-8")
    other.write_text("a,c\n1,2\n", encoding="utf-8")
    rows = empty_as_null(read_text_csv(spark, str(good), ["a", "b"], multiline=True)).collect()
    assert [tuple(r) for r in rows] == [("1", "x\ny"), ("2", None)]
    with pytest.raises(Exception):
        read_text_csv(spark, str(bad), ["a", "b"]).collect()
    flagged = read_text_csv(spark, str(bad), ["a", "b"], strict=False).cache()
    assert flagged.count() == 2 and corrupt_rows(flagged).count() == 1
    with pytest.raises(Exception):
        read_text_csv(spark, str(other), ["a", "b"]).collect()


def test_rhythm_rows_without_a_day_are_ignored(spark):
    df = spark.createDataFrame([("c", "p", date(2026, 1, 1), 3), ("c", "p", date(2026, 1, 5), 4), ("c", "q", None, 1)],
                               "customer_id string, product_id string, cart_on date, cart_quantity bigint")
    assert by(one_rhythm_per_pair(df), "product_id", "cart_on", "cart_quantity") == {"p": (date(2026, 1, 5), 4)}
