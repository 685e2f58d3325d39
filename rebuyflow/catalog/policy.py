"""Queries of the purchase policy and of the row-level quality checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuyflow.catalog.common import ITEMS_SQL, Catalog
from rebuyflow.operators import policy, quality
from rebuyflow.plans.stages import stage
from rebuyflow.sources import driver_tables as tables
from rebuyflow.sources.readers import shard

catalog = Catalog()

EXCLUSIONS_SQL = """
xp AS (SELECT DISTINCT p_type AS id, 'exclude_sample' AS reason FROM part WHERE p_type = 'PROMO'),
xc AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'exclude_internal_test' AS reason FROM customer WHERE c_acctbal < -900)"""

GROUPS_SQL = ITEMS_SQL + "," + EXCLUSIONS_SQL + """,
groups AS (
  SELECT order_id, product_id, COUNT(*) AS group_rows, SUM(quantity) AS group_quantity, MIN(customer_id) AS cust,
         CASE WHEN bool_or(section_status NOT IN ('CANCEL_COMPLETE','PURCHASE_CONFIRMATION','SHIPPING_COMPLETE','PRODUCT_PREPARATION','SHIPPING_READY',
                            'SHIPPING','RETURN_COMPLETE','EXCHANGE_PRODUCT_PREPARATION','EXCHANGE_PURCHASE_CONFIRMATION')) THEN 'hold_unknown_status'
              WHEN bool_or(section_status IN ('RETURN_COMPLETE','EXCHANGE_PRODUCT_PREPARATION','EXCHANGE_PURCHASE_CONFIRMATION')) THEN 'hold_return_exchange_linked'
              WHEN bool_or(section_status IN ('PRODUCT_PREPARATION','SHIPPING_READY','SHIPPING')) THEN 'hold_in_progress_linked'
              WHEN bool_and(section_status = 'CANCEL_COMPLETE') THEN 'exclude_cancelled'
              WHEN bool_or(section_status = 'CANCEL_COMPLETE') THEN 'hold_partial_cancel_linked' ELSE 'include_completed' END AS status_class
  FROM items GROUP BY 1, 2),
decided AS (
  SELECT groups.*, COALESCE(xc.reason, xp.reason, status_class) AS purchase_decision
  FROM groups LEFT JOIN xc ON cust = xc.id LEFT JOIN xp ON product_id = xp.id),
policy AS (
  SELECT items.*, purchase_decision, CASE WHEN purchase_decision = 'include_completed' THEN quantity END AS eligible_quantity,
         purchase_decision LIKE 'hold%' AS sequence_barrier
  FROM items JOIN decided USING (order_id, product_id))"""


def product_exclusions(spark, sf):
    return (tables.table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_type").alias("id")).distinct()
            .withColumn("reason", F.lit("exclude_sample")))


def customer_exclusions(spark, sf):
    return (tables.table(spark, sf, "customer").filter("c_acctbal < -900")
            .select(F.col("c_custkey").cast("string").alias("id"), F.lit("exclude_internal_test").alias("reason")))


def policy_rows(spark, sf, items=None):
    return policy.apply_policy(tables.order_items(spark, sf) if items is None else items, F.col("order_section_item_no"), product_exclusions(spark, sf),
                               customer_exclusions(spark, sf), policy.policy_version("product-exclusions-v2", customers=True), tables.line_orders(spark, sf))


@catalog.query("status_decision", f"""
WITH {ITEMS_SQL}
SELECT order_id, order_section_item_no,
       CASE WHEN section_status = 'CANCEL_COMPLETE' THEN 'exclude_cancelled'
            WHEN section_status IN ('PURCHASE_CONFIRMATION','SHIPPING_COMPLETE') THEN 'candidate_completed'
            WHEN section_status = 'SHIPPING' THEN 'review_in_progress'
            WHEN section_status = 'RETURN_COMPLETE' THEN 'review_return_exchange' ELSE 'review_unknown_status' END AS status_decision,
       COUNT(*) OVER (PARTITION BY order_id, order_item_code) > 1 AS repeated_item_code
FROM items""")
def status_decision(spark, sf):
    """Row decisions and repeated item codes; every row survives."""
    return (policy.annotate_status(tables.order_items(spark, sf), F.col("order_section_item_no"))
            .select("order_id", "order_section_item_no", "status_decision", "repeated_item_code"))


@catalog.query("group_classification", f"""
WITH {GROUPS_SQL}
SELECT order_id, product_id, group_rows, CAST(group_quantity AS BIGINT) AS group_quantity, status_class FROM groups""")
def group_classification(spark, sf):
    """Decision per order and product from statuses alone."""
    return (policy.group_decisions(tables.order_items(spark, sf))
            .select("order_id", "product_id", "group_rows", "group_quantity", F.col("purchase_decision").alias("status_class")))


@catalog.query("policy_rows", f"""
WITH {GROUPS_SQL} SELECT order_id, order_section_item_no, purchase_decision, eligible_quantity, sequence_barrier,
'purchase-policy-v4' AS policy_version FROM policy""")
def policy_rows_query(spark, sf):
    """Every row with the decision of its group."""
    return policy_rows(spark, sf).select("order_id", "order_section_item_no", "purchase_decision", "eligible_quantity",
                                         "sequence_barrier", "policy_version")


@catalog.query("policy_report", f"""
WITH {GROUPS_SQL} SELECT purchase_decision, COUNT(*) AS groups, CAST(SUM(group_rows) AS BIGINT) AS rows, CAST(SUM(group_quantity) AS BIGINT) AS raw_quantity
FROM decided GROUP BY 1""")
def policy_report(spark, sf):
    """Groups, rows and quantity by decision."""
    return policy.policy_report(policy.group_decisions(
        tables.order_items(spark, sf), product_exclusions(spark, sf), customer_exclusions(spark, sf)))


LIFECYCLE_SQL = ITEMS_SQL + """,
s AS (SELECT order_id, order_item_code, section_status, SUM(quantity) AS q, COUNT(*) AS c FROM items GROUP BY 1, 2, 3),
life AS (
  SELECT order_id, order_item_code, n AS source_rows, pattern, qs AS quantity_by_current_status,
         CASE WHEN low <> high THEN 'review_product_identity'
              WHEN ret THEN 'review_return_exchange_linked' WHEN ship THEN 'review_in_progress_linked'
              WHEN all_c THEN 'excluded_cancelled_group' WHEN some_c THEN 'review_partial_cancel_linked'
              ELSE 'completed_group_candidate' END AS linked_group_decision,
         CASE WHEN n > 1 THEN pattern END AS status_pattern
  FROM (SELECT order_id, order_item_code, COUNT(*) AS n,
               MIN(product_id) AS low, MAX(product_id) AS high, bool_or(section_status = 'RETURN_COMPLETE') AS ret,
               bool_or(section_status = 'SHIPPING') AS ship, bool_and(section_status = 'CANCEL_COMPLETE') AS all_c,
               bool_or(section_status = 'CANCEL_COMPLETE') AS some_c FROM items GROUP BY 1, 2)
  JOIN (SELECT order_id, order_item_code, '{' || string_agg('"' || section_status || '":' || q, ',' ORDER BY section_status) || '}' AS qs,
               string_agg(section_status || ':' || c, ' | ' ORDER BY section_status) AS pattern
        FROM s GROUP BY 1, 2) USING (order_id, order_item_code))"""


@catalog.query("item_lifecycle", f"""
WITH {LIFECYCLE_SQL} SELECT order_id, order_item_code, source_rows, quantity_by_current_status, linked_group_decision, status_pattern FROM life""")
def item_lifecycle(spark, sf):
    """Current quantities and status pattern of every order item code."""
    return policy.item_lifecycle(tables.order_items(spark, sf))


@catalog.query("lifecycle_report", f"""
WITH {LIFECYCLE_SQL} SELECT linked_group_decision, status_pattern, COUNT(*) AS item_groups, COUNT(*) FILTER (source_rows > 1) AS repeated_groups
FROM life GROUP BY 1, 2""")
def lifecycle_report(spark, sf):
    """Item groups by decision and pattern."""
    return policy.lifecycle_report(policy.item_lifecycle(tables.order_items(spark, sf)))


@catalog.query("disallowed_exclusions", f"""
WITH {EXCLUSIONS_SQL} SELECT id, reason FROM xc UNION ALL SELECT id, reason FROM xp WHERE reason <> 'exclude_prepaid_credit'""")
def disallowed_exclusions(spark, sf):
    """Reasons that version 1 of the product list would reject."""
    both = product_exclusions(spark, sf).unionByName(customer_exclusions(spark, sf))
    return policy.disallowed_exclusions(both, "product-exclusions-v1")


@catalog.query("unmatched_exclusions", f"""
WITH {ITEMS_SQL}, {EXCLUSIONS_SQL}
SELECT id FROM xc WHERE id NOT IN (SELECT customer_id FROM items)""")
def unmatched_exclusions(spark, sf):
    """Excluded customers without any order."""
    return policy.unmatched(customer_exclusions(spark, sf), tables.order_items(spark, sf), "customer_id")


# What the checks read of an item, and of its policy row.
CHECKED_COLUMNS = ["customer_id", "order_id", "product_id", "order_item_code", "order_section_item_no", "ordered_at", "ordered_on", "quantity",
                   "extracted_at", "section_status"]
DECIDED_COLUMNS = ["customer_id", "product_id", "quantity", "purchase_decision", "eligible_quantity", "sequence_barrier", "training_ready"]


@catalog.query("dq_violations", f"""
WITH {GROUPS_SQL}
SELECT 'repeated_section_item' AS check_name, COUNT(*) AS violations FROM (SELECT 1 FROM items GROUP BY order_id, order_section_item_no HAVING COUNT(*) > 1)
UNION ALL SELECT 'repeated_position', COUNT(*) FROM (SELECT 1 FROM items GROUP BY order_id, order_item_code HAVING COUNT(*) > 1)
UNION ALL SELECT 'bad_quantity', COUNT(*) FROM lineitem WHERE l_discount <= 0 OR l_discount <> CAST(l_discount AS BIGINT)
UNION ALL SELECT 'order_identity', COUNT(*) FROM (SELECT 1 FROM items GROUP BY order_id HAVING COUNT(DISTINCT (customer_id, ordered_at, ordered_on)) > 1)
UNION ALL SELECT 'item_product', COUNT(*) FROM (SELECT 1 FROM items GROUP BY order_id, order_item_code HAVING COUNT(DISTINCT product_id) > 1)
UNION ALL SELECT 'shard_overlap', CAST(0 AS BIGINT)
UNION ALL SELECT 'duplicate_shard', CAST(0 AS BIGINT)
UNION ALL SELECT 'annotation', CAST(0 AS BIGINT)
UNION ALL SELECT 'exclusion', CAST(0 AS BIGINT)
UNION ALL SELECT 'time', COUNT(*) FROM items WHERE CAST(ordered_at + INTERVAL 9 HOURS AS DATE) <> ordered_on OR extracted_at < ordered_at""")
def dq_violations(spark, sf):
    """Violations per check over the item rows (discounts stand in for raw quantities to exercise the value check)."""
    items = stage(tables.order_items(spark, sf).select(*CHECKED_COLUMNS), "items")
    rows = stage(policy_rows(spark, sf, items).select(*DECIDED_COLUMNS), "policy")
    parts = [shard(items.select("order_id", "order_section_item_no"), "order_id", 3, i) for i in range(3)]
    discounts = tables.table(spark, sf, "lineitem").select(
        F.col("l_discount").cast("decimal(18,2)").cast("string").alias("quantity_raw"), F.col("l_discount").cast("bigint").alias("quantity"))
    return quality.report({
        "repeated_section_item": quality.repeated(items, ["order_id", "order_section_item_no"]),
        "repeated_position": quality.repeated(items, ["order_id", "order_item_code"]),
        "bad_quantity": quality.bad_quantity(discounts),
        "order_identity": quality.conflicting(items, ["order_id"], ["customer_id", "ordered_at", "ordered_on"]),
        "item_product": quality.conflicting(items, ["order_id", "order_item_code"], ["product_id"]),
        "shard_overlap": quality.overlapping_orders(parts),
        "duplicate_shard": quality.duplicate_shards(parts),
        "annotation": quality.annotation_errors(rows),
        "exclusion": quality.exclusion_errors(rows, product_exclusions(spark, sf), customer_exclusions(spark, sf)),
        "time": quality.time_errors(items)})


@catalog.query("content_fingerprint", f"""
WITH {ITEMS_SQL} SELECT COUNT(*) AS rows, CAST(SUM(CAST(CAST('0x' || substr(md5(customer_id || '|' || order_id || '|' || order_section_item_no || '|' || quantity), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS content
FROM items""")
def content_fingerprint(spark, sf):
    """Order-free fingerprint of the item table."""
    return quality.fingerprint(tables.order_items(spark, sf).select("customer_id", "order_id", "order_section_item_no", "quantity"))
