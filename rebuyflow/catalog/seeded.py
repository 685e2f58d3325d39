"""Quality checks over violations planted in the given tables by a rule, so that a check that never fires is seen."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from rebuyflow.catalog.common import ITEMS_SQL, Catalog
from rebuyflow.catalog.evaluation import SCORED_SQL, stored_scored
from rebuyflow.catalog.events import DAY_LABELS_SQL, EVENTS_SQL, stored_links
from rebuyflow.catalog.features import HISTORY_SQL, SPLIT, origins
from rebuyflow.catalog.policy import DECIDED_COLUMNS, EXCLUSIONS_SQL, GROUPS_SQL, customer_exclusions, policy_rows, product_exclusions
from rebuyflow.functions.scalars import count_if
from rebuyflow.operators import events, ingest, policy, quality
from rebuyflow.plans.stages import stage
from rebuyflow.sources import driver_tables as tables
from rebuyflow.sources.readers import shard

catalog = Catalog()
SHARD_SQL = "CAST('0x' || substr(md5(order_id), 1, 15) AS BIGINT) % 3"


@catalog.query("seeded_shards", f"""
WITH {ITEMS_SQL} SELECT 'shard_overlap' AS check_name, COUNT(DISTINCT order_id) AS violations FROM items WHERE CAST(order_id AS BIGINT) % 97 = 0 AND {SHARD_SQL} <> 2
UNION ALL SELECT 'duplicate_shard', (SELECT COUNT(*) FROM (SELECT h FROM (
  SELECT 0 AS s, list(order_section_item_no ORDER BY order_section_item_no) AS h FROM items WHERE {SHARD_SQL} = 0 UNION ALL
  SELECT 1, list(order_section_item_no ORDER BY order_section_item_no) FROM items WHERE {SHARD_SQL} = 1 UNION ALL
  SELECT 2, list(order_section_item_no ORDER BY order_section_item_no) FROM items WHERE {SHARD_SQL} = 0) GROUP BY h HAVING COUNT(*) > 1))""")
def seeded_shards(spark, sf):
    """Orders copied into a second shard, and a shard given twice."""
    items = stage(tables.order_items(spark, sf).select("order_id", "order_section_item_no"), "items")
    parts = [shard(items, "order_id", 3, i) for i in range(3)]
    copied = [*parts[:2], parts[2].unionByName(items.filter(F.col("order_id").cast("bigint") % 97 == 0))]
    return quality.report({"shard_overlap": quality.overlapping_orders(copied), "duplicate_shard": quality.duplicate_shards([parts[0], parts[1], parts[0]])})


@catalog.query("seeded_policy", f"""
WITH {GROUPS_SQL}
SELECT 'annotation' AS check_name, COUNT(*) AS violations FROM policy WHERE order_item_code = '2'
UNION ALL SELECT 'exclusion', COUNT(*) FROM policy WHERE (CAST(customer_id AS BIGINT) % 40 = 0 AND purchase_decision <> 'exclude_audit')
  OR (CAST(customer_id AS BIGINT) % 40 <> 0 AND purchase_decision LIKE 'exclude%' AND purchase_decision <> 'exclude_cancelled')
UNION ALL SELECT 'quantity', COUNT(*) FROM items WHERE order_item_code = '3' OR quantity <= 0 OR quantity % 10 = 7""")
def seeded_policy(spark, sf):
    """Eligible quantities changed on second items, an exclusion list that was not applied, and damaged raw quantities."""
    rows = stage(policy_rows(spark, sf).select(*DECIDED_COLUMNS, "order_item_code"), "policy")
    second = F.col("order_item_code") == "2"
    changed = rows.withColumn("eligible_quantity", F.when(second, F.coalesce("eligible_quantity", F.lit(0)) + 1).otherwise(F.col("eligible_quantity")))
    audit = (tables.table(spark, sf, "customer").filter("c_custkey % 40 = 0")
             .select(F.col("c_custkey").cast("string").alias("id"), F.lit("exclude_audit").alias("reason")))
    raw = (F.when(F.col("order_item_code") == "3", F.lit("n/a")).when(F.col("quantity") % 10 == 7, F.concat(F.col("quantity").cast("string"), F.lit(".5")))
           .otherwise(F.col("quantity").cast("string")))
    return quality.report({"annotation": quality.annotation_errors(changed), "exclusion": quality.exclusion_errors(rows, None, audit),
                           "quantity": quality.bad_quantity(tables.order_items(spark, sf).withColumn("quantity_raw", raw))})


@catalog.query("seeded_reconciliation", f"""
WITH {EVENTS_SQL} SELECT COUNT(DISTINCT event_id) AS errors FROM links WHERE section_status = 'SHIPPING_COMPLETE' AND order_section_item_no < '4'""")
def seeded_reconciliation(spark, sf):
    """Events whose links were partly lost."""
    lost = (F.col("section_status") == "SHIPPING_COMPLETE") & (F.col("order_section_item_no") < "4")
    links, made = stored_links(spark, sf, traced=False, lost=lost)
    return quality.reconciliation_errors(links.filter(~F.col("lost")), made).agg(F.count("*").alias("errors"))


@catalog.query("seeded_labels", f"""
WITH {DAY_LABELS_SQL} SELECT COUNT(*) FILTER (label_state = 'observed' AND day(origin_on) = 15) AS shifted,
COUNT(*) FILTER (day(origin_on) = 9) AS lost FROM labels""")
def seeded_labels(spark, sf):
    """Targets moved by a day, and days that lost their label."""
    made = stage(tables.daily_events(spark, sf), "events")
    labels = stage(events.next_purchase_labels(made), "labels")
    sequenced = events.with_episodes(made)
    moved = labels.withColumn("target_on", F.when(F.dayofmonth("origin_on") == 15, F.date_add("target_on", 1)).otherwise(F.col("target_on")))
    a = quality.label_errors(moved, sequenced).agg(F.count("*").alias("shifted"))
    b = quality.label_errors(labels.filter(F.dayofmonth("origin_on") != 9), sequenced).agg(F.count("*").alias("lost"))
    return a.join(F.broadcast(b))  # one row each


@catalog.query("seeded_split", f"""
WITH {HISTORY_SQL}, t AS (SELECT * FROM origins WHERE train_pool), v AS (SELECT * FROM origins WHERE fit_role = 'validation' AND split_outcome = 'observed')
SELECT 'split' AS check_name, COUNT(*) AS violations FROM t WHERE qty_last % 3 = 0
UNION ALL SELECT 'overlap', COUNT(*) FROM t WHERE target_quantity % 5 = 0
UNION ALL SELECT 'leak', CASE WHEN (SELECT MAX(target_on) FROM v) >= (SELECT MIN(origin_on) FROM v) THEN 1 ELSE 0 END""")
def seeded_split(spark, sf):
    """History counts changed, training rows put into validation, and a training target inside validation."""
    rows = stage(origins(spark, sf), "origins")
    train, valid = rows.filter("train_pool"), rows.filter("fit_role = 'validation' AND role_eligible")
    changed = train.withColumn("gap_count", F.when(F.col("qty_last") % 3 == 0, F.col("gap_count") + 1).otherwise(F.col("gap_count")))
    return quality.report({"split": quality.split_errors(changed, SPLIT.start, SPLIT.train_end, "train"),
                           "overlap": quality.overlap(train, train.filter("target_quantity % 5 = 0").unionByName(valid), "origin_event_id"),
                           "leak": quality.leaks(valid, valid)})


@catalog.query("seeded_population", f"""
WITH {SCORED_SQL} SELECT COUNT(DISTINCT origin_event_id) FILTER (day(origin_on) % 4 = 1 OR (day(origin_on) % 4 <> 1 AND tq % 4 = 2)) AS differences FROM scored""")
def seeded_population(spark, sf):
    """Origins missing from one candidate, and truths that differ."""
    rows = stored_scored(spark, sf)
    a, b = (rows.filter(F.col("candidate") == c) for c in ("pair_median_qlast", "recent3_gap_qlast"))
    b = b.filter(F.dayofmonth("origin_on") % 4 != 1).withColumn("target_quantity", F.when(F.col("target_quantity") % 4 == 2, F.col("target_quantity") + 1).otherwise(F.col("target_quantity")))
    return quality.population_differences(a, b, "origin_event_id", ["customer_id", "target_quantity"]).agg(F.count("*").alias("differences"))


@catalog.query("seeded_exclusions", f"""
WITH {ITEMS_SQL}, {EXCLUSIONS_SQL}
SELECT 'reappeared_customer' AS check_name, COUNT(*) AS violations FROM items WHERE customer_id IN (SELECT id FROM xc)
UNION ALL SELECT 'reappeared_product', COUNT(*) FROM items WHERE product_id IN (SELECT id FROM xp)
UNION ALL SELECT 'unmatched_customer', COUNT(*) FROM (SELECT n_name AS id FROM nation UNION ALL SELECT id FROM xc) WHERE id NOT IN (SELECT customer_id FROM items)
UNION ALL SELECT 'unmatched_product', COUNT(*) FROM (SELECT r_name AS id FROM region UNION ALL SELECT id FROM xp) WHERE id NOT IN (SELECT product_id FROM items)""")
def seeded_exclusions(spark, sf):
    """Rows to which no exclusion was applied, and lists with names that no order holds."""
    items = stage(tables.order_items(spark, sf).select("customer_id", "product_id"), "items")
    xc, xp = customer_exclusions(spark, sf), product_exclusions(spark, sf)
    def with_names(exclusions, name, column):
        names = tables.table(spark, sf, name).select(F.col(column).alias("id"))
        return exclusions.select("id").unionByName(names)
    return quality.report({"reappeared_customer": quality.reappeared(items, xc, "customer_id"), "reappeared_product": quality.reappeared(items, xp, "product_id"),
                           "unmatched_customer": policy.unmatched(with_names(xc, "nation", "n_name"), items, "customer_id"),
                           "unmatched_product": policy.unmatched(with_names(xp, "region", "r_name"), items, "product_id")})


@catalog.query("mixed_parses", """
SELECT 'day' AS column_name, COUNT(*) FILTER (o_orderkey % 7 = 0) AS invalid FROM orders
UNION ALL SELECT 'price', COUNT(*) FILTER (o_orderkey % 5 IN (0, 1)) FROM orders""")
def mixed_parses(spark, sf):
    """Good and bad text in one column: words among dates, words and missing values among numbers."""
    key = F.col("o_orderkey")
    rows = tables.table(spark, sf, "orders").select(
        F.when(key % 7 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("day"),
        F.when(key % 5 == 0, F.col("o_orderstatus")).when(key % 5 != 1, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"))
    return ingest.invalid_values(rows, ["day"], ["price"])


@catalog.query("merge_contract", f"""
WITH {ITEMS_SQL}, m AS (SELECT *, CASE WHEN CAST(order_id AS BIGINT) % 11 = 0 THEN 2 ELSE 1 END AS ties FROM items)
SELECT COUNT(*) AS rows, COUNT(DISTINCT order_id) AS orders, COUNT(DISTINCT customer_id) AS customers, COUNT(DISTINCT order_id) FILTER (ties > 1) AS tie_orders,
(SELECT COUNT(*) FROM (SELECT 1 FROM items GROUP BY order_id, order_item_code HAVING COUNT(*) > 1)) AS repeated_order_item_codes,
MIN(ordered_on) AS date_min, MAX(ordered_on) AS date_max, COUNT(DISTINCT section_status) AS statuses,
CAST(SUM(quantity) AS BIGINT) AS quantity_sum,
(SELECT COUNT(*) FROM (SELECT 1 FROM items GROUP BY order_id, order_section_item_no HAVING COUNT(*) > 1)) AS repeated_positions FROM m""")
def merge_contract(spark, sf):
    """Union of three shards against its contract: rows, ties, statuses, quantity, repeated codes and positions."""
    items = tables.order_items(spark, sf).withColumn("latest_timestamp_row_count", F.when(F.col("order_id").cast("bigint") % 11 == 0, 2).otherwise(1).cast("bigint"))
    merged = stage(ingest.merge_shards([shard(items, "order_id", 3, i) for i in range(3)]), "merged")
    facts = merged.agg(F.sum("quantity").alias("quantity_sum"), F.countDistinct("section_status").alias("statuses"))
    positions = quality.repeated(merged, ["order_id", "order_section_item_no"]).agg(F.count("*").alias("repeated_positions"))
    return ingest.merge_manifest(merged).join(F.broadcast(facts)).join(F.broadcast(positions))  # one row each
