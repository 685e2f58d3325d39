"""Queries of order ingestion and of the raw structural profile."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from rebuyflow.catalog.common import APP_SQL, ITEMS_SQL, UNNEST_SQL, VERSIONS_SQL, Catalog
from rebuyflow.operators import ingest
from rebuyflow.plans.stages import stage
from rebuyflow.sources import driver_tables as tables
from rebuyflow.sources.readers import shard

catalog = Catalog()
WINDOW = (date(1995, 6, 1), date(2001, 5, 31))
KEYS = ["customer_id", "order_id", "product_id"]


@catalog.query("latest_version", f"""
WITH {VERSIONS_SQL}
SELECT order_no, CAST(updated_at AS DATE) AS updated_on, CAST(same_update_rows AS BIGINT) AS same_update_rows, sections,
       member_code, total_price, total_payment_price FROM latest""")
def latest_version(spark, sf):
    """Latest version of every order under the full tie-break."""
    return (ingest.latest_versions(tables.order_versions(spark, sf))
            .select("order_no", F.to_date("updated_at").alias("updated_on"), "same_update_rows", "sections", "member_code",
                    "total_price", "total_payment_price"))


@catalog.query("version_ties", f"""
WITH {VERSIONS_SQL}
SELECT order_no, CAST(updated_at AS DATE) AS updated_on, CAST(same_update_rows AS BIGINT) AS same_update_rows
FROM latest WHERE same_update_rows > 1""")
def version_ties(spark, sf):
    """Orders whose latest timestamp is shared by several versions."""
    return (ingest.version_ties(tables.order_versions(spark, sf))
            .select("order_no", F.to_date("updated_at").alias("updated_on"), "same_update_rows"))


@catalog.query("canonical_positions", f"""
WITH {ITEMS_SQL}
SELECT order_id, order_item_code, order_section_item_no, ROW_NUMBER() OVER (ORDER BY ordered_on, order_id, order_item_code, order_section_item_no) AS position FROM items""")
def canonical_positions(spark, sf):
    """Every order item with its position in the export order."""
    items = tables.order_items(spark, sf).select("ordered_on", "order_id", "order_item_code", "order_section_item_no")
    return ingest.canonical_positions(items, items.columns).drop("ordered_on")


def _web(spark, sf, *window):
    return ingest.web_items(tables.order_versions(spark, sf), *window, extracted_at=F.lit(None).cast("timestamp"))


ITEM_COLUMNS = ["customer_id", "order_id", "ordered_on", "latest_timestamp_row_count", "order_total", "paid_total",
                "section_position", "item_position", "order_section_code", "order_section_no", "section_status",
                "order_item_code", "order_section_item_no", "product_id", "product_name", "quantity_raw", "quantity"]


@catalog.query("unnest_items", f"WITH {UNNEST_SQL} SELECT {', '.join(ITEM_COLUMNS)} FROM web")
def unnest_items(spark, sf):
    """Nested JSON orders to item rows with positions."""
    return _web(spark, sf, *WINDOW).select(*ITEM_COLUMNS)


@catalog.query("safe_cast_quantity", f"""
WITH {UNNEST_SQL}
SELECT quantity_raw, quantity, COUNT(*) AS n FROM every_web GROUP BY quantity_raw, quantity""")
def safe_cast_quantity(spark, sf):
    """Whole-number quantities; anything else is NULL."""
    return _web(spark, sf).groupBy("quantity_raw", "quantity").agg(F.count("*").alias("n"))


@catalog.query("item_hash", f"WITH {UNNEST_SQL} SELECT order_id, section_position, item_position, item_json_sha256 FROM every_web")
def item_hash(spark, sf):
    """Content digest of every raw item."""
    return _web(spark, sf).select("order_id", "section_position", "item_position", "item_json_sha256")


@catalog.query("union_sources", f"""
WITH {UNNEST_SQL}, {APP_SQL}
SELECT {', '.join(ITEM_COLUMNS)} FROM web UNION ALL SELECT {', '.join(ITEM_COLUMNS)} FROM app""")
def union_sources(spark, sf):
    """Web and app items in one table."""
    return ingest.extract_items(tables.order_versions(spark, sf), *WINDOW,
                                app_orders=tables.app_orders(spark, sf)).select(*ITEM_COLUMNS)


@catalog.query("status_map", f"WITH {APP_SQL} SELECT section_status, COUNT(*) AS n FROM every_app GROUP BY 1")
def status_map(spark, sf):
    """App order states under the web vocabulary."""
    return (ingest.app_items(tables.app_orders(spark, sf))
            .groupBy("section_status").agg(F.count("*").alias("n")))


@catalog.query("missing_identity_report", f"""
WITH {VERSIONS_SQL},
i AS (SELECT json_extract(s, '$.sectionItems[*]') AS its FROM (
        SELECT unnest(json_extract(CAST(sections AS JSON), '$[*]')) AS s FROM latest
        WHERE CAST(wtime + INTERVAL 9 HOURS AS DATE) BETWEEN DATE '1995-06-01' AND DATE '2001-05-31')),
x AS (SELECT unnest(its) AS item FROM i)
SELECT CAST(item->'$.productInfo' AS VARCHAR) AS product_info, CAST(to_json(json_keys(item)) AS VARCHAR) AS item_keys,
       COUNT(*) AS item_rows
FROM x WHERE item->>'$.productInfo.prodNo' IS NULL GROUP BY 1, 2 ORDER BY item_rows DESC, product_info, item_keys LIMIT 5""")
def missing_identity_report(spark, sf):
    """Most frequent metadata of items without a product number."""
    return ingest.missing_identity(tables.order_versions(spark, sf), *WINDOW)


@catalog.query("test_accounts", """
SELECT CAST(o_custkey AS VARCHAR) AS customer_id FROM (
  SELECT o_custkey, o_orderpriority, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC) AS rn
  FROM orders) WHERE rn = 1 AND trim(o_orderpriority) = '5-LOW'""")
def test_accounts(spark, sf):
    """Customers whose latest record carries the test name (here: the lowest priority)."""
    members = tables.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("member_code"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderpriority").alias("name"))
    return ingest.test_accounts(members, "5-LOW")


def items_with_gaps(spark, sf):
    """Order items where every 400th order has no product number."""
    items = tables.order_items(spark, sf)
    return items.withColumn("product_id", F.when(F.col("order_id").cast("bigint") % 400 != 0, F.col("product_id")))


@catalog.query("quarantine", f"""
WITH {ITEMS_SQL}, g AS (SELECT * REPLACE (CASE WHEN CAST(order_id AS BIGINT) % 400 <> 0 THEN product_id END AS product_id) FROM items),
c AS (SELECT customer_id, MAX(ordered_on) AS cutoff FROM g WHERE product_id IS NULL GROUP BY 1)
SELECT g.customer_id, order_section_item_no,
       CASE WHEN ordered_on <= cutoff THEN CASE WHEN product_id IS NULL THEN 'missing_product_id' ELSE 'prefix_before_unknown_product' END END AS quarantine_reason
FROM g LEFT JOIN c USING (customer_id)""")
def quarantine(spark, sf):
    """Rows set aside up to a customer's last unidentified product."""
    return (ingest.quarantine(items_with_gaps(spark, sf), F.col("order_section_item_no"))
            .select("customer_id", "order_section_item_no", "quarantine_reason"))


@catalog.query("late_cutoffs", f"""
WITH {ITEMS_SQL} SELECT customer_id, MAX(ordered_on) AS cutoff FROM items WHERE CAST(order_id AS BIGINT) % 400 = 0
GROUP BY 1 HAVING MAX(ordered_on) > DATE '2000-01-01'""")
def late_cutoffs(spark, sf):
    """Customers whose quarantine would reach past the training end."""
    return ingest.late_cutoffs(items_with_gaps(spark, sf), date(2000, 1, 1))


@catalog.query("shard_sample", f"""
WITH {ITEMS_SQL} SELECT order_id, order_section_item_no FROM items WHERE CAST('0x' || substr(md5(order_id), 1, 15) AS BIGINT) % 3 = 0""")
def shard_sample(spark, sf):
    """One of three hash-disjoint shards of the item rows (the feature itself is the share)."""
    return shard(tables.order_items(spark, sf), "order_id", 3, 0).select("order_id", "order_section_item_no")


@catalog.query("shard_merge", f"""
WITH {ITEMS_SQL} SELECT COUNT(*) AS rows, COUNT(DISTINCT order_id) AS orders, COUNT(DISTINCT customer_id) AS customers,
CAST(0 AS BIGINT) AS tie_orders,
(SELECT COUNT(*) FROM (SELECT 1 FROM items GROUP BY order_id, order_item_code HAVING COUNT(*) > 1)) AS repeated_order_item_codes, MIN(ordered_on) AS date_min, MAX(ordered_on) AS date_max FROM items""")
def shard_merge(spark, sf):
    """Manifest of the union of three disjoint shards."""
    items = tables.order_items(spark, sf).withColumn("latest_timestamp_row_count", F.lit(1).cast("bigint"))
    shards = [shard(items, "order_id", 3, i) for i in range(3)]
    return ingest.merge_manifest(stage(ingest.merge_shards(shards).select(
        "order_id", "customer_id", "order_item_code", "latest_timestamp_row_count", "ordered_on"), "merged"))


@catalog.query("structural_profile", f"""
WITH {ITEMS_SQL} SELECT COUNT(*) AS row_count, COUNT(DISTINCT customer_id) AS unique_customers, COUNT(DISTINCT order_id) AS unique_orders,
COUNT(DISTINCT product_id) AS unique_products, COUNT(DISTINCT (customer_id, product_id)) AS unique_pairs,
MIN(ordered_on) AS date_min, MAX(ordered_on) AS date_max, CAST(MAX(ordered_on) - MIN(ordered_on) + 1 AS BIGINT) AS calendar_days,
COUNT(*) FILTER (quantity = 0) AS zero_rows, COUNT(*) FILTER (quantity < 0) AS negative_rows,
MIN(quantity) AS quantity_min, MAX(quantity) AS quantity_max, CAST(SUM(quantity) AS BIGINT) AS quantity_sum FROM items""")
def structural_profile(spark, sf):
    """Counts, distinct counts, date range and quantity checks in one row."""
    return ingest.structural_profile(tables.order_items(spark, sf))


@catalog.query("missing_values", f"""
WITH {UNNEST_SQL}
SELECT unnest(['customer_id','product_id','product_name','quantity_raw','quantity']) AS column_name,
       unnest([COUNT(*) FILTER (customer_id IS NULL), COUNT(*) FILTER (product_id IS NULL), COUNT(*) FILTER (product_name IS NULL),
               COUNT(*) FILTER (quantity_raw IS NULL), COUNT(*) FILTER (quantity IS NULL)]) AS missing
FROM every_web""")
def missing_values(spark, sf):
    """Missing values per column."""
    return ingest.missing_by_column(_web(spark, sf).select("customer_id", "product_id", "product_name", "quantity_raw", "quantity"))


@catalog.query("invalid_parses", """
SELECT 'o_orderpriority' AS column_name, COUNT(*) AS invalid FROM orders
UNION ALL SELECT 'order_day', CAST(0 AS BIGINT)
UNION ALL SELECT 'o_orderstatus', COUNT(*) FROM orders
UNION ALL SELECT 'price', CAST(0 AS BIGINT)""")
def invalid_parses(spark, sf):
    """Text values that do not parse as a date or as a number."""
    orders = tables.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").cast("string").alias("order_day"), "o_orderpriority",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), "o_orderstatus")
    return ingest.invalid_values(orders, ["order_day", "o_orderpriority"], ["price", "o_orderstatus"])


@catalog.query("duplicate_accounting", """
WITH e AS (SELECT COUNT(*) AS n FROM (SELECT lineitem AS whole FROM lineitem) GROUP BY whole),
k AS (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT 'exact_row' AS scope, COUNT(*) FILTER (n > 1) AS repeated_groups, CAST(SUM(n - 1) AS BIGINT) AS surplus_rows FROM e
UNION ALL SELECT 'key', COUNT(*) FILTER (n > 1), CAST(SUM(n - 1) AS BIGINT) FROM k""")
def duplicate_accounting(spark, sf):
    """Repeated rows and keys of the raw lines."""
    return ingest.duplicate_accounting(tables.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@catalog.query("order_conflicts", """
SELECT unnest(['product_id','section_status','ordered_on','customer_id']) AS field, unnest([
  COUNT(*) FILTER (p > 1), COUNT(*) FILTER (s > 1), COUNT(*) FILTER (d > 1), COUNT(*) FILTER (c > 1)]) AS conflicting_orders
FROM (WITH """ + ITEMS_SQL + """ SELECT order_id, COUNT(DISTINCT product_id) AS p, COUNT(DISTINCT section_status) AS s,
  COUNT(DISTINCT ordered_on) AS d, COUNT(DISTINCT customer_id) AS c FROM items GROUP BY 1)""")
def order_conflicts(spark, sf):
    """Orders with differing values of a field."""
    return ingest.order_conflicts(tables.order_items(spark, sf), ["product_id", "section_status", "ordered_on", "customer_id"])


@catalog.query("order_histogram", f"""
WITH {ITEMS_SQL} SELECT orders, COUNT(*) AS keys FROM (SELECT customer_id, product_id, COUNT(DISTINCT order_id) AS orders FROM items GROUP BY 1, 2) GROUP BY 1""")
def order_histogram(spark, sf):
    """Pairs by number of orders."""
    return ingest.order_histogram(tables.order_items(spark, sf), ["customer_id", "product_id"])


@catalog.query("customer_activity", f"""
WITH {ITEMS_SQL}, d AS (SELECT customer_id, ordered_on, COUNT(DISTINCT order_id) AS orders FROM items GROUP BY 1, 2),
c AS (SELECT customer_id, COUNT(*) AS days, COUNT(*) FILTER (orders > 1) AS busy FROM d GROUP BY 1)
SELECT COUNT(*) FILTER (days >= 3) AS customers_with_three_days, CAST(SUM(busy) AS BIGINT) AS customer_days_with_several_orders FROM c""")
def customer_activity(spark, sf):
    """Repeat buyers and busy days."""
    return ingest.customer_activity(tables.order_items(spark, sf))


@catalog.query("repeated_keys", f"""
WITH {ITEMS_SQL} SELECT customer_id, order_id, product_id, COUNT(*) AS source_record_count FROM items GROUP BY 1, 2, 3 HAVING COUNT(*) > 1""")
def repeated_keys(spark, sf):
    """Customer-order-product keys occurring more than once."""
    return ingest.repeated_keys(tables.order_items(spark, sf), KEYS)


@catalog.query("visit_gap_summary", f"""
WITH {ITEMS_SQL}, d AS (SELECT DISTINCT customer_id, ordered_on FROM items),
g AS (SELECT ordered_on - LAG(ordered_on) OVER (PARTITION BY customer_id ORDER BY ordered_on) AS gap FROM d)
SELECT COUNT(gap) AS gap_count, CAST(MIN(gap) AS INT) AS gap_min, CAST(MAX(gap) AS INT) AS gap_max FROM g""")
def visit_gap_summary(spark, sf):
    """Gaps between a customer's purchase days."""
    return ingest.visit_gap_summary(tables.order_items(spark, sf))


@catalog.query("customer_item_history", """
SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderdate AS DATE) AS ordered_on, CAST(l_orderkey AS VARCHAR) AS order_id,
       l_partkey AS product_no, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def customer_item_history(spark, sf):
    """Lossless item history per customer."""
    records = tables.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_partkey").alias("product_no"),
        F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("bigint").alias("quantity"))
    orders = tables.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("ordered_on"))
    return ingest.customer_item_history(records, orders).select("customer_id", "ordered_on", "order_id", "product_no", "line", "quantity")


@catalog.query("status_counts", f"WITH {ITEMS_SQL} SELECT section_status, COUNT(*) AS rows FROM items GROUP BY 1")
def status_counts(spark, sf):
    """Rows per section status."""
    return ingest.status_counts(tables.order_items(spark, sf))
