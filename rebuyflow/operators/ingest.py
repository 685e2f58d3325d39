"""From versioned nested orders to order item rows, and the structural profile of raw rows."""
from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.functions.calendar import local_date, within_local_days
from rebuyflow.plans.ordering import with_positions
from rebuyflow.plans.skew import attach_group_facts
from rebuyflow.schemas import same_schema

# `sectionItems` stays raw JSON text so that the item digest covers fields the schema does not name.
SECTIONS = ("array<struct<orderSectionCode:string,orderSectionNo:string,orderSectionStatus:string,"
            "sectionItems:array<string>>>")
ITEM = "orderItemCode string, orderSectionItemNo string, qty string, productInfo struct<prodNo:string,prodName:string>"
APP_ITEM = "productId string, productName string, quantity string"

# App order status -> web section status.
APP_STATUS = {"paid": "PRODUCT_PREPARATION", "preparing": "PRODUCT_PREPARATION", "shipping": "SHIPPING",
              "delivered": "SHIPPING_COMPLETE", "cancelled": "CANCEL_COMPLETE", "refunded": "RETURN_COMPLETE"}


RANK = ("updated_at", "sections", "member_code", "wtime", "total_price", "total_payment_price")


def latest_versions(versions: DataFrame, channel: str | None = "b2s") -> DataFrame:
    """Latest version per order with the number of rows sharing its timestamp.

    Ties are broken by sections, member, order time and totals, all descending (NULL last). The source is read once:
    the greatest version and the number of rows are combined per order and timestamp, then per order, both before the
    shuffle, so an order with very many versions never gathers in one task.
    """
    if channel is not None:
        versions = versions.filter(F.col("channel") == channel)
    per_time = versions.groupBy("order_no", "updated_at").agg(F.count("*").alias("n"), F.max(F.struct(*RANK)).alias("version"))
    latest = per_time.groupBy("order_no").agg(F.max(F.struct("version", "n")).alias("last"))
    return latest.select("order_no", *[F.col(f"last.version.{c}").alias(c) for c in RANK], F.col("last.n").alias("same_update_rows"))


def version_ties(versions: DataFrame, channel: str | None = "b2s") -> DataFrame:
    """Orders whose latest timestamp occurs in more than one row."""
    if channel is not None:
        versions = versions.filter(F.col("channel") == channel)
    counts = versions.groupBy("order_no", "updated_at").agg(F.count("*").alias("n"))
    latest = counts.groupBy("order_no").agg(F.max("updated_at").alias("updated_at"), F.max_by("n", "updated_at").alias("same_update_rows"))
    return latest.filter("same_update_rows > 1")


def safe_bigint(text: Column) -> Column:
    """Whole-number text to BIGINT, NULL otherwise."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.try_cast("bigint"))


def web_items(versions: DataFrame, start: date | None = None, end: date | None = None, extracted_at: Column | None = None) -> DataFrame:
    """Item rows of the latest versions ordered within the local window, or of any day without one; empty sections yield nothing."""
    latest = latest_versions(versions).filter(F.col("member_code").isNotNull()).withColumn("ordered_on", local_date(F.col("wtime")))
    if start is not None:
        latest = latest.filter(F.col("ordered_on").between(F.lit(start), F.lit(end)))
    sections = latest.select("*", F.posexplode(F.from_json("sections", SECTIONS)).alias("section_position", "s"))
    items = sections.select("*", F.posexplode("s.sectionItems").alias("item_position", "item_json"))
    parsed = items.withColumn("i", F.from_json("item_json", ITEM))
    return parsed.select(
        (extracted_at if extracted_at is not None else F.current_timestamp()).alias("extracted_at"),
        F.col("member_code").alias("customer_id"), F.col("order_no").alias("order_id"), F.col("wtime").alias("ordered_at"),
        "ordered_on", F.col("updated_at").alias("source_updated_at"),
        F.col("same_update_rows").alias("latest_timestamp_row_count"), F.col("total_price").alias("order_total"),
        F.col("total_payment_price").alias("paid_total"), "section_position", "item_position",
        F.col("s.orderSectionCode").alias("order_section_code"), F.col("s.orderSectionNo").alias("order_section_no"),
        F.col("s.orderSectionStatus").alias("section_status"), F.col("i.orderItemCode").alias("order_item_code"),
        F.col("i.orderSectionItemNo").alias("order_section_item_no"), F.col("i.productInfo.prodNo").alias("product_id"),
        F.col("i.productInfo.prodName").alias("product_name"), F.col("i.qty").alias("quantity_raw"),
        safe_bigint(F.col("i.qty")).alias("quantity"), F.sha2("item_json", 256).alias("item_json_sha256"))


def app_status(status: Column) -> Column:
    """Web section status of an app order status; unknown ones keep a visible prefix."""
    known = reduce(lambda chain, pair: chain.when(status == pair[0], pair[1]), APP_STATUS.items(), F)
    return known.otherwise(F.concat(F.lit("APP_"), F.upper(status)))


def app_items(orders: DataFrame, start: date | None = None, end: date | None = None, extracted_at: Column | None = None) -> DataFrame:
    """Item rows of app orders in the columns of `web_items`; the id prefix keeps the two sources apart."""
    paid = orders.filter("member_code IS NOT NULL AND paid_at IS NOT NULL").withColumn("ordered_on", local_date(F.col("paid_at")))
    if start is not None:
        paid = paid.filter(within_local_days(F.col("paid_at"), start, end)).filter(F.col("ordered_on").between(F.lit(start), F.lit(end)))
    items = (paid.select("*", F.posexplode(F.from_json("items", "array<string>")).alias("item_position", "item_json"))
             .withColumn("i", F.from_json("item_json", APP_ITEM)))
    position = F.col("item_position").cast("string")
    return items.select(
        (extracted_at if extracted_at is not None else F.current_timestamp()).alias("extracted_at"),
        F.col("member_code").alias("customer_id"), F.concat(F.lit("APP-"), "order_id").alias("order_id"),
        F.col("paid_at").alias("ordered_at"), "ordered_on", F.col("updated_at").alias("source_updated_at"),
        F.lit(1).cast("bigint").alias("latest_timestamp_row_count"), F.lit(None).cast("bigint").alias("order_total"),
        F.lit(None).cast("bigint").alias("paid_total"), F.lit(0).alias("section_position"), "item_position",
        F.lit("APP").alias("order_section_code"), F.lit("0").alias("order_section_no"),
        app_status(F.col("status")).alias("section_status"),
        F.concat("order_id", F.lit("-"), position).alias("order_item_code"), position.alias("order_section_item_no"),
        F.col("i.productId").alias("product_id"), F.col("i.productName").alias("product_name"),
        F.col("i.quantity").alias("quantity_raw"), safe_bigint(F.col("i.quantity")).alias("quantity"),
        F.sha2("item_json", 256).alias("item_json_sha256"))


def extract_items(versions: DataFrame, start: date, end: date, app_orders: DataFrame | None = None) -> DataFrame:
    """Order items of the window from the web source, plus the app source when there is one."""
    web = web_items(versions, start, end)
    return web if app_orders is None else web.unionByName(app_items(app_orders, start, end))


CANONICAL_ORDER = ("ordered_on", "order_id", "section_position", "item_position")


def canonical_positions(items: DataFrame, order=CANONICAL_ORDER) -> DataFrame:
    """Items with their position in the export order, so that files written in parallel can be put together in it."""
    return with_positions(items, list(order))


def missing_identity(versions: DataFrame, start: date, end: date, top: int = 5) -> DataFrame:
    """Most frequent product metadata among items without a product number."""
    latest = latest_versions(versions).filter(local_date(F.col("wtime")).between(F.lit(start), F.lit(end)))
    items = (latest.select(F.explode(F.from_json("sections", SECTIONS)).alias("s"))
             .select(F.explode("s.sectionItems").alias("item_json")))
    return (items.filter(F.get_json_object("item_json", "$.productInfo.prodNo").isNull())
            .groupBy(F.get_json_object("item_json", "$.productInfo").alias("product_info"),
                     F.to_json(F.json_object_keys("item_json")).alias("item_keys"))
            .agg(F.count("*").alias("item_rows"))
            .orderBy(F.desc("item_rows"), "product_info", "item_keys").limit(top))


def test_accounts(members: DataFrame, test_name: str) -> DataFrame:
    """Customers whose latest member record carries exactly the test name."""
    latest = members.groupBy("member_code").agg(F.max(F.struct("updated_at", "name")).alias("last"))
    return latest.filter(F.trim("last.name") == test_name).select(F.col("member_code").cast("string").alias("customer_id"))


def with_cutoffs(items: DataFrame, identity: Column) -> DataFrame:
    """Rows with their customer's last day of an unidentified product (NULL when there is none)."""
    cutoffs = (items.groupBy("customer_id")
               .agg(F.max(F.when(F.col("product_id").isNull(), F.col("ordered_on"))).alias("cutoff"),
                    F.count("*").alias("customer_rows"))
               .filter("cutoff IS NOT NULL"))
    return attach_group_facts(items, cutoffs, ["customer_id"], "customer_rows", identity, how="left").drop("customer_rows")


def quarantine(items: DataFrame, identity: Column) -> DataFrame:
    """Every row with `quarantine_reason`; NULL marks a kept row.

    A customer's rows up to the last unidentified product day are set aside; later history starts afresh.
    """
    rows = with_cutoffs(items, identity)
    set_aside = F.col("ordered_on") <= F.col("cutoff")
    return rows.withColumn("quarantine_reason", F.when(set_aside, F.when(F.col("product_id").isNull(), "missing_product_id")
                                                       .otherwise("prefix_before_unknown_product"))).drop("cutoff")


def late_cutoffs(items: DataFrame, train_cutoff: date) -> DataFrame:
    """Customers whose quarantine would prune history after the training cutoff (must be empty)."""
    return (items.filter(F.col("product_id").isNull()).groupBy("customer_id")
            .agg(F.max("ordered_on").alias("cutoff")).filter(F.col("cutoff") > F.lit(train_cutoff)))


def as_utc(text: Column) -> Column:
    """Timestamp text without a zone is UTC; an explicit offset is honoured (session zone is UTC)."""
    return F.to_timestamp(F.regexp_replace(text, r" UTC$", "Z"))


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """Union of shards with equal schemas; overlap and duplicates are quality checks (operators/quality.py)."""
    same_schema(shards)
    return reduce(lambda a, b: a.unionByName(b), shards)


def merge_manifest(items: DataFrame) -> DataFrame:
    """One row describing a merged extract: rows become codes, codes become orders, and these are added up.

    No distinct count expands the rows: an order is one row of its own aggregate, a customer one of another. Rows are read
    twice, the second time for their customer alone.
    """
    per_code = items.groupBy("order_id", "order_item_code").agg(
        F.count("*").alias("n"), F.max("latest_timestamp_row_count").alias("ties"),
        F.min("ordered_on").alias("first_on"), F.max("ordered_on").alias("last_on"))
    per_order = per_code.groupBy("order_id").agg(
        F.sum("n").alias("n"), F.max("ties").alias("ties"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"),
        F.min("first_on").alias("first_on"), F.max("last_on").alias("last_on"))
    orders = per_order.agg(
        F.sum("n").alias("rows"), F.count("order_id").alias("orders"), F.count(F.when(F.col("ties") > 1, F.col("order_id"))).alias("tie_orders"),
        F.sum("repeated").alias("repeated_order_item_codes"), F.min("first_on").alias("date_min"), F.max("last_on").alias("date_max"))
    customers = items.select("customer_id").distinct().agg(F.count("customer_id").alias("customers"))
    return orders.join(F.broadcast(customers)).select(  # one row each
        "rows", "orders", "customers", "tie_orders", F.coalesce("repeated_order_item_codes", F.lit(0)).alias("repeated_order_item_codes"), "date_min", "date_max")


# --- structural profile -------------------------------------------------------------------------------------------

def structural_profile(items: DataFrame) -> DataFrame:
    """Counts, distinct counts, date range and value checks of raw rows as one row."""
    quantity = F.col("quantity")
    # rows are reduced before the distinct counts expand them
    reduced = items.groupBy("customer_id", "order_id", "product_id").agg(
        F.count("*").alias("n"), F.min("ordered_on").alias("first_on"), F.max("ordered_on").alias("last_on"),
        F.count(F.when(quantity == 0, 1)).alias("zero"), F.count(F.when(quantity < 0, 1)).alias("negative"),
        F.min(quantity).alias("low"), F.max(quantity).alias("high"), F.sum(quantity).alias("total"))
    return reduced.agg(
        F.sum("n").alias("row_count"), F.countDistinct("customer_id").alias("unique_customers"),
        F.countDistinct("order_id").alias("unique_orders"), F.countDistinct("product_id").alias("unique_products"),
        F.countDistinct("customer_id", "product_id").alias("unique_pairs"),
        F.min("first_on").alias("date_min"), F.max("last_on").alias("date_max"),
        (F.datediff(F.max("last_on"), F.min("first_on")) + 1).cast("bigint").alias("calendar_days"),
        F.sum("zero").alias("zero_rows"), F.sum("negative").alias("negative_rows"),
        F.min("low").alias("quantity_min"), F.max("high").alias("quantity_max"), F.sum("total").alias("quantity_sum"))


def missing_by_column(rows: DataFrame) -> DataFrame:
    """Blank or NULL values per column, one row per column (one scan, one aggregate, then unpivot)."""
    counts = rows.agg(*[F.count(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1)).alias(c)
                        for c in rows.columns])
    return counts.unpivot([], list(rows.columns), "column_name", "missing")


def invalid_values(rows: DataFrame, date_cols: list[str], number_cols: list[str]) -> DataFrame:
    """Non-blank text that is not a date, and text that is not a finite number, per column."""
    text = {c: F.trim(F.col(c)) for c in date_cols + number_cols}
    bad_date = {c: (text[c] != "") & text[c].try_cast("date").isNull() for c in date_cols}
    bad_number = {c: F.col(c).isNull() | text[c].try_cast("decimal(38,10)").isNull() for c in number_cols}
    counts = rows.agg(*[F.count(F.when(cond, 1)).alias(c) for c, cond in {**bad_date, **bad_number}.items()])
    return counts.unpivot([], date_cols + number_cols, "column_name", "invalid")


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("section_status").agg(F.count("*").alias("rows"))


def duplicate_accounting(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that repeat and their surplus rows, for exact rows and for a key.

    Rows are compared by all columns; both counts combine before the shuffle, so many copies of one row stay cheap.
    """
    def summary(columns, name):
        return (rows.groupBy(*columns).agg(F.count("*").alias("n"))
                .agg(F.count(F.when(F.col("n") > 1, 1)).alias("repeated_groups"),
                     F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))
                .select(F.lit(name).alias("scope"), "repeated_groups", "surplus_rows"))
    return summary(rows.columns, "exact_row").unionByName(summary(keys, "key"))


def order_conflicts(items: DataFrame, fields: list[str]) -> DataFrame:
    """Orders holding more than one value of a field, per field.

    min <> max detects a conflict without distinct sets, so one pass serves all fields.
    """
    def differs(c):
        values = F.col(c).cast("string")
        return ((F.min(values) != F.max(values)) | ((F.count(values) > 0) & (F.count(values) < F.count("*")))).alias(c)
    per_order = items.groupBy("order_id").agg(*[differs(c) for c in fields])
    counts = per_order.agg(*[F.count(F.when(F.col(c), 1)).alias(c) for c in fields])
    return counts.unpivot([], fields, "field", "conflicting_orders")


def order_histogram(items: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys (customers or pairs) have how many orders."""
    return (items.groupBy(*keys).agg(F.countDistinct("order_id").alias("orders"))
            .groupBy("orders").agg(F.count("*").alias("keys")))


def customer_activity(items: DataFrame) -> DataFrame:
    """Customers with three or more purchase days, and customer days with several orders."""
    days = items.groupBy("customer_id", "ordered_on").agg(F.countDistinct("order_id").alias("orders"))
    several = F.sum(F.when(F.col("orders") > 1, 1).otherwise(0))
    per_customer = days.groupBy("customer_id").agg(F.count("*").alias("days"), several.alias("busy_days"))
    return per_customer.agg(F.count(F.when(F.col("days") >= 3, 1)).alias("customers_with_three_days"),
                            F.coalesce(F.sum("busy_days"), F.lit(0)).alias("customer_days_with_several_orders"))


def repeated_keys(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.count("*").alias("source_record_count")).filter("source_record_count > 1")


def visit_gap_summary(items: DataFrame) -> DataFrame:
    """Count, smallest and largest positive gap between a customer's purchase days."""
    days = items.select("customer_id", "ordered_on").distinct()
    w = Window.partitionBy("customer_id").orderBy("ordered_on")
    gaps = days.select(F.datediff("ordered_on", F.lag("ordered_on").over(w)).alias("gap")).filter("gap IS NOT NULL")
    return gaps.agg(F.count("*").alias("gap_count"), F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"))


def customer_item_history(records: DataFrame, orders: DataFrame) -> DataFrame:
    """Records with their order's customer and day. An order row is unique; AQE splits a hot order's records."""
    return records.join(orders.select("order_id", "customer_id", "ordered_on"), "order_id")
