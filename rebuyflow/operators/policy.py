"""Which order items count as purchases: include, exclude, or hold (a barrier in the pair's sequence)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.functions.scalars import count_if
from rebuyflow.plans.skew import FEW_FACTS, attach_group_facts, balanced

# Section status vocabulary by decision.
STATUS_DECISIONS = {
    "exclude_cancelled": ("CANCEL_COMPLETE",),
    "candidate_completed": ("PURCHASE_CONFIRMATION", "SHIPPING_COMPLETE"),
    "review_in_progress": ("PRODUCT_PREPARATION", "SHIPPING_READY", "SHIPPING"),
    "review_return_exchange": ("RETURN_COMPLETE", "EXCHANGE_PRODUCT_PREPARATION", "EXCHANGE_PURCHASE_CONFIRMATION"),
}

# Reasons an exclusion list of each version may give.
ALLOWED_REASONS = {
    "product-exclusions-v1": ("exclude_prepaid_credit",),
    "product-exclusions-v2": ("exclude_prepaid_credit", "exclude_sample", "exclude_gift"),
    "product-exclusions-v3": ("exclude_prepaid_credit", "exclude_sample", "exclude_gift", "exclude_test_product",
                              "hold_non_catalog_payment"),
}
CUSTOMER_REASON = "exclude_internal_test"


def status_decision(status: Column) -> Column:
    """Decision of a single row from its current status; anything unlisted is unknown."""
    chain = F
    for decision, statuses in STATUS_DECISIONS.items():
        chain = chain.when(status.isin(*statuses), decision)
    return chain.otherwise("review_unknown_status")


def annotate_status(items: DataFrame, identity: Column) -> DataFrame:
    """All rows with their status decision and whether their item code repeats within the order."""
    keys = ["order_id", "order_item_code"]
    counts = items.groupBy(*keys).agg(F.count("*").alias("item_rows"))
    return (attach_group_facts(items, counts, keys, "item_rows", identity)
            .withColumn("status_decision", status_decision(F.col("section_status")))
            .withColumn("repeated_item_code", F.col("item_rows") > 1).drop("item_rows"))


def _group_facts(over: Callable[[Column], Column] = lambda total: total) -> dict[str, Column]:
    """Customer and decision of a group of linked rows, worst finding first; `over` makes windows of the totals.

    Identity conflict (a missing product beside a known one is one), unknown status, return or exchange, in progress, all cancelled, partly cancelled, completed.
    """
    row = status_decision(F.col("section_status"))
    cancelled = F.col("section_status") == "CANCEL_COMPLETE"
    low, high, known, every = (over(x) for x in (F.min("product_id"), F.max("product_id"), F.count("product_id"), F.count("*")))
    decision = (F.when((low != high) | ((known > 0) & (known < every)), "review_product_identity")
                .when(over(F.max(row == "review_unknown_status")), "review_unknown_status")
                .when(over(F.max(row == "review_return_exchange")), "review_return_exchange_linked")
                .when(over(F.max(row == "review_in_progress")), "review_in_progress_linked")
                .when(over(F.min(cancelled)), "excluded_cancelled_group")
                .when(over(F.max(cancelled)), "review_partial_cancel_linked").otherwise("completed_group_candidate"))
    return {"group_customer": over(F.min("customer_id")), "group_decision": decision}


def classify_groups(items: DataFrame, keys: list[str]) -> DataFrame:
    """One decision per group of linked rows. All flags combine before the shuffle, so group size does not matter."""
    return items.groupBy(*keys).agg(F.count("*").alias("group_rows"), F.sum("quantity").alias("group_quantity"),
                                    *[fact.alias(name) for name, fact in _group_facts().items()])


def policy_version(product_list_version: str | None = None, customers: bool = False) -> str:
    """Policy version implied by the exclusion lists supplied."""
    if product_list_version is not None and product_list_version not in ALLOWED_REASONS:
        raise ValueError("Unknown product exclusion list")
    if product_list_version == "product-exclusions-v3":
        return "purchase-policy-v5"
    if product_list_version == "product-exclusions-v2":
        return "purchase-policy-v4"
    if customers:
        return "purchase-policy-v3"
    return "purchase-policy-v2" if product_list_version else "purchase-policy-v1"


def disallowed_exclusions(exclusions: DataFrame, list_version: str) -> DataFrame:
    """Entries without an id or with a reason the list version does not allow (must be empty)."""
    allowed = (CUSTOMER_REASON,) if list_version == "test-account-exclusions-v1" else ALLOWED_REASONS[list_version]
    return exclusions.filter(F.col("id").isNull() | (F.col("id") == "") | F.col("reason").isNull() | ~F.col("reason").isin(*allowed))


def _purchase_decision(groups: DataFrame, product_exclusions: DataFrame | None, customer_exclusions: DataFrame | None) -> DataFrame:
    """Classified groups, or rows with what their group is, with `purchase_decision`: excluded customer, excluded product, then the status class."""
    by_customer = by_product = F.lit(None).cast("string")
    if customer_exclusions is not None:
        lookup = customer_exclusions.select(F.col("id").alias("group_customer"), F.col("reason").alias("customer_reason"))
        groups, by_customer = groups.join(lookup, "group_customer", "left"), F.col("customer_reason")
    if product_exclusions is not None:
        lookup = product_exclusions.select(F.col("id").alias("product_id"), F.col("reason").alias("product_reason"))
        groups, by_product = groups.join(lookup, "product_id", "left"), F.col("product_reason")
    status = F.col("group_decision")
    by_status = (F.when(status == "completed_group_candidate", "include_completed")
                 .when(status == "excluded_cancelled_group", "exclude_cancelled")
                 .otherwise(F.regexp_replace(status, "^review_", "hold_")))
    return groups.withColumn("purchase_decision", F.coalesce(by_customer, by_product, by_status))


def group_decisions(items: DataFrame, product_exclusions: DataFrame | None = None,
                    customer_exclusions: DataFrame | None = None) -> DataFrame:
    """Policy decision per (order, product): excluded customer, excluded product, then the status class.

    Exclusion lists meet the grouped rows, not the raw ones; Spark broadcasts them when their size allows.
    """
    groups = _purchase_decision(classify_groups(items, ["order_id", "product_id"]), product_exclusions, customer_exclusions)
    return groups.select("order_id", "product_id", "group_rows", "group_quantity", "purchase_decision")


def _few(exclusions: DataFrame | None) -> DataFrame | None:
    """An exclusion list every task can hold, marked for broadcast; a longer one as it is."""
    return F.broadcast(exclusions) if exclusions is not None and exclusions.limit(FEW_FACTS + 1).count() <= FEW_FACTS else exclusions


def apply_policy(items: DataFrame, identity: Column, product_exclusions: DataFrame | None = None,
                 customer_exclusions: DataFrame | None = None, version: str = "purchase-policy-v1", orders: DataFrame | None = None) -> DataFrame:
    """All rows with their group's decision, eligible quantity and barrier flag.

    Rows are decided beside the others of their order and product, in one shuffle or, where they already lie by order, none.
    Where an order holds a large share of the rows (counted over the `order_id` of `orders`, if counting the items is dear)
    groups combine first and their decision is given back to dealt rows.
    """
    if balanced(items if orders is None else orders, ["order_id"]):
        group = Window.partitionBy("order_id", "product_id")
        facts = items.select("*", *[fact.alias(name) for name, fact in _group_facts(lambda total: total.over(group)).items()])
        rows = _purchase_decision(facts, _few(product_exclusions), _few(customer_exclusions)).select(*items.columns, "purchase_decision")
    else:
        groups = group_decisions(items, product_exclusions, customer_exclusions).drop("group_quantity")
        rows = attach_group_facts(items, groups, ["order_id", "product_id"], "group_rows", identity).drop("group_rows")
    decision = F.col("purchase_decision")
    return (rows.withColumn("policy_version", F.lit(version))
            .withColumn("eligible_quantity", F.when(decision == "include_completed", F.col("quantity")))
            .withColumn("sequence_barrier", decision.startswith("hold_"))
            .withColumn("training_ready", F.lit(False)))


def policy_report(groups: DataFrame) -> DataFrame:
    """Groups, rows and raw quantity by decision, straight from the grouped table."""
    return groups.groupBy("purchase_decision").agg(
        F.count("*").alias("groups"), F.sum("group_rows").alias("rows"), F.sum("group_quantity").alias("raw_quantity"))


def item_lifecycle(items: DataFrame) -> DataFrame:
    """Per order item code: decision, quantity by current status as JSON, and the status pattern of repeated codes.

    Rows are first counted per status, so the collected list has one entry per distinct status. The pattern writes each
    status with its number of rows (`STATUS:n`), which loses nothing and stays short for any number of rows.
    """
    keys = ["order_id", "order_item_code"]
    per_status = items.groupBy(*keys, "section_status").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n"))
    entries = per_status.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("section_status", "quantity", "n"))).alias("entries"),
        F.sum("n").alias("source_rows"))
    spelled = F.transform("entries", lambda e: F.concat(e.section_status, F.lit(":"), e.n.cast("string")))
    quantities = F.to_json(F.map_from_entries(F.transform("entries", lambda e: F.struct(e.section_status, e.quantity))))
    decided = classify_groups(items, keys).select(*keys, F.col("group_decision").alias("linked_group_decision"))
    return entries.join(decided, keys).select(
        *keys, "source_rows", quantities.alias("quantity_by_current_status"), "linked_group_decision",
        F.when(F.col("source_rows") > 1, F.array_join(spelled, " | ")).alias("status_pattern"))


def lifecycle_report(lifecycle: DataFrame) -> DataFrame:
    """Item groups per decision and, among repeated codes, per status pattern."""
    return lifecycle.groupBy("linked_group_decision", "status_pattern").agg(
        F.count("*").alias("item_groups"), count_if(F.col("source_rows") > 1).alias("repeated_groups"))


def unmatched(exclusions: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """Exclusion ids that occur nowhere in the data."""
    return exclusions.select("id").join(items.select(F.col(column).alias("id")), "id", "left_anti")
