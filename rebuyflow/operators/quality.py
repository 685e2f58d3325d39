"""Data-quality checks. Each returns the violating rows or keys; `enforce` turns any violation into an error."""
from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebuyflow.functions.calendar import local_date
from rebuyflow.functions.scalars import packed_id, unpacked_id


def enforce(checks: dict[str, DataFrame]) -> None:
    """Raise when any check has a violation. Only existence is asked for, not the rows."""
    failed = [name for name, violations in checks.items() if not violations.isEmpty()]
    if failed:
        raise ValueError(f"Failed checks: {', '.join(failed)}")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """Number of violations per check."""
    counts = [violations.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"))
              for name, violations in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def bad_quantity(items: DataFrame) -> DataFrame:
    """Quantity missing, not positive, or different from its raw text."""
    raw = F.col("quantity_raw").try_cast("decimal(38,10)")
    return items.filter(F.col("quantity").isNull() | (F.col("quantity") <= 0) | raw.isNull() | (raw != F.col("quantity")))


def missing_values(items: DataFrame, required: list[str]) -> DataFrame:
    """Rows lacking a required value."""
    return items.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in required]))


def conflicting(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys whose rows disagree in any of the fields (smallest and largest combination differ)."""
    values = F.struct(*fields)
    return (rows.groupBy(*keys).agg(F.min(values).alias("low"), F.max(values).alias("high"))
            .filter(~F.col("low").eqNullSafe(F.col("high"))).select(*keys))


def overlapping_orders(shards: list[DataFrame]) -> DataFrame:
    """Orders present in more than one shard."""
    tagged = [s.select("order_id", F.lit(i).alias("shard")) for i, s in enumerate(shards)]
    return conflicting(reduce(lambda a, b: a.unionByName(b), tagged), ["order_id"], ["shard"])


def fingerprint(rows: DataFrame) -> DataFrame:
    """Order-free content fingerprint of a table: row count and sum of row digests.

    Each row's digest is the first 60 bits of md5 over its columns; a sum needs no global sort.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(rows.columns)])
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.sum(number).cast("string").alias("content"))


def duplicate_shards(shards: list[DataFrame]) -> DataFrame:
    """Shards with the same content."""
    prints = [fingerprint(s).withColumn("shard", F.lit(i)) for i, s in enumerate(shards)]
    return repeated(reduce(lambda a, b: a.unionByName(b), prints), ["rows", "content"])


def annotation_errors(policy_rows: DataFrame) -> DataFrame:
    """Policy rows whose eligible quantity, barrier or readiness contradicts their decision."""
    decision = F.col("purchase_decision")
    included = F.when(decision == "include_completed", F.col("quantity"))
    return policy_rows.filter(~F.col("eligible_quantity").eqNullSafe(included)
                              | ~F.col("sequence_barrier").eqNullSafe(decision.startswith("hold_"))
                              | ~F.col("training_ready").eqNullSafe(F.lit(False)))


def exclusion_errors(policy_rows: DataFrame, product_exclusions: DataFrame | None,
                     customer_exclusions: DataFrame | None) -> DataFrame:
    """Rows whose decision differs from the exclusion lists, or is an exclusion the lists do not give."""
    rows, reasons = policy_rows, []
    for exclusions, key in ((customer_exclusions, "customer_id"), (product_exclusions, "product_id")):
        if exclusions is not None:
            rows = rows.join(exclusions.select(F.col("id").alias(key), F.col("reason").alias(f"{key}_reason")), key, "left")
            reasons.append(F.col(f"{key}_reason"))
    expected = F.coalesce(*reasons, F.lit(None).cast("string"))
    decision = F.col("purchase_decision")
    return rows.filter((expected.isNotNull() & (decision != expected))
                       | (expected.isNull() & decision.startswith("exclude_") & (decision != "exclude_cancelled")))


def time_errors(items: DataFrame) -> DataFrame:
    """Rows whose local day differs from their order time, or extracted before they were ordered."""
    return items.filter((local_date(F.col("ordered_at")) != F.col("ordered_on")) | (F.col("extracted_at") < F.col("ordered_at")))


def reconcile(links: DataFrame, events: DataFrame) -> DataFrame:
    """Linked rows and contributions next to each event; `ok` is false where they do not add up or a side is missing.

    Both sides meet by their packed identifiers, which are most of what is sent.
    """
    linked = links.groupBy(packed_id(F.col("event_id")).alias("_id")).agg(
        F.count("*").alias("link_rows"), F.sum("event_quantity_contribution").alias("contributed"))
    made = events.select(packed_id(F.col("event_id")).alias("_id"), "source_rows", "quantity")
    return (made.join(linked, "_id", "full_outer")
            .withColumn("event_id", unpacked_id(F.col("_id")))
            .withColumn("ok", F.col("link_rows").eqNullSafe(F.col("source_rows"))
                        & F.col("contributed").eqNullSafe(F.coalesce("quantity", F.lit(0))))
            .select("event_id", "source_rows", "quantity", "link_rows", "contributed", "ok"))


def reconciliation_errors(links: DataFrame, events: DataFrame) -> DataFrame:
    """Events that do not reconcile with their source rows."""
    return reconcile(links, events).filter("NOT ok")


def check_labels(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Labels next to their events; `ok` is false where they disagree.

    An observed target must be the next purchase of the same pair and episode with a positive gap; every completed
    day needs exactly one label.
    """
    origin = events.filter("event_state = 'completed'").select(
        F.col("event_id").alias("origin_event_id"), F.col("customer_id").alias("o_customer"), F.col("product_id").alias("o_product"),
        F.col("ordered_on").alias("o_day"), F.col("episode_id").alias("o_episode"), F.col("episode_purchase_index").alias("o_index"))
    target = events.select(
        F.col("event_id").alias("target_event_id"), F.col("customer_id").alias("t_customer"), F.col("product_id").alias("t_product"),
        F.col("ordered_on").alias("t_day"), F.col("quantity").alias("t_quantity"), F.col("event_state").alias("t_state"),
        F.col("episode_id").alias("t_episode"), F.col("episode_purchase_index").alias("t_index"))
    joined = labels.join(origin, "origin_event_id", "full_outer").join(target, "target_event_id", "left")
    observed_ok = ((F.col("t_state") == "completed") & (F.col("t_customer") == F.col("customer_id"))
                   & (F.col("t_product") == F.col("product_id")) & (F.col("t_day") == F.col("target_on"))
                   & (F.col("t_quantity") == F.col("target_quantity")) & (F.col("t_episode") == F.col("o_episode"))
                   & (F.col("t_index") == F.col("o_index") + 1)
                   & (F.datediff("target_on", "origin_on") == F.col("target_gap_days")) & (F.col("target_gap_days") > 0))
    same_origin = ((F.col("o_customer") == F.col("customer_id")) & (F.col("o_product") == F.col("product_id"))
                   & (F.col("o_day") == F.col("origin_on")))
    valid = (F.when(F.col("label_state") == "observed", observed_ok)
             .otherwise(F.col("label_state").isin("blocked_by_hold", "right_censored")))
    return joined.withColumn("ok", F.coalesce(valid & same_origin, F.lit(False)))


def label_errors(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Labels that disagree with their events."""
    return check_labels(labels, events).filter("NOT ok")


def split_errors(origins: DataFrame, lower: date, upper: date, split: str) -> DataFrame:
    """Evaluation rows outside their split, with a wrong gap, or with inconsistent history counts."""
    day = F.col("origin_on")
    valid = ((day >= F.lit(lower)) & (day < F.col("target_on")) & (F.col("target_on") <= F.lit(upper))
             & (F.col("outer_split") == split) & (F.col("label_state") == "observed")
             & (F.col("target_gap_days") == F.datediff("target_on", "origin_on")) & (F.col("target_quantity") > 0)
             & (F.col("qty_last") > 0) & (F.col("gap_count") == F.col("episode_purchase_count") - 1)
             & (F.col("prediction_asof") == F.date_add(day, 1).cast("timestamp_ntz")))
    return origins.filter(~F.coalesce(valid, F.lit(False)))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present in both tables (training and validation must be disjoint)."""
    return a.select(key).join(b.select(key), key, "left_semi")


def leaks(train: DataFrame, valid: DataFrame) -> DataFrame:
    """One row when a training target reaches the first validation origin."""
    none = F.lit(None).cast("date")
    both = train.select("target_on", none.alias("origin_on")).unionByName(valid.select(none.alias("target_on"), "origin_on"))
    return (both.agg(F.max("target_on").alias("last_target"), F.min("origin_on").alias("first_origin"))
            .filter("last_target >= first_origin"))


def population_differences(a: DataFrame, b: DataFrame, key: str, truth: list[str]) -> DataFrame:
    """Keys missing on one side or with different truth columns."""
    left = a.select(F.col(key), F.struct(*truth).alias("truth_a"))
    right = b.select(F.col(key), F.struct(*truth).alias("truth_b"))
    return left.join(right, key, "full_outer").filter(~F.col("truth_a").eqNullSafe(F.col("truth_b")))


def reappeared(rows: DataFrame, exclusions: DataFrame, column: str) -> DataFrame:
    """Downstream rows of an excluded id."""
    return rows.join(exclusions.filter(F.col("reason").startswith("exclude_")).select(F.col("id").alias(column)), column, "left_semi")


def out_of_order(condition: Column, rows: DataFrame) -> DataFrame:
    """Rows violating an arbitrary condition (NULL counts as a violation)."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))
