"""Queries of daily events, episodes, labels and lineage."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuyflow.catalog.common import DAYS_SQL, Catalog
from rebuyflow.catalog.policy import GROUPS_SQL, customer_exclusions, policy_rows, product_exclusions
from rebuyflow.functions.scalars import count_if, packed_id, unpacked_id
from rebuyflow.operators import events, quality
from rebuyflow.plans.stages import stage
from rebuyflow.sources import driver_tables as tables

catalog = Catalog()

EVENTS_SQL = GROUPS_SQL + """,
ev AS (
  SELECT sha256('["' || customer_id || '", "' || product_id || '", "' || CAST(ordered_on AS VARCHAR) || '"]') AS event_id, customer_id, product_id, ordered_on,
         event_state, CASE WHEN event_state = 'completed' THEN q END AS quantity, source_rows, order_count, seen
  FROM (SELECT customer_id, product_id, ordered_on, COUNT(*) AS source_rows, COUNT(DISTINCT order_id) AS order_count, MAX(extracted_at) AS seen,
               CAST(SUM(quantity) FILTER (purchase_decision NOT LIKE 'exclude%') AS BIGINT) AS q,
               CASE WHEN bool_or(purchase_decision LIKE 'hold%') THEN 'held'
                    WHEN bool_or(purchase_decision NOT LIKE 'exclude%') THEN 'completed'
                    WHEN bool_or(purchase_decision <> 'exclude_cancelled') THEN 'excluded_only' ELSE 'cancelled_only' END AS event_state
        FROM policy GROUP BY 1, 2, 3)),
links AS (
  SELECT p.*, ev.event_id, ev.event_state,
         CASE WHEN purchase_decision LIKE 'exclude%' THEN purchase_decision WHEN event_state = 'completed' THEN 'include_completed'
              WHEN purchase_decision = 'include_completed' THEN 'hold_same_day' ELSE purchase_decision END AS row_disposition
  FROM policy p JOIN ev USING (customer_id, product_id, ordered_on))"""

# Sequences of a table `src` of events; a correlated definition of episodes (last hold before the day).
SEQUENCE_SQL = """
act AS (SELECT *, MAX(CASE WHEN event_state = 'held' THEN ordered_on END) OVER (PARTITION BY customer_id, product_id ORDER BY ordered_on) AS last_hold
        FROM {src} WHERE event_state IN ('completed','held')),
seq AS (SELECT *, CASE WHEN event_state = 'completed' THEN arg_min(event_id, ordered_on) FILTER (event_state = 'completed')
                    OVER (PARTITION BY customer_id, product_id, last_hold) END AS episode_id,
               CASE WHEN event_state = 'completed' THEN COUNT(*) FILTER (event_state = 'completed')
                    OVER (PARTITION BY customer_id, product_id, last_hold ORDER BY ordered_on) END AS episode_purchase_index,
               LEAD(event_state) OVER p AS next_state, LEAD(ordered_on) OVER p AS next_on, LEAD(quantity) OVER p AS next_quantity,
               LEAD(event_id) OVER p AS next_id
        FROM act WINDOW p AS (PARTITION BY customer_id, product_id ORDER BY ordered_on)),
labels AS (SELECT event_id AS origin_event_id, customer_id, product_id, ordered_on AS origin_on, episode_id,
               CASE WHEN next_state IS NULL THEN 'right_censored' WHEN next_state = 'completed' THEN 'observed' ELSE 'blocked_by_hold' END AS label_state,
               CASE WHEN next_state = 'completed' THEN next_id END AS target_event_id,
               CASE WHEN next_state = 'completed' THEN next_on END AS target_on,
               CASE WHEN next_state = 'completed' THEN next_quantity END AS target_quantity,
               CASE WHEN next_state = 'completed' THEN CAST(next_on - ordered_on AS INT) END AS target_gap_days,
               CASE WHEN next_state = 'held' THEN next_id END AS blocking_event_id,
               CASE WHEN next_state = 'held' THEN next_on END AS blocking_on
        FROM seq WHERE event_state = 'completed')"""
DAY_LABELS_SQL = DAYS_SQL + "," + SEQUENCE_SQL.format(src="days")


def item_events(spark, sf):
    return events.day_states(policy_rows(spark, sf))


EVENT_COLUMNS = ["customer_id", "product_id", "ordered_on", "order_id", "order_section_item_no", "section_status", "quantity", "extracted_at",
                 "purchase_decision", "sequence_barrier"]


NUMBER = "order_section_item_no"


def stored_events(made, name="events"):
    """Daily events stored without their identifiers, which are made again from the row."""
    return stage(made.drop("event_id"), name).select(events.event_key().alias("event_id"), "*")


def stored_links(spark, sf, traced: bool = True, **marks):
    """Policy rows stored once, their daily events stored once, and the rows linked to them.

    A row's number is long, so it is packed on its way. Where no link is `traced` to its row, a 64-bit hash of what is stored stands for it: all it does
    there is to spread the rows of a large group. `marks` are columns made of the whole rows before they are stored.
    """
    kept = [c for c in EVENT_COLUMNS if traced or c not in (NUMBER, "section_status")]
    number = F.col(NUMBER)
    rows = policy_rows(spark, sf).select(*kept, *[mark.alias(name) for name, mark in marks.items()])
    rows = stage(rows.withColumn(NUMBER, packed_id(number)) if traced else rows, "policy")
    if not traced:
        rows = rows.withColumn(NUMBER, F.xxhash64("order_id", "quantity", "extracted_at"))
    made = stored_events(events.day_states(rows, stored=True))
    linked = events.row_disposition(rows, made, number, stored=True)
    return linked.withColumn(NUMBER, unpacked_id(number)) if traced else linked, made


def links(spark, sf):
    return stored_links(spark, sf)[0]


@catalog.query("daily_events", f"WITH {EVENTS_SQL} SELECT event_id, customer_id, product_id, ordered_on, event_state, quantity, source_rows, order_count FROM ev")
def daily_events(spark, sf):
    """One event per customer, product and day from policy rows."""
    return item_events(spark, sf).drop("snapshot_observed_at")


@catalog.query("row_disposition", f"""
WITH {EVENTS_SQL} SELECT order_id, order_section_item_no, event_id, row_disposition,
CASE WHEN row_disposition = 'include_completed' THEN quantity ELSE 0 END AS event_quantity_contribution FROM links""")
def row_disposition(spark, sf):
    """Source rows linked to their event."""
    return links(spark, sf).select("order_id", "order_section_item_no", "event_id", "row_disposition", "event_quantity_contribution")


@catalog.query("disposition_summary", f"""
WITH {EVENTS_SQL} SELECT row_disposition, COUNT(*) AS rows, CAST(SUM(quantity) AS BIGINT) AS raw_quantity FROM links GROUP BY 1""")
def disposition_summary(spark, sf):
    """Rows and raw quantity by disposition."""
    return stored_links(spark, sf, traced=False)[0].groupBy("row_disposition").agg(F.count("*").alias("rows"), F.sum("quantity").alias("raw_quantity"))


@catalog.query("episodes", f"""
WITH {EVENTS_SQL}, {SEQUENCE_SQL.format(src='ev')}
SELECT event_id, event_state, episode_id, episode_purchase_index FROM seq
UNION ALL SELECT event_id, event_state, NULL, NULL FROM ev WHERE event_state NOT IN ('completed','held')""")
def episodes(spark, sf):
    """Events with episode and purchase index; audit rows kept."""
    return events.with_episodes(item_events(spark, sf), digests=True).select("event_id", "event_state", "episode_id", "episode_purchase_index")


@catalog.query("next_purchase_labels", f"""
WITH {DAY_LABELS_SQL}
SELECT origin_event_id, customer_id, product_id, origin_on, episode_id, label_state, target_event_id, target_on, target_quantity, target_gap_days, blocking_event_id FROM labels""")
def next_purchase_labels(spark, sf):
    """Next purchase of every completed day: observed, blocked or censored."""
    return events.next_purchase_labels(tables.daily_events(spark, sf)).drop("blocking_on", "label_snapshot_observed_at")


@catalog.query("item_labels", f"""
WITH {EVENTS_SQL}, {SEQUENCE_SQL.format(src='ev')}
SELECT label_state, COUNT(*) AS labels, COUNT(DISTINCT (customer_id, product_id)) AS pairs, round(AVG(target_gap_days), 6) AS mean_gap FROM labels GROUP BY 1""")
def item_labels(spark, sf):
    """Label states over the order-item events."""
    return (events.next_purchase_labels(item_events(spark, sf), digests=True).groupBy("label_state")
            .agg(F.count("*").alias("labels"), F.countDistinct("customer_id", "product_id").alias("pairs"),
                 F.round(F.avg("target_gap_days"), 6).alias("mean_gap")))


@catalog.query("event_summary", f"""
WITH {EVENTS_SQL} SELECT event_state, COUNT(*) AS events, CAST(SUM(quantity) AS BIGINT) AS quantity, MIN(ordered_on) AS first_day, MAX(ordered_on) AS last_day FROM ev GROUP BY 1""")
def event_summary(spark, sf):
    """Events by state."""
    return events.event_summary(item_events(spark, sf))


@catalog.query("series_summary", f"""
WITH {EVENTS_SQL} SELECT COUNT(*) AS series, COUNT(*) FILTER (c = 1) AS single_event_series
FROM (SELECT COUNT(*) FILTER (event_state = 'completed') AS c FROM ev GROUP BY customer_id, product_id)""")
def series_summary(spark, sf):
    """Pair series and series with one completed event."""
    return events.series_summary(item_events(spark, sf))


@catalog.query("event_reconciliation", f"""
WITH {EVENTS_SQL}
SELECT COUNT(*) AS events, CAST(SUM(n) AS BIGINT) AS linked_rows, CAST(SUM(c) AS BIGINT) AS contributed, CAST(0 AS BIGINT) AS errors
FROM ev JOIN (SELECT event_id, COUNT(*) AS n, SUM(CASE WHEN row_disposition = 'include_completed' THEN quantity ELSE 0 END) AS c FROM links GROUP BY 1) USING (event_id)""")
def event_reconciliation(spark, sf):
    """Source rows and quantities add up to the events."""
    return quality.reconcile(*stored_links(spark, sf, traced=False)).agg(
        F.count("event_id").alias("events"), F.sum("link_rows").alias("linked_rows"), F.sum("contributed").alias("contributed"),
        count_if(~F.col("ok")).alias("errors"))


@catalog.query("label_integrity", f"""
WITH {DAY_LABELS_SQL} SELECT COUNT(*) AS labels, CAST(0 AS BIGINT) AS errors FROM labels""")
def label_integrity(spark, sf):
    """Labels agree with their events."""
    day_events = stage(tables.daily_events(spark, sf), "events")
    checked = quality.check_labels(events.next_purchase_labels(day_events), events.with_episodes(day_events))
    return checked.agg(F.count("origin_event_id").alias("labels"), count_if(~F.col("ok")).alias("errors"))


@catalog.query("excluded_reappearance", f"""
WITH {EVENTS_SQL} SELECT 'customer' AS list, COUNT(*) AS rows FROM ev WHERE event_state = 'completed' AND customer_id IN (SELECT id FROM xc)
UNION ALL SELECT 'product', COUNT(*) FROM ev WHERE event_state = 'completed' AND product_id IN (SELECT id FROM xp)""")
def excluded_reappearance(spark, sf):
    """Completed events of excluded customers or products (none expected)."""
    done = stage(item_events(spark, sf).filter("event_state = 'completed'"), "completed")
    customers = quality.reappeared(done, customer_exclusions(spark, sf), "customer_id")
    products = quality.reappeared(done, product_exclusions(spark, sf), "product_id")
    return (customers.agg(F.lit("customer").alias("list"), F.count("*").alias("rows"))
            .unionByName(products.agg(F.lit("product").alias("list"), F.count("*").alias("rows"))))


@catalog.query("lineage_trace", f"""
WITH {EVENTS_SQL}, {SEQUENCE_SQL.format(src='ev')}
SELECT origin_event_id, target_event_id, target_on, target_quantity, order_id, order_section_item_no, section_status, links.quantity AS event_quantity_contribution
FROM labels JOIN links ON target_event_id = links.event_id AND row_disposition = 'include_completed' WHERE label_state = 'observed'""")
def lineage_trace(spark, sf):
    """Observed labels traced to the source rows of their target."""
    linked, made = stored_links(spark, sf)
    return events.lineage(events.next_purchase_labels(made, digests=True), linked)
