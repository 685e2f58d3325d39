"""Queries of past-only features and of the calendar split."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from rebuyflow.catalog.common import Catalog, rounded
from rebuyflow.catalog.events import DAY_LABELS_SQL
from rebuyflow.config import SplitConfig
from rebuyflow.functions.scalars import count_if, exact_bucket, history_bucket, recency_weight
from rebuyflow.operators import events, features, quality
from rebuyflow.plans.stages import stage
from rebuyflow.sources import driver_tables as tables

catalog = Catalog()

# The events table spans January 2024; the split is scaled to it.
SPLIT = SplitConfig(date(2024, 1, 1), date(2024, 1, 15), date(2024, 1, 19), date(2024, 1, 24), date(2024, 1, 30))
HORIZON, LAST_DAY = 7, date(2024, 1, 30)

HISTORY_SQL = DAY_LABELS_SQL + """,
done AS (SELECT *, CAST(ordered_on - LAG(ordered_on) OVER e AS INT) AS gap, LAG(quantity) OVER e AS prev_quantity
         FROM seq WHERE event_state = 'completed' WINDOW e AS (PARTITION BY customer_id, product_id, last_hold ORDER BY ordered_on)),
hist AS (
  SELECT event_id AS origin_event_id, customer_id, product_id, ordered_on AS origin_on, snapshot_observed_at,
         CAST(isodow(ordered_on) - 1 AS INT) AS origin_weekday, CAST(month(ordered_on) AS INT) AS origin_month,
         COUNT(*) OVER f AS episode_purchase_count, CAST(ordered_on - MIN(ordered_on) OVER f AS INT) AS episode_age_days,
         quantity AS qty_last, AVG(quantity) OVER f AS qty_mean, AVG(quantity) OVER l3 AS qty_mean_last3,
         MEDIAN(quantity) OVER l3 AS qty_median_last3, STDDEV_POP(quantity) OVER l3 AS qty_std_last3,
         CAST(SUM(quantity) OVER (PARTITION BY customer_id, product_id, last_hold ORDER BY ordered_on RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS qty_sum_7d,
         CAST(SUM(quantity) OVER (PARTITION BY customer_id, product_id, last_hold ORDER BY ordered_on RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS qty_sum_28d,
         COUNT(gap) OVER f AS gap_count, gap AS gap_last_days, AVG(gap) OVER f AS gap_mean_days, MEDIAN(gap) OVER f AS gap_median_days,
         MEDIAN(gap) OVER l3 AS recent3_gap, list(gap) FILTER (gap IS NOT NULL) OVER l6 AS gaps6, list(gap) FILTER (gap IS NOT NULL) OVER l5 AS gaps5
  FROM done WINDOW f AS (PARTITION BY customer_id, product_id, last_hold ORDER BY ordered_on ROWS UNBOUNDED PRECEDING),
                   l3 AS (PARTITION BY customer_id, product_id, last_hold ORDER BY ordered_on ROWS 2 PRECEDING),
                   l5 AS (PARTITION BY customer_id, product_id, last_hold ORDER BY ordered_on ROWS 4 PRECEDING),
                   l6 AS (PARTITION BY customer_id, product_id, last_hold ORDER BY ordered_on ROWS 5 PRECEDING)),
running AS (
  SELECT event_id AS origin_event_id,
         COUNT(DISTINCT ordered_on) OVER c AS customer_purchase_days, COUNT(DISTINCT product_id) OVER c AS customer_product_count,
         COUNT(*) OVER p AS product_purchase_events, COUNT(DISTINCT customer_id) OVER p AS product_customer_count,
         AVG(quantity) OVER p AS product_mean_quantity
  FROM done WINDOW c AS (PARTITION BY customer_id ORDER BY ordered_on RANGE UNBOUNDED PRECEDING),
                   p AS (PARTITION BY product_id ORDER BY ordered_on RANGE UNBOUNDED PRECEDING)),
origins AS (
  SELECT hist.*, running.* EXCLUDE (origin_event_id), label_state, target_event_id, target_on, target_quantity, target_gap_days, blocking_on, outer_split, fit_role, role_cutoff,
         CASE WHEN outer_split = 'out_of_window' THEN 'out_of_window' WHEN label_state = 'observed' AND target_on > role_cutoff THEN 'crosses_role_boundary' ELSE label_state END AS split_outcome,
         COALESCE(outer_split = 'train' AND label_state = 'observed' AND target_on <= DATE '2024-01-19', FALSE) AS train_pool
  FROM hist JOIN running USING (origin_event_id) JOIN (
    SELECT origin_event_id, label_state, target_event_id, target_on, target_quantity, target_gap_days, blocking_on,
           CASE WHEN origin_on > DATE '2024-01-30' THEN 'out_of_window' WHEN origin_on <= DATE '2024-01-19' THEN 'train' WHEN origin_on <= DATE '2024-01-24' THEN 'validation' ELSE 'test' END AS outer_split,
           CASE WHEN origin_on <= DATE '2024-01-15' THEN 'train_core' WHEN origin_on <= DATE '2024-01-19' THEN 'early_stop' WHEN origin_on <= DATE '2024-01-24' THEN 'validation' WHEN origin_on <= DATE '2024-01-30' THEN 'final_test' END AS fit_role,
           CASE WHEN origin_on <= DATE '2024-01-15' THEN DATE '2024-01-15' WHEN origin_on <= DATE '2024-01-19' THEN DATE '2024-01-19' WHEN origin_on <= DATE '2024-01-24' THEN DATE '2024-01-24' WHEN origin_on <= DATE '2024-01-30' THEN DATE '2024-01-30' END AS role_cutoff
    FROM labels) USING (origin_event_id))"""


def seq(spark, sf):
    return events.sequence(tables.daily_events(spark, sf))


def hist(spark, sf):
    """Pair histories for a query that reads them once."""
    return features.history(seq(spark, sf))


def stored_hist(spark, sf):
    """Pair histories stored once for a query that reads them several times."""
    return stage(hist(spark, sf), "history")


def origins(spark, sf):
    return features.build_origins(stored_hist(spark, sf), SPLIT)


def _sql(columns, source):
    """Select list with doubles rounded."""
    return f"WITH {HISTORY_SQL} SELECT {', '.join(columns)} FROM {source}"


def _round(*names):
    return [f"round({n}, 6) AS {n}" for n in names]


@catalog.query("pair_history", _sql(["origin_event_id", "origin_weekday", "origin_month", "episode_purchase_count", "episode_age_days", "qty_last",
                                     *_round("qty_mean", "qty_mean_last3", "qty_median_last3", "qty_std_last3")], "hist"))
def pair_history(spark, sf):
    """Purchase count, age and quantity statistics within the episode."""
    return rounded(features.pair_features(hist(spark, sf)).select(
        "origin_event_id", "origin_weekday", "origin_month", "episode_purchase_count", "episode_age_days", "qty_last", "qty_mean",
        "qty_mean_last3", "qty_median_last3", "qty_std_last3"))


@catalog.query("rolling_quantity", _sql(["origin_event_id", "qty_sum_7d", "qty_sum_28d"], "hist"))
def rolling_quantity(spark, sf):
    """Quantities of the last 7 and 28 days."""
    return features.pair_features(hist(spark, sf)).select("origin_event_id", "qty_sum_7d", "qty_sum_28d")


@catalog.query("gap_features", _sql(["origin_event_id", "gap_count", "gap_last_days", *_round("gap_mean_days", "gap_median_days")], "hist"))
def gap_features(spark, sf):
    """Count, last, mean and median of past gaps."""
    return rounded(features.pair_features(hist(spark, sf)).select("origin_event_id", "gap_count", "gap_last_days", "gap_mean_days", "gap_median_days"))


@catalog.query("running_distincts", f"""
WITH {HISTORY_SQL} SELECT DISTINCT customer_id, ordered_on AS origin_on, customer_purchase_days, customer_product_count
FROM running JOIN done ON origin_event_id = event_id""")
def running_distincts(spark, sf):
    """Distinct purchase days and products per customer up to each purchase day."""
    return features.customer_days(seq(spark, sf)).select("customer_id", "origin_on", "customer_purchase_days", "customer_product_count")


@catalog.query("product_running", f"""
WITH {HISTORY_SQL} SELECT DISTINCT product_id, ordered_on AS origin_on, product_purchase_events, product_customer_count, round(product_mean_quantity, 6) AS product_mean_quantity
FROM running JOIN done ON origin_event_id = event_id""")
def product_running(spark, sf):
    """Events, customers and mean quantity per product up to each day."""
    return rounded(features.product_days(seq(spark, sf)))


@catalog.query("origin_features", _sql([
    "origin_event_id", "product_id", "origin_weekday", "origin_month", "episode_purchase_count", "episode_age_days", "qty_last",
    "qty_sum_7d", "qty_sum_28d", "gap_count", "gap_last_days", "customer_purchase_days", "customer_product_count", "product_purchase_events",
    "product_customer_count", *_round("qty_mean", "qty_mean_last3", "qty_median_last3", "qty_std_last3", "gap_mean_days", "gap_median_days",
                                      "product_mean_quantity")], "origins"))
def origin_features(spark, sf):
    """All 21 features of every origin."""
    return rounded(features.origin_table(stored_hist(spark, sf)).select("origin_event_id", *features.BASE_FEATURES))


@catalog.query("calendar_split", _sql(["origin_event_id", "outer_split", "fit_role", "role_cutoff", "split_outcome", "train_pool"], "origins"))
def calendar_split(spark, sf):
    """Split, role, purged outcome and training-pool flag."""
    labels = events.next_purchase_labels(tables.daily_events(spark, sf))
    return features.with_split(labels, SPLIT).select("origin_event_id", "outer_split", "fit_role", "role_cutoff", "split_outcome", "train_pool")


@catalog.query("availability", f"""
WITH {HISTORY_SQL}, k AS (SELECT ordered_on AS origin_on, MAX(MAX(snapshot_observed_at)) OVER (ORDER BY ordered_on) AS known FROM seq GROUP BY 1),
t AS (SELECT event_id AS target_event_id, snapshot_observed_at AS seen FROM seq)
SELECT origin_event_id, known <= origin_on + INTERVAL 15 HOURS AS feature_timestamp_available,
       COALESCE(split_outcome = 'observed' AND known <= origin_on + INTERVAL 15 HOURS
                AND GREATEST(snapshot_observed_at, seen) < role_cutoff + INTERVAL 15 HOURS, FALSE) AS timestamp_availability_pass
FROM origins JOIN k USING (origin_on) LEFT JOIN t USING (target_event_id)""")
def availability(spark, sf):
    """Whether features and label were known in time (local midnight is 15:00 UTC of the same day)."""
    return origins(spark, sf).select("origin_event_id", "feature_timestamp_available", "timestamp_availability_pass")


@catalog.query("split_crosstab", f"""
WITH {HISTORY_SQL} SELECT outer_split, fit_role, split_outcome, COUNT(*) AS origins, COUNT(*) FILTER (split_outcome = 'observed') AS eligible,
COUNT(*) FILTER (train_pool) AS train_pool_rows FROM origins GROUP BY 1, 2, 3""")
def split_crosstab(spark, sf):
    """Origins by role and outcome."""
    labels = events.next_purchase_labels(tables.daily_events(spark, sf))
    return features.split_crosstab(features.with_split(labels, SPLIT))


@catalog.query("split_integrity", f"""
WITH {HISTORY_SQL} SELECT 'train_pool' AS part, COUNT(*) FILTER (train_pool) AS rows, CAST(0 AS BIGINT) AS errors FROM origins
UNION ALL SELECT 'validation', COUNT(*) FILTER (fit_role = 'validation' AND split_outcome = 'observed'), CAST(0 AS BIGINT) FROM origins
UNION ALL SELECT 'overlap', CAST(0 AS BIGINT), CAST(0 AS BIGINT)
UNION ALL SELECT 'leak', CAST(0 AS BIGINT), CAST(0 AS BIGINT)""")
def split_integrity(spark, sf):
    """Training pool and validation respect the calendar, are disjoint and do not leak."""
    rows = stage(origins(spark, sf), "origins")
    train, valid = rows.filter("train_pool"), rows.filter("fit_role = 'validation' AND role_eligible")
    checks = [("train_pool", train, quality.split_errors(train, SPLIT.start, SPLIT.train_end, "train")),
              ("validation", valid, quality.split_errors(valid, date(2024, 1, 20), SPLIT.validation_end, "validation"))]
    out = None
    for name, part, errors in checks:
        both = part.select(F.lit(1).alias("row"), F.lit(0).alias("error")).unionByName(errors.select(F.lit(0).alias("row"), F.lit(1).alias("error")))
        counts = both.agg(F.lit(name).alias("part"), F.sum("row").alias("rows"), F.sum("error").alias("errors"))
        out = counts if out is None else out.unionByName(counts)
    for name, errors in (("overlap", quality.overlap(train, valid, "origin_event_id")), ("leak", quality.leaks(train, valid))):
        out = out.unionByName(errors.agg(F.lit(name).alias("part"), F.lit(0).cast("bigint").alias("rows"), F.count("*").alias("errors")))
    return out


@catalog.query("horizon_outcomes", f"""
WITH {HISTORY_SQL} SELECT origin_event_id, CASE WHEN origin_on + 7 > DATE '2024-01-30' THEN 'not_mature'
 WHEN label_state = 'observed' AND target_on <= origin_on + 7 THEN 'observed'
 WHEN label_state = 'blocked_by_hold' AND blocking_on <= origin_on + 7 THEN 'unknown_due_to_hold' ELSE 'no_repurchase_within_horizon' END AS outcome
FROM origins""")
def horizon_outcomes(spark, sf):
    """Outcome within seven days of every origin."""
    labels = events.next_purchase_labels(tables.daily_events(spark, sf))
    return labels.select("origin_event_id", features.horizon_outcome(LAST_DAY, HORIZON).alias("outcome"))


@catalog.query("training_window", f"""
WITH {HISTORY_SQL} SELECT origin_event_id, origin_on, target_gap_days FROM origins
WHERE origin_on BETWEEN DATE '2024-01-06' AND DATE '2024-01-12' AND label_state = 'observed' AND target_gap_days BETWEEN 1 AND 7
AND NOT (origin_on BETWEEN DATE '2024-01-09' AND DATE '2024-01-10' OR target_on BETWEEN DATE '2024-01-09' AND DATE '2024-01-10')""")
def training_window(spark, sf):
    """Mature training rows outside an exceptional period."""
    labels = events.next_purchase_labels(tables.daily_events(spark, sf))
    rows = features.training_window(labels, date(2024, 1, 19), 14, HORIZON)
    return (features.without_exceptional_period(rows, date(2024, 1, 9), date(2024, 1, 10))
            .select("origin_event_id", "origin_on", "target_gap_days"))


@catalog.query("recency_weights", f"""
WITH {HISTORY_SQL} SELECT origin_event_id, round(pow(2, -(DATE '2024-01-19' - target_on) / 10.0), 6) AS weight FROM origins WHERE train_pool""")
def recency_weights(spark, sf):
    """Training weights halving every ten days."""
    labels = features.with_split(events.next_purchase_labels(tables.daily_events(spark, sf)), SPLIT).filter("train_pool")
    age = F.datediff(F.lit(SPLIT.train_end), "target_on")
    return labels.select("origin_event_id", F.round(recency_weight(age, 10.0), 6).alias("weight"))


@catalog.query("history_buckets", f"""
WITH {HISTORY_SQL} SELECT CASE WHEN episode_purchase_count <= 2 THEN CAST(episode_purchase_count AS VARCHAR) WHEN episode_purchase_count <= 5 THEN '3-5' ELSE '6+' END AS history_group,
CASE WHEN episode_purchase_count < 6 THEN CAST(episode_purchase_count AS VARCHAR) ELSE '6+' END AS purchase_bucket, COUNT(*) AS origins,
COUNT(*) FILTER (episode_purchase_count >= 4) AS with_four_purchases FROM hist GROUP BY 1, 2""")
def history_buckets(spark, sf):
    """Origins by purchase-count bucket."""
    rows = seq(spark, sf).filter("event_state = 'completed'")
    n = F.col("episode_purchase_index")
    return (rows.groupBy(history_bucket(n).alias("history_group"), exact_bucket(n).alias("purchase_bucket"))
            .agg(F.count("*").alias("origins"), count_if(n >= 4).alias("with_four_purchases")))


@catalog.query("product_targets", f"""
WITH {HISTORY_SQL}, k AS (SELECT product_id, target_on, target_gap_days AS g, target_quantity AS q FROM origins WHERE label_state = 'observed'),
d AS (SELECT DISTINCT product_id, origin_on FROM origins),
o AS (SELECT d.product_id, d.origin_on, COUNT(k.g) AS n, COALESCE(SUM(k.g), 0) AS g, COALESCE(SUM(k.q), 0) AS q FROM d LEFT JOIN k ON k.product_id = d.product_id AND k.target_on < d.origin_on GROUP BY 1, 2),
a AS (SELECT origin_on, SUM(k.g) / COUNT(k.g) AS g, SUM(k.q) / COUNT(k.q) AS q FROM (SELECT DISTINCT origin_on FROM d) LEFT JOIN k ON k.target_on < origin_on GROUP BY 1)
SELECT product_id, origin_on, n AS product_target_count, round((o.g + 10 * a.g) / (n + 10), 6) AS product_target_gap, round((o.q + 10 * a.q) / (n + 10), 6) AS product_target_quantity
FROM o JOIN a USING (origin_on)""")
def product_targets(spark, sf):
    """Mean outcome of a product's earlier purchases, as known on each day."""
    return rounded(features.product_targets(stage(origins(spark, sf), "origins")))
