"""Queries of purchase rhythm and routing."""
from __future__ import annotations

from pyspark.sql import functions as F

from rebuyflow.catalog.common import Catalog, rounded
from rebuyflow.catalog.features import HISTORY_SQL, hist, stored_hist
from rebuyflow.config import CadenceConfig, RouterConfig
from rebuyflow.operators import cadence, features

catalog = Catalog()


def class_sql(g: str) -> str:
    """Cadence class of a list of gaps in DuckDB terms."""
    n, med = f"len({g})", f"list_aggregate({g}, 'median')"
    steps = f"list_transform(range(1, {n}), lambda i: {g}[i + 1] - {g}[i])"
    low = f"list_min({g})"
    k = f"(list_position({g}, {low}) - 1)"
    rel = f"(({g}[-1] - {g}[1]) / {med})"
    return f"""CASE WHEN {n} IS NULL OR {n} < 4 THEN 'insufficient'
      WHEN {n} >= 5 AND {k} > 1 AND {k} < {n} - 2 AND ({g}[1] - {low}) / {med} >= 0.3 AND ({g}[-1] - {low}) / {med} >= 0.3
       AND len(list_filter(range(1, {n}), lambda i: (i <= {k} AND {g}[i + 1] > {g}[i]) OR (i > {k} AND {g}[i + 1] < {g}[i]))) = 0 THEN 'rebound'
      WHEN {rel} <= -0.3 AND len(list_filter({steps}, lambda d: d < 0)) / ({n} - 1) >= 0.75 THEN 'speeding_up'
      WHEN {rel} >= 0.3 AND len(list_filter({steps}, lambda d: d > 0)) / ({n} - 1) >= 0.75 THEN 'slowing_down'
      WHEN (sqrt(len({g}) * list_sum(list_transform({g}, lambda x: x * x)) - pow(list_sum({g}), 2)) / list_sum({g})) <= 0.25 THEN 'stable' ELSE 'irregular' END"""


VISITS_SQL = HISTORY_SQL + """,
cd AS (SELECT customer_id, ordered_on, bool_or(event_state = 'held') AS held, bool_or(event_state = 'completed') AS bought FROM seq GROUP BY 1, 2),
cv AS (SELECT *, MAX(CASE WHEN held THEN ordered_on END) OVER (PARTITION BY customer_id ORDER BY ordered_on) AS cleared FROM cd),
cg AS (SELECT *, CAST(ordered_on - LAG(ordered_on) OVER (PARTITION BY customer_id, cleared ORDER BY ordered_on) AS INT) AS visit_gap FROM cv WHERE bought),
visits AS (SELECT customer_id, ordered_on AS origin_on, visit_gap, ROW_NUMBER() OVER (PARTITION BY customer_id, cleared ORDER BY ordered_on) AS visit_index,
             list(visit_gap) FILTER (visit_gap IS NOT NULL) OVER (PARTITION BY customer_id, cleared ORDER BY ordered_on ROWS 5 PRECEDING) AS c6,
             list(visit_gap) FILTER (visit_gap IS NOT NULL) OVER (PARTITION BY customer_id, cleared ORDER BY ordered_on ROWS 4 PRECEDING) AS c5 FROM cg)"""

CLASSED_SQL = VISITS_SQL + f""",
classed AS (SELECT origin_event_id, customer_id, product_id, origin_on, gaps6, {class_sql('gaps6')} AS pair_group FROM hist),
cust_classed AS (SELECT customer_id, origin_on, c6, {class_sql('c6')} AS customer_group FROM visits)"""

SPEED_SQL = HISTORY_SQL + """,
iv AS (SELECT product_id, ordered_on, customer_id, gap, gap / prev_quantity AS per_unit,
              ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY ordered_on, event_id) AS rn FROM done WHERE gap IS NOT NULL),
pd AS (SELECT d.product_id, d.ordered_on, (SELECT COUNT(*) FROM iv WHERE iv.product_id = d.product_id AND iv.ordered_on <= d.ordered_on) AS c
       FROM (SELECT DISTINCT product_id, ordered_on FROM done) d),
sp AS (SELECT pd.product_id, pd.ordered_on AS origin_on, CAST(COUNT(gap) AS INT) AS item_gap_count, CAST(COUNT(DISTINCT customer_id) AS INT) AS item_interval_customers,
              CASE WHEN COUNT(gap) >= 20 AND COUNT(DISTINCT customer_id) >= 5 THEN 1 ELSE 0 END AS ok, MEDIAN(gap) AS med, QUANTILE_CONT(gap, 0.25) AS q25,
              STDDEV_POP(gap) / AVG(gap) AS cv, MEDIAN(per_unit) AS pu
       FROM pd LEFT JOIN iv ON iv.product_id = pd.product_id AND rn BETWEEN c - 99 AND c GROUP BY 1, 2),
speed AS (SELECT product_id, origin_on, item_gap_count, item_interval_customers, ok AS item_speed_available,
              CASE WHEN ok = 1 THEN med END AS item_gap_median, CASE WHEN ok = 1 THEN q25 END AS item_gap_q25, CASE WHEN ok = 1 THEN cv END AS item_gap_cv,
              CASE WHEN ok = 1 THEN pu END AS item_days_per_previous_unit, CASE WHEN ok = 1 AND med <= 7 THEN 1 ELSE 0 END AS item_fast,
              CASE WHEN ok = 1 AND med > 7 AND med <= 30 THEN 1 ELSE 0 END AS item_medium, CASE WHEN ok = 1 AND med > 30 THEN 1 ELSE 0 END AS item_slow FROM sp)"""


@catalog.query("item_speed", f"""
WITH {SPEED_SQL} SELECT product_id, origin_on, item_gap_count, item_interval_customers, item_speed_available, round(item_gap_median, 6) AS item_gap_median,
round(item_gap_q25, 6) AS item_gap_q25, round(item_gap_cv, 6) AS item_gap_cv, round(item_days_per_previous_unit, 6) AS item_days_per_previous_unit, item_fast, item_medium, item_slow FROM speed""")
def item_speed(spark, sf):
    """Product repurchase speed over its last 100 intervals at each day's end."""
    return rounded(cadence.item_speed(stored_hist(spark, sf)))


@catalog.query("cadence_profile", f"""
WITH {CLASSED_SQL} SELECT origin_event_id, pair_group, CAST(COALESCE(len(gaps6), 0) AS INT) AS pair_count, gaps6[-1] AS pair_gap_lag1, gaps6[-2] AS pair_gap_lag2, gaps6[-6] AS pair_gap_lag6,
round(list_aggregate(gaps6, 'median'), 6) AS pair_median, round((sqrt(len(gaps6) * list_sum(list_transform(gaps6, lambda x: x * x)) - pow(list_sum(gaps6), 2)) / list_sum(gaps6)), 6) AS pair_cv,
round((gaps6[-1] - gaps6[1]) / list_aggregate(gaps6, 'median'), 6) AS pair_relative_change,
round(CASE WHEN len(gaps6) > 1 THEN len(list_filter(range(1, len(gaps6)), lambda i: gaps6[i + 1] < gaps6[i])) / (len(gaps6) - 1) ELSE 0 END, 6) AS pair_down_fraction,
cust_classed.customer_group, CAST(COALESCE(len(c6), 0) AS INT) AS customer_count
FROM classed JOIN cust_classed USING (customer_id, origin_on)""")
def cadence_profile(spark, sf):
    """Recent-gap class and profile of pair and customer at every origin."""
    rows = cadence.enriched_origins(stored_hist(spark, sf))
    return rounded(rows.select("origin_event_id", "pair_group", "pair_count", "pair_gap_lag1", "pair_gap_lag2", "pair_gap_lag6", "pair_median",
                               "pair_cv", "pair_relative_change", "pair_down_fraction", "customer_group", "customer_count"))


@catalog.query("segment_flags", f"""
WITH {CLASSED_SQL} SELECT pair_group, cust_classed.customer_group, COUNT(*) AS origins FROM classed JOIN cust_classed USING (customer_id, origin_on) GROUP BY 1, 2""")
def segment_flags(spark, sf):
    """One-hot class columns re-aggregated: their sums are the class counts."""
    rows = cadence.enriched_origins(stored_hist(spark, sf))
    return (rows.filter(sum(F.col(f"pair_is_{g}") for g in cadence.GROUPS) == 1)
            .groupBy("pair_group", "customer_group").agg(F.count("*").alias("origins")))


@catalog.query("visit_sequence", f"WITH {VISITS_SQL} SELECT customer_id, origin_on, visit_index, visit_gap FROM visits")
def visit_sequence(spark, sf):
    """Customer visit days with holds clearing the history."""
    return features.customer_days(hist(spark, sf)).select("customer_id", "origin_on", F.col("visit_index").cast("bigint").alias("visit_index"), "visit_gap")


@catalog.query("recent3_gap", f"WITH {HISTORY_SQL} SELECT origin_event_id, round(recent3_gap, 6) AS recent3_gap FROM hist")
def recent3_gap(spark, sf):
    """Median of the last three gaps."""
    return rounded(features.pair_features(hist(spark, sf)).select("origin_event_id", "recent3_gap"))


@catalog.query("regularity", f"""
WITH {HISTORY_SQL} SELECT origin_event_id, CAST(COALESCE(len(gaps5), 0) AS INT) AS recent_gap_count, round((sqrt(len(gaps5) * list_sum(list_transform(gaps5, lambda x: x * x)) - pow(list_sum(gaps5), 2)) / list_sum(gaps5)), 6) AS gap_cv,
CASE WHEN COALESCE(len(gaps5), 0) < 3 THEN 'insufficient' WHEN (sqrt(len(gaps5) * list_sum(list_transform(gaps5, lambda x: x * x)) - pow(list_sum(gaps5), 2)) / list_sum(gaps5)) <= 0.5 THEN 'regular' ELSE 'variable' END AS status,
round(list_aggregate(gaps5, 'median'), 6) AS median_recent_gap FROM hist""")
def regularity(spark, sf):
    """Regular or variable pair history."""
    return rounded(cadence.regularity(hist(spark, sf)))


@catalog.query("customer_cadence", f"""
WITH {VISITS_SQL} SELECT customer_id, origin_on, CASE WHEN COALESCE(len(c5), 0) < 3 THEN 'insufficient_history'
WHEN (sqrt(len(c5) * list_sum(list_transform(c5, lambda x: x * x)) - pow(list_sum(c5), 2)) / list_sum(c5)) > 0.75 THEN 'irregular' WHEN list_aggregate(c5, 'median') <= 14 THEN 'within_14d'
WHEN list_aggregate(c5, 'median') <= 30 THEN 'within_30d' WHEN list_aggregate(c5, 'median') <= 60 THEN 'within_60d' ELSE 'over_60d' END AS cadence_class FROM visits""")
def customer_cadence(spark, sf):
    """Visit rhythm class of each customer day."""
    return cadence.customer_cadence(hist(spark, sf))


@catalog.query("two_type_regularity", f"""
WITH {HISTORY_SQL} SELECT origin_event_id, CASE WHEN COALESCE(len(gaps6), 0) < 4 THEN 'insufficient'
WHEN len(list_filter(gaps6, lambda g: abs(g - list_aggregate(gaps6, 'median')) <= 7)) / len(gaps6) >= 0.75 THEN 'regular' ELSE 'irregular' END AS regularity FROM hist""")
def two_type_regularity(spark, sf):
    """Regular when three quarters of the recent gaps are near their median."""
    return cadence.two_type_regularity(hist(spark, sf))


# Hysteresis as a literal day-by-day recursion.
ROUTES_SQL = "RECURSIVE " + CLASSED_SQL + """,
ordered AS (SELECT customer_id, product_id, origin_on, origin_event_id, pair_group AS raw, ROW_NUMBER() OVER w AS i,
            list(pair_group) OVER (PARTITION BY customer_id, product_id ORDER BY origin_on ROWS 2 PRECEDING) AS last3
            FROM classed WINDOW w AS (PARTITION BY customer_id, product_id ORDER BY origin_on)),
walk AS (
  SELECT customer_id, product_id, origin_on, origin_event_id, raw, i, last3, raw AS current, FALSE AS changed FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.customer_id, o.product_id, o.origin_on, o.origin_event_id, o.raw, o.i, o.last3,
         CASE WHEN o.raw = 'insufficient' OR w.current = 'insufficient' OR len(list_filter(o.last3, lambda g: g = o.raw)) >= 2 THEN o.raw ELSE w.current END,
         CASE WHEN o.raw = 'insufficient' OR w.current = 'insufficient' OR len(list_filter(o.last3, lambda g: g = o.raw)) >= 2 THEN o.raw ELSE w.current END <> w.current
  FROM walk w JOIN ordered o ON o.customer_id = w.customer_id AND o.product_id = w.product_id AND o.i = w.i + 1)"""


@catalog.query("stable_routes", f"""
WITH {ROUTES_SQL} SELECT origin_event_id, raw AS raw_group, current AS customer_group,
round(len(list_filter(last3, lambda g: g = current)) / len(last3), 3) AS route_confidence, changed AS route_changed FROM walk""")
def stable_routes(spark, sf):
    """Cadence class with hysteresis for every origin."""
    rows = cadence.with_routes(cadence.pair_profile(features.pair_features(hist(spark, sf))), RouterConfig())
    return rows.select("origin_event_id", "raw_group", F.col("route_group").alias("customer_group"), "route_confidence", "route_changed")


CUSTOMER_ROUTES_SQL = "RECURSIVE " + CLASSED_SQL + """,
ordered AS (SELECT customer_id, origin_on, customer_group AS raw, ROW_NUMBER() OVER w AS i, list(customer_group) OVER (PARTITION BY customer_id ORDER BY origin_on ROWS 2 PRECEDING) AS last3
            FROM cust_classed WINDOW w AS (PARTITION BY customer_id ORDER BY origin_on)),
walk AS (SELECT customer_id, origin_on, raw, i, last3, raw AS current, FALSE AS changed FROM ordered WHERE i = 1
  UNION ALL SELECT o.customer_id, o.origin_on, o.raw, o.i, o.last3,
         CASE WHEN o.raw = 'insufficient' OR w.current = 'insufficient' OR len(list_filter(o.last3, lambda g: g = o.raw)) >= 2 THEN o.raw ELSE w.current END,
         CASE WHEN o.raw = 'insufficient' OR w.current = 'insufficient' OR len(list_filter(o.last3, lambda g: g = o.raw)) >= 2 THEN o.raw ELSE w.current END <> w.current
  FROM walk w JOIN ordered o ON o.customer_id = w.customer_id AND o.i = w.i + 1)"""


@catalog.query("customer_routes", f"""
WITH {CUSTOMER_ROUTES_SQL} SELECT origin_event_id, raw AS raw_group, current AS route_group, changed AS route_changed FROM classed JOIN walk USING (customer_id, origin_on)""")
def customer_routes(spark, sf):
    """Hysteresis per customer instead of per pair."""
    rows = cadence.enriched_origins(stored_hist(spark, sf)).select("origin_event_id", "customer_id", "origin_on", "customer_group")
    return cadence.with_routes(rows, RouterConfig(route_unit="customer")).select("origin_event_id", "raw_group", "route_group", "route_changed")


@catalog.query("route_conflicts", f"""
WITH {CLASSED_SQL} SELECT COUNT(*) AS units, CAST(0 AS BIGINT) AS conflicts FROM (SELECT DISTINCT customer_id, origin_on FROM cust_classed)""")
def route_conflicts(spark, sf):
    """Customer days with one class each; conflicts are counted."""
    rows = cadence.enriched_origins(stored_hist(spark, sf)).select("customer_id", "origin_on", "customer_group")
    conflicts = cadence.conflicting_days(rows, RouterConfig(route_unit="customer"))
    days = rows.select("customer_id", "origin_on").distinct()
    both = days.select(F.lit(1).alias("u"), F.lit(0).alias("c")).unionByName(conflicts.select(F.lit(0).alias("u"), F.lit(1).alias("c")))
    return both.agg(F.sum("u").cast("bigint").alias("units"), F.sum("c").cast("bigint").alias("conflicts"))


@catalog.query("group_eligibility", f"""
WITH {CLASSED_SQL} SELECT pair_group AS customer_group, COUNT(*) AS rows, COUNT(DISTINCT customer_id) AS customers,
COUNT(*) >= 200 AND COUNT(DISTINCT customer_id) >= 30 AND pair_group <> 'insufficient' AS eligible FROM classed GROUP BY 1""")
def group_eligibility(spark, sf):
    """Classes with enough rows and customers for a specialist."""
    rows = cadence.pair_profile(features.pair_features(hist(spark, sf)), CadenceConfig())
    return cadence.group_eligibility(rows.select("customer_id", F.col("pair_group").alias("g")), "g", 200, 30)
