"""Queries of baseline forecasts and their evaluation over two weekly folds of the events table."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from rebuyflow.catalog.common import Catalog, rounded
from rebuyflow.catalog.features import HISTORY_SQL, HORIZON, LAST_DAY, hist, seq
from rebuyflow.config import Fold
from rebuyflow.functions.calendar import weekly_cart
from rebuyflow.functions.scalars import history_bucket
from rebuyflow.operators import baseline, events, features, metrics, quality, reports
from rebuyflow.plans.stages import stage
from rebuyflow.sources import driver_tables as tables

catalog = Catalog()

FOLDS = (Fold("a", date(2024, 1, 13), date(2024, 1, 14), date(2024, 1, 18)), Fold("b", date(2024, 1, 18), date(2024, 1, 19), date(2024, 1, 23)))
WINDOW_DAYS = 14

SCORED_SQL = HISTORY_SQL + """,
folds AS (SELECT * FROM (VALUES ('a', DATE '2024-01-13', DATE '2024-01-14', DATE '2024-01-18'), ('b', DATE '2024-01-18', DATE '2024-01-19', DATE '2024-01-23')) t(fold, train_end, s, e)),
train AS (SELECT fold, product_id, target_gap_days FROM origins JOIN folds ON origin_on BETWEEN train_end - 13 AND train_end - 7
          WHERE label_state = 'observed' AND target_gap_days BETWEEN 1 AND 7),
pm AS (SELECT fold, product_id, MEDIAN(target_gap_days) AS gap_median, COUNT(*) AS interval_count FROM train GROUP BY 1, 2),
gm AS (SELECT fold, MEDIAN(target_gap_days) AS gap_median, COUNT(*) AS interval_count FROM train GROUP BY 1),
pred AS (
  SELECT o.*, f.fold, CAST(greatest(1, floor(CASE WHEN gap_count > 0 THEN gap_median_days ELSE COALESCE(pm.gap_median, gm.gap_median) END + 0.5)) AS BIGINT) AS base_gap,
         CASE WHEN gap_count > 0 THEN 'pair' WHEN pm.gap_median IS NOT NULL THEN 'product' ELSE 'global' END AS gap_source,
         CASE WHEN origin_on + 7 > DATE '2024-01-30' THEN 'not_mature' WHEN label_state = 'observed' AND target_on <= origin_on + 7 THEN 'observed'
              WHEN label_state = 'blocked_by_hold' AND blocking_on <= origin_on + 7 THEN 'unknown_due_to_hold' ELSE 'no_repurchase_within_horizon' END AS outcome,
         CASE WHEN episode_purchase_count <= 2 THEN CAST(episode_purchase_count AS VARCHAR) WHEN episode_purchase_count <= 5 THEN '3-5' ELSE '6+' END AS history_group
  FROM origins o JOIN folds f ON origin_on BETWEEN s AND e
  LEFT JOIN pm ON pm.fold = f.fold AND pm.product_id = o.product_id AND pm.interval_count >= 5 JOIN gm ON gm.fold = f.fold),
long AS (
  SELECT fold, origin_event_id, customer_id, product_id, origin_on, outcome, history_group, episode_purchase_count,
         CASE WHEN outcome = 'observed' THEN target_on END AS target_on, CASE WHEN outcome = 'observed' THEN target_gap_days END AS tg,
         CASE WHEN outcome = 'observed' THEN target_quantity END AS tq, g.rule || '_q' || q.rule AS candidate,
         CAST(CASE g.rule WHEN 'pair_median' THEN base_gap WHEN 'last_gap' THEN CASE WHEN gap_count > 0 THEN greatest(1, gap_last_days) ELSE base_gap END
              WHEN 'hybrid' THEN CASE WHEN gap_count >= 3 THEN greatest(1, floor(recent3_gap + 0.5)) ELSE base_gap END ELSE CASE WHEN recent3_gap IS NOT NULL THEN greatest(1, floor(recent3_gap + 0.5)) ELSE base_gap END END AS BIGINT) AS gap,
         CAST(CASE q.rule WHEN 'last' THEN greatest(1, qty_last) ELSE greatest(1, floor(qty_median_last3 + 0.5)) END AS BIGINT) AS qty
  FROM pred, (VALUES ('pair_median'), ('last_gap'), ('recent3_gap'), ('hybrid')) g(rule), (VALUES ('last'), ('median_last3')) q(rule)),
scored AS (SELECT *, gap - tg AS d, qty - tq AS q FROM long)"""


def forecasts(origins, rows=None):
    """Origins of both folds (with any extra columns of `rows`) and their baseline forecast."""
    model = baseline.fit_baseline(baseline.fold_training_rows(origins, FOLDS, WINDOW_DAYS, HORIZON))
    valid = features.assign_folds(origins if rows is None else rows, FOLDS)
    return baseline.predict_baseline(valid, model).withColumn("history_group", history_bucket(F.col("episode_purchase_count")))


def predictions(spark, sf):
    """Origins of both folds with the baseline forecast and the recent-three gap."""
    return forecasts(stage(features.pair_features(hist(spark, sf)), "origins"))


def grid(rows):
    """Candidate grid of forecasts with outcomes."""
    return baseline.scored(baseline.candidate_grid(rows), features.horizon_outcome(LAST_DAY, HORIZON))


def scored(spark, sf):
    """Candidate grid with outcomes, for one consumer."""
    return grid(predictions(spark, sf))


def stored_scored(spark, sf):
    """Candidate grid stored for metrics that aggregate it at several levels."""
    return stage(scored(spark, sf), "scored")


def baseline_scored(spark, sf):
    """Baseline forecast alone with outcomes, observed rows only."""
    return baseline.scored(predictions(spark, sf), features.horizon_outcome(LAST_DAY, HORIZON)).filter(metrics.OBSERVED)


def with_cart(rows):
    """Weekly cart time, purchase stage and period of scored rows."""
    stage = (F.when(F.col("episode_purchase_count") == 1, "first").when(F.col("episode_purchase_count") == 2, "second").otherwise("later"))
    return (rows.withColumn("cart_at", weekly_cart(F.col("origin_on"), F.col("predicted_gap_days"), 22, 3))
            .withColumn("purchase_stage", stage).withColumn("period", F.when(F.col("fold") >= "b", "confirm").otherwise("select")))


def release_sql(gap: str, limit: int = 3) -> str:
    """Weekly cart time in DuckDB: next Sunday night for weekly buyers, else the Sunday eight days before the predicted Monday."""
    sunday = "(origin_on + 1 + CAST((7 - isodow(origin_on + 1)) % 7 AS INT))"
    pred = f"(origin_on + CAST({gap} AS INT))"
    planned = f"(({pred} - CAST(isodow({pred}) - 1 AS INT) - 8) + INTERVAL 22 HOURS)"
    avail = "((origin_on + 1) + INTERVAL 0 HOURS)"
    night = f"({sunday} + INTERVAL 22 HOURS)"
    return f"""CASE WHEN {gap} <= {limit} THEN CASE WHEN isodow(origin_on + 1) = 1 THEN {avail} ELSE {night} END
      WHEN {avail} <= {planned} THEN {planned} WHEN isodow(origin_on + 1) = 1 THEN {avail}
      WHEN {night} < {pred} + INTERVAL 0 HOURS THEN {night} ELSE {avail} END"""


CART_SQL = SCORED_SQL + f""",
cart AS (SELECT *, CAST({release_sql('gap')} AS DATE) AS cart_on,
         CASE WHEN episode_purchase_count = 1 THEN 'first' WHEN episode_purchase_count = 2 THEN 'second' ELSE 'later' END AS purchase_stage,
         CASE WHEN fold >= 'b' THEN 'confirm' ELSE 'select' END AS period FROM scored),
dims AS (SELECT *, unnest(['overall', 'group', 'stage', 'fold', 'period']) AS dimension, unnest(['all', history_group, purchase_stage, fold, period]) AS value FROM cart)"""


def _macro_sql(source, keys, value, name):
    """Mean over customers of the customer mean."""
    k = ", ".join(keys)
    return f"(SELECT {k}, AVG(m) AS {name}, COUNT(*) AS customers FROM (SELECT {k}, customer_id, AVG({value}) AS m FROM {source} WHERE outcome = 'observed' GROUP BY {k}, customer_id) GROUP BY {k})"


@catalog.query("baseline_fit", f"""
WITH {SCORED_SQL} SELECT fold, product_id, round(gap_median, 6) AS gap_median, interval_count, FALSE AS is_global FROM pm
UNION ALL SELECT fold, NULL, round(gap_median, 6), interval_count, TRUE FROM gm""")
def baseline_fit(spark, sf):
    """Gap medians per product and overall for both folds."""
    labels = events.next_purchase_labels(tables.daily_events(spark, sf))
    return rounded(baseline.fit_baseline(baseline.fold_training_rows(labels, FOLDS, WINDOW_DAYS, HORIZON)))


@catalog.query("baseline_predict", f"WITH {SCORED_SQL} SELECT fold, origin_event_id, qty_last AS predicted_quantity, base_gap AS predicted_gap_days, gap_source, history_group FROM pred")
def baseline_predict(spark, sf):
    """Baseline forecast of every origin of the folds."""
    return predictions(spark, sf).select("fold", "origin_event_id", "predicted_quantity", "predicted_gap_days", "gap_source", "history_group")


@catalog.query("baseline_input_checks", f"WITH {SCORED_SQL} SELECT COUNT(*) AS violations FROM origins WHERE qty_last <= 0 OR (gap_count > 0) <> (gap_median_days IS NOT NULL)")
def baseline_input_checks(spark, sf):
    """Contradicting baseline inputs (none expected)."""
    return baseline.invalid_baseline_inputs(features.pair_features(hist(spark, sf))).agg(F.count("*").alias("violations"))


POINT_SQL = """COUNT(*) AS n, round(sqrt(AVG(pow({q} - tq, 2))), 6) AS quantity_rmse, round(AVG(abs({q} - tq)), 6) AS quantity_mae, round(SUM(abs({q} - tq)) / SUM(tq), 6) AS quantity_wape,
CAST(SUM(tq) AS DOUBLE) AS actual_quantity_sum, CAST(SUM({q}) AS DOUBLE) AS predicted_quantity_sum, round(AVG({q} - tq), 6) AS quantity_bias_mean,
round(AVG(({q} = tq)::INT), 6) AS quantity_exact_rate, round(AVG(({q} < tq)::INT), 6) AS quantity_under_rate, round(AVG(({q} > tq)::INT), 6) AS quantity_over_rate,
round(AVG(abs(gap - tg)), 6) AS date_mae_days, round(AVG(gap - tg), 6) AS date_bias_days, round(AVG((abs(gap - tg) <= 7)::INT), 6) AS date_within_tolerance_rate"""
BASE_SQL = SCORED_SQL + ", base AS (SELECT *, base_gap AS gap, qty_last AS qty, target_gap_days AS tg, target_quantity AS tq FROM pred WHERE outcome = 'observed')"


@catalog.query("point_metrics", f"WITH {BASE_SQL} SELECT history_group, {POINT_SQL.format(q='qty')} FROM base GROUP BY 1")
def point_metrics(spark, sf):
    """Point errors of the baseline by history bucket."""
    return rounded(metrics.point_metrics(baseline_scored(spark, sf), ["history_group"]))


@catalog.query("quantity_bands", f"""
WITH {BASE_SQL}, r AS (SELECT CASE WHEN tq <= 1 THEN '1' WHEN tq <= 2 THEN '2' WHEN tq <= 5 THEN '3-5' ELSE '6+' END AS band, {POINT_SQL.format(q='qty')} FROM base GROUP BY 1)
SELECT b AS band, COALESCE(n, 0) AS n, quantity_mae, date_mae_days FROM (SELECT unnest(['1', '2', '3-5', '6+', 'none']) AS b) LEFT JOIN r ON b = band""")
def quantity_bands(spark, sf):
    """Errors by band of the actual quantity; a band without rows stays with n = 0."""
    rows = baseline_scored(spark, sf).withColumn("band", metrics.quantity_band(F.col("target_quantity")))
    report = metrics.with_empty_groups(metrics.point_metrics(rows, ["band"]), "band", ["1", "2", "3-5", "6+", "none"])
    return rounded(report.select("band", "n", "quantity_mae", "date_mae_days"))


@catalog.query("timing_summary", f"""
WITH {SCORED_SQL} SELECT a.*, round(customer_macro_date_mae, 6) AS customer_macro_date_mae, customers FROM (
SELECT candidate, fold, COUNT(*) AS origins, COUNT(*) FILTER (outcome = 'observed') AS n, COUNT(*) FILTER (outcome = 'no_repurchase_within_horizon') AS no_repurchase_n,
COUNT(*) FILTER (outcome = 'unknown_due_to_hold') AS unknown_n, round(AVG(abs(d)), 6) AS date_mae, round(AVG((abs(d) <= 3)::INT), 6) AS date_within_3_rate,
round(AVG((abs(d) <= 7)::INT), 6) AS date_within_7_rate, round(AVG((d = 0)::INT), 6) AS date_exact_rate, round(AVG(d), 6) AS date_bias, round(QUANTILE_CONT(abs(d), 0.9), 6) AS date_p90_abs_error,
round(AVG(abs(q)), 6) AS quantity_mae, round(AVG((abs(q) <= 1)::INT), 6) AS quantity_within_1_rate, round(AVG((abs(q) <= 2)::INT), 6) AS quantity_within_2_rate, round(AVG((q = 0)::INT), 6) AS quantity_exact_rate,
round(AVG((q > 2)::INT), 6) AS quantity_over_by_more_than_2_rate, round(AVG((q < -2)::INT), 6) AS quantity_under_by_more_than_2_rate, COUNT(*) FILTER (tq <= 2) AS small_quantity_n,
round(AVG((q = 0)::INT) FILTER (tq <= 2), 6) AS small_quantity_exact_rate, round(AVG((q >= 2)::INT) FILTER (tq <= 2), 6) AS small_quantity_over_by_2_or_more_rate,
round(AVG((gap <= 7)::INT) FILTER (outcome = 'no_repurchase_within_horizon'), 6) AS no_repurchase_but_predicted_within_horizon_rate FROM scored GROUP BY 1, 2) a
JOIN {_macro_sql('scored', ['candidate', 'fold'], 'abs(d)', 'customer_macro_date_mae')} USING (candidate, fold)""")
def timing_summary(spark, sf):
    """Timing and quantity accuracy of every candidate and fold."""
    return rounded(metrics.timing_summary(stored_scored(spark, sf), ["candidate", "fold"], HORIZON))


@catalog.query("score_ext", f"""
WITH {SCORED_SQL} SELECT candidate, COUNT(*) AS n, round(AVG((abs(d) <= 14)::INT), 6) AS date_within_14_rate, CAST(QUANTILE_DISC(abs(d), 0.8) AS BIGINT) AS date_80pct_tolerance_days,
round(AVG((abs(d) <= 7 AND abs(q) <= 2)::INT), 6) AS joint_date_7_quantity_2_rate FROM scored WHERE outcome = 'observed' GROUP BY 1""")
def score_ext(spark, sf):
    """Wide tolerance, 80 % tolerance and joint accuracy."""
    return rounded(metrics.score_extension(scored(spark, sf), ["candidate"]))


@catalog.query("cart_policies", f"""
WITH {SCORED_SQL}, p AS (SELECT *, unnest(['none', 'lead7', 'lead10', 'relative25_cap7']) AS policy FROM scored),
c AS (SELECT *, CAST(greatest(1, gap - CASE policy WHEN 'none' THEN 0 WHEN 'lead7' THEN 7 WHEN 'lead10' THEN 10 ELSE least(7, greatest(1, ceil(gap * 0.25))) END) AS BIGINT) AS cg FROM p),
m AS (SELECT *, tg - cg AS m FROM c)
SELECT a.*, round(customer_macro_late_rate, 6) AS customer_macro_late_rate FROM (
SELECT candidate, policy, COUNT(m) AS observed_n, COUNT(*) FILTER (m > 0) AS early, COUNT(*) FILTER (m = 0) AS same_day, COUNT(*) FILTER (m < 0) AS late, COUNT(*) FILTER (m BETWEEN 1 AND 10) AS early_1_to_10,
COUNT(*) FILTER (m > 30) AS early_over_30, COUNT(*) FILTER (m >= 7) AS at_least_7_days, round(AVG((m < 0)::INT), 6) AS late_rate, round(MEDIAN(m), 6) AS median_margin_days,
round(AVG((cg = 1)::INT), 6) AS next_day_suggestion_rate_all, COUNT(*) FILTER (outcome = 'no_repurchase_within_horizon') AS nonreturn_n,
round(AVG((cg <= 90)::INT) FILTER (outcome = 'no_repurchase_within_horizon'), 6) AS nonreturn_suggestion_within_horizon_rate FROM m GROUP BY 1, 2) a
JOIN {_macro_sql('m', ['candidate', 'policy'], '(m < 0)::INT', 'customer_macro_late_rate')} USING (candidate, policy)""")
def cart_policies(spark, sf):
    """Cart margins under each lead policy."""
    return rounded(metrics.cart_policies(stored_scored(spark, sf), ["candidate"]))


WEEK_SQL = """COUNT(m) AS n, COUNT(*) FILTER (m > 0) AS early, COUNT(*) FILTER (m = 0) AS same_day, COUNT(*) FILTER (m < 0) AS late, COUNT(*) FILTER (m BETWEEN 1 AND 10) AS early_1_to_10,
COUNT(*) FILTER (m > 30) AS early_over_30, COUNT(*) FILTER (m >= 7) AS at_least_7_days, COUNT(*) FILTER (m IS NOT NULL AND isodow(cart_on) IN (7, 1)) AS sunday_or_monday,
COUNT(*) FILTER (m IS NOT NULL AND gap <= 3) AS weekly_buyer, round(MEDIAN(m), 6) AS median_margin_days, COUNT(*) FILTER (outcome = 'no_repurchase_within_horizon') AS nonreturn_n,
round(AVG((cart_on - origin_on <= 90)::INT) FILTER (outcome = 'no_repurchase_within_horizon'), 6) AS nonreturn_cart_within_horizon_rate,
round(COUNT(*) FILTER (m < 0) / nullif(COUNT(m), 0), 6) AS late_rate, round(COUNT(*) FILTER (m BETWEEN 1 AND 10) / nullif(COUNT(m), 0), 6) AS early_1_to_10_rate, round(COUNT(*) FILTER (m > 30) / nullif(COUNT(m), 0), 6) AS early_over_30_rate"""


@catalog.query("weekly_metrics", f"""
WITH {CART_SQL}, w AS (SELECT *, CAST(target_on - cart_on AS INT) AS m FROM cart)
SELECT a.*, round(customer_macro_late_rate, 6) AS customer_macro_late_rate FROM (SELECT candidate, {WEEK_SQL} FROM w GROUP BY 1) a
JOIN {_macro_sql('w', ['candidate'], '(m < 0)::INT', 'customer_macro_late_rate')} USING (candidate)""")
def weekly_metrics(spark, sf):
    """Margins of weekly Sunday-night carts."""
    return rounded(metrics.weekly_metrics(with_cart(stored_scored(spark, sf)), ["candidate"], 3))


MONITOR_SQL = """COUNT(*) FILTER (outcome <> 'unknown_due_to_hold') AS origins, COUNT(*) FILTER (outcome = 'observed' AND tg <= 5) AS repurchased,
COUNT(*) FILTER (outcome = 'observed' AND tg <= 5 AND abs(d) <= 7) AS hits"""


@catalog.query("monitor_metrics", f"""
WITH {SCORED_SQL} SELECT candidate, origins, repurchased, hits, round(hits / repurchased, 6) AS hit_rate, round(hits / origins, 6) AS hit_rate_all_origins, round(1 - repurchased / origins, 6) AS closed_without_purchase_rate
FROM (SELECT candidate, {MONITOR_SQL} FROM scored GROUP BY 1)""")
def monitor_metrics(spark, sf):
    """Hits within the monitoring window (five days here)."""
    return rounded(metrics.monitor_metrics(scored(spark, sf), ["candidate"], 5))


@catalog.query("lead_policies", f"""
WITH {SCORED_SQL}, l AS (SELECT *, unnest([0, 7, 10]) AS lead_days FROM scored WHERE outcome = 'observed'),
m AS (SELECT *, CAST(target_on - greatest(origin_on + CAST(gap AS INT) - lead_days, origin_on + 1) AS INT) AS m FROM l)
SELECT candidate, lead_days, COUNT(*) AS n, COUNT(*) FILTER (m > 0) AS before_repurchase, COUNT(*) FILTER (m = 0) AS same_day, COUNT(*) FILTER (m < 0) AS late,
COUNT(*) FILTER (m >= 7) AS at_least_7_days_before, COUNT(*) FILTER (m >= 10) AS at_least_10_days_before, COUNT(*) FILTER (m > 30) AS over_30_days_before,
COUNT(*) FILTER (gap - 1 < lead_days) AS clipped_to_feature_availability FROM m GROUP BY 1, 2""")
def lead_policies(spark, sf):
    """Fixed leads of 0, 7 and 10 days."""
    return metrics.lead_policies(scored(spark, sf), ["candidate"])


def _sections(spark, sf):
    rows = with_cart(stage(scored(spark, sf).filter(F.col("candidate").isin("pair_median_qlast", "recent3_gap_qlast")), "scored"))
    dims = {"group": F.col("history_group"), "stage": F.col("purchase_stage"), "fold": F.col("fold"), "period": F.col("period")}
    return reports.section_report(rows, dims, 3, 5)


SECTION_SQL = CART_SQL + f""",
w AS (SELECT *, CAST(target_on - cart_on AS INT) AS m FROM dims WHERE candidate IN ('pair_median_qlast', 'recent3_gap_qlast')),
wk AS (SELECT candidate, dimension, value, {WEEK_SQL} FROM w GROUP BY 1, 2, 3),
mo AS (SELECT candidate, dimension, value, {MONITOR_SQL} FROM w GROUP BY 1, 2, 3),
ma AS {_macro_sql('w', ['candidate', 'dimension', 'value'], '(m < 0)::INT', 'macro')},
sec AS (SELECT candidate, dimension, value, n, late, late_rate, early_1_to_10_rate, early_over_30_rate, round(macro, 6) AS customer_macro_late_rate, median_margin_days, origins, repurchased, hits,
        round(hits / nullif(repurchased, 0), 6) AS hit_rate FROM wk JOIN mo USING (candidate, dimension, value) LEFT JOIN ma USING (candidate, dimension, value))"""


@catalog.query("grouped_report", f"WITH {SECTION_SQL} SELECT * FROM sec")
def grouped_report(spark, sf):
    """Overall, history group, stage, fold and period sections of two candidates."""
    return rounded(_sections(spark, sf))


@catalog.query("acceptance", f"""
WITH {SECTION_SQL}, x AS (SELECT a.dimension, a.value, a.n AS nn, a.hit_rate AS h1, b.hit_rate AS h0, a.late_rate AS l1, b.late_rate AS l0, a.early_1_to_10_rate AS e1, b.early_1_to_10_rate AS e0,
 a.early_over_30_rate AS o1, b.early_over_30_rate AS o0 FROM sec a JOIN sec b USING (dimension, value) WHERE a.candidate = 'recent3_gap_qlast' AND b.candidate = 'pair_median_qlast')
SELECT bool_or(h1 >= h0) FILTER (dimension = 'overall') AS monitor_hit_rate_not_worse, bool_and(h1 >= h0) FILTER (dimension = 'period') AS monitor_hit_rate_not_worse_by_period,
 bool_and(h1 >= h0) FILTER (dimension = 'fold') AS monitor_hit_rate_not_worse_all_folds, bool_or(l1 <= l0) FILTER (dimension = 'overall') AS late_not_worse,
 bool_or(e1 > e0) FILTER (dimension = 'overall') AS early_1_to_10_improved, bool_or(o1 <= o0) FILTER (dimension = 'overall') AS early_over_30_not_increased,
 bool_and(l1 <= l0 OR nn = 0) FILTER (dimension = 'group') AS no_group_later,
 (COUNT(DISTINCT l1 <= l0) FILTER (dimension = 'fold')) = 1 AS same_direction_across_folds FROM x""")
def acceptance(spark, sf):
    """Is the recent-three rule not worse than the pair median?"""
    return reports.acceptance(_sections(spark, sf), "recent3_gap_qlast", "pair_median_qlast")


DAILY_SQL = BASE_SQL + """, cal AS (SELECT CAST(unnest(generate_series(DATE '2024-01-10', DATE '2024-01-26', INTERVAL 1 DAY)) AS DATE) AS origin_on),
dd AS (SELECT origin_on, COUNT(*) AS n, AVG(tq) AS actual_mean, AVG(qty) AS predicted_mean, AVG(abs(qty - tq)) AS quantity_mae, sqrt(AVG(pow(qty - tq, 2))) AS quantity_rmse, AVG(abs(gap - tg)) AS date_mae FROM base GROUP BY 1)"""


@catalog.query("daily_cohorts", f"""
WITH {DAILY_SQL} SELECT origin_on, COALESCE(n, 0) AS n, round(actual_mean, 6) AS actual_mean, round(predicted_mean, 6) AS predicted_mean, round(quantity_mae, 6) AS quantity_mae,
round(quantity_rmse, 6) AS quantity_rmse, round(date_mae, 6) AS date_mae FROM cal LEFT JOIN dd USING (origin_on)""")
def daily_cohorts(spark, sf):
    """Errors by origin day, empty days kept."""
    return rounded(metrics.daily_cohorts(baseline_scored(spark, sf), date(2024, 1, 10), date(2024, 1, 26)))


@catalog.query("cohort_reconciliation", f"""
WITH {BASE_SQL} SELECT COUNT(*) AS n, round(AVG(abs(qty - tq)), 6) AS quantity_mae, round(sqrt(AVG(pow(qty - tq, 2))), 6) AS quantity_rmse, round(AVG(abs(gap - tg)), 6) AS date_mae_days FROM base""")
def cohort_reconciliation(spark, sf):
    """Overall errors rebuilt from the daily cohorts."""
    return rounded(metrics.reaggregate_days(metrics.daily_cohorts(baseline_scored(spark, sf), date(2024, 1, 10), date(2024, 1, 26))))


@catalog.query("weekly_cohorts", f"""
WITH {SCORED_SQL} SELECT candidate, CAST(date_trunc('week', origin_on) AS DATE) AS week, {POINT_SQL.format(q='qty')} FROM scored WHERE outcome = 'observed' GROUP BY 1, 2""")
def weekly_cohorts(spark, sf):
    """Point errors by Monday of the origin week."""
    return rounded(metrics.weekly_cohorts(scored(spark, sf), ["candidate"]))


@catalog.query("candidate_ranking", f"""
WITH {SCORED_SQL}, s AS (SELECT candidate, AVG(abs(d)) AS date_mae, AVG((abs(q) <= 1)::INT) AS q1 FROM scored WHERE outcome = 'observed' GROUP BY 1),
m AS {_macro_sql('scored', ['candidate'], 'abs(d)', 'macro')}
SELECT CAST(ROW_NUMBER() OVER (ORDER BY round(macro, 9), round(date_mae, 9), round(q1, 9) DESC, candidate) AS INT) AS rank, candidate, round(macro, 6) AS customer_macro_date_mae, round(date_mae, 6) AS date_mae, round(q1, 6) AS quantity_within_1_rate
FROM s JOIN m USING (candidate) WHERE q1 + 1e-12 >= (SELECT q1 FROM s WHERE candidate = 'pair_median_qlast')""")
def candidate_ranking(spark, sf):
    """Candidates passing the quantity guardrail, best timing first."""
    summary = metrics.timing_summary(stored_scored(spark, sf), ["candidate"], HORIZON)
    return rounded(reports.rank_candidates(summary, "pair_median_qlast"))


@catalog.query("customer_scores", f"""
WITH {SCORED_SQL} SELECT candidate, customer_id, COUNT(*) AS origins, COUNT(*) FILTER (outcome = 'observed') AS observed, round(AVG(abs(d)), 6) AS date_mae,
round(AVG((abs(q) <= 1)::INT), 6) AS quantity_within_1_rate FROM scored GROUP BY 1, 2""")
def customer_scores(spark, sf):
    """Accuracy per candidate and customer."""
    return rounded(metrics.customer_scores(scored(spark, sf)))


@catalog.query("metric_comparison", f"""
WITH {SCORED_SQL}, p AS (SELECT candidate, fold, sqrt(AVG(pow(q, 2))) AS quantity_rmse, AVG(abs(q)) AS quantity_mae, AVG(abs(d)) AS date_mae_days FROM scored WHERE outcome = 'observed' GROUP BY 1, 2),
l AS (UNPIVOT p ON quantity_rmse, quantity_mae, date_mae_days INTO NAME metric VALUE v)
SELECT a.candidate, a.fold, a.metric, round(b.v, 6) AS baseline, round(a.v, 6) AS value, round(a.v - b.v, 6) AS delta, round((b.v - a.v) / nullif(b.v, 0), 6) AS improvement_fraction
FROM l a JOIN l b ON a.fold = b.fold AND a.metric = b.metric AND b.candidate = 'pair_median_qlast' WHERE a.candidate <> 'pair_median_qlast'""")
def metric_comparison(spark, sf):
    """Each candidate against the pair-median baseline."""
    report = stage(metrics.point_metrics(scored(spark, sf).filter(metrics.OBSERVED), ["candidate", "fold"], quantity="cart_quantity"), "report")
    return rounded(metrics.compare(report, "pair_median_qlast", ["fold"], ["quantity_rmse", "quantity_mae", "date_mae_days"]))


@catalog.query("population_diff", f"WITH {SCORED_SQL} SELECT COUNT(DISTINCT origin_event_id) AS origins, CAST(0 AS BIGINT) AS differences FROM scored")
def population_diff(spark, sf):
    """Two candidates cover the same origins with the same truth."""
    rows = stored_scored(spark, sf)
    a, b = (rows.filter(F.col("candidate") == c) for c in ("pair_median_qlast", "recent3_gap_qlast"))
    differing = quality.population_differences(a, b, "origin_event_id", ["customer_id", "product_id", "origin_on", "target_on", "target_gap_days", "target_quantity"])
    both = a.select(F.lit(1).alias("o"), F.lit(0).alias("d")).unionByName(differing.select(F.lit(0).alias("o"), F.lit(1).alias("d")))
    return both.agg(F.sum("o").alias("origins"), F.sum("d").alias("differences"))


@catalog.query("fold_coverage", f"""
WITH {SCORED_SQL} SELECT fold, COUNT(*) AS origins, COUNT(*) FILTER (outcome = 'observed') AS observed, round(COUNT(*) FILTER (outcome = 'observed') / COUNT(*), 6) AS evaluated_fraction FROM pred GROUP BY 1""")
def fold_coverage(spark, sf):
    """Observed share of each fold's origins."""
    labels = events.next_purchase_labels(tables.daily_events(spark, sf))
    rows = features.assign_folds(labels, FOLDS).withColumn("outcome", features.horizon_outcome(LAST_DAY, HORIZON))
    return rounded(reports.coverage(rows))


@catalog.query("repeat_misses", f"""
WITH {CART_SQL}, w AS (SELECT *, target_on < cart_on AS late FROM cart WHERE candidate = 'pair_median_qlast')
SELECT origin_event_id, CAST(miss AS BIGINT) AS miss_number FROM (SELECT *, SUM(CASE WHEN late THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id, product_id ORDER BY origin_on, origin_event_id) AS miss FROM w) WHERE late""")
def repeat_misses(spark, sf):
    """Late carts numbered within their pair."""
    from rebuyflow.operators.cadence import repeat_misses as number
    rows = with_cart(scored(spark, sf).filter("candidate = 'pair_median_qlast'")).withColumn("late", F.col("target_on") < F.to_date("cart_at"))
    return number(rows).filter("miss_number IS NOT NULL").select("origin_event_id", "miss_number")


@catalog.query("first_customers", f"""
WITH {SCORED_SQL}, f AS (SELECT history_group, customer_id, origin_on, origin_event_id, ROW_NUMBER() OVER (PARTITION BY history_group, customer_id ORDER BY origin_on, origin_event_id) AS k FROM pred),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY history_group ORDER BY origin_on, origin_event_id) AS rank FROM f WHERE k = 1)
SELECT history_group, CAST(rank AS INT) AS rank, customer_id, origin_on, origin_event_id FROM r WHERE rank <= 2""")
def first_customers(spark, sf):
    """First two customers of every history group."""
    return reports.first_customers(predictions(spark, sf), "history_group")


@catalog.query("hash_sample", f"WITH {SCORED_SQL} SELECT origin_event_id FROM hist ORDER BY sha256(origin_event_id) LIMIT 100")
def hash_sample(spark, sf):
    """Hundred origins in digest order."""
    return reports.hash_sample(seq(spark, sf).filter("event_state = 'completed'").select(F.col("event_id").alias("origin_event_id")), "origin_event_id", 100)


@catalog.query("hash_sample_per_fold", f"""
WITH {SCORED_SQL} SELECT fold, origin_event_id, CAST(k AS INT) AS sample_rank FROM (SELECT fold, origin_event_id, ROW_NUMBER() OVER (PARTITION BY fold ORDER BY sha256(origin_event_id)) AS k FROM pred) WHERE k <= 50""")
def hash_sample_per_fold(spark, sf):
    """Fifty origins per fold in digest order."""
    labels = events.next_purchase_labels(tables.daily_events(spark, sf))
    return reports.hash_sample_per(features.assign_folds(labels, FOLDS), "fold", "origin_event_id", 50).select("fold", "origin_event_id", "sample_rank")


@catalog.query("top_products", "SELECT p_type AS product_id, COUNT(*) AS rows FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY rows DESC, product_id LIMIT 2")
def top_products(spark, sf):
    """Two most frequent products."""
    return reports.top_products(tables.order_items(spark, sf))


@catalog.query("category_codes", "SELECT p_name AS product_name, ROW_NUMBER() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part JOIN lineitem ON l_partkey = p_partkey)")
def category_codes(spark, sf):
    """Alphabetical codes of product names that occur in orders."""
    return reports.category_codes(tables.order_items(spark, sf), "product_name")


HISTORY_VARIANTS = {"all": 1, "repeat": 2, "regular": 3}


@catalog.query("history_ablation", f"""
WITH {SCORED_SQL}, tv AS (SELECT fold, variant, product_id, target_gap_days FROM (
    SELECT *, unnest({list(HISTORY_VARIANTS)}) AS variant, unnest({list(HISTORY_VARIANTS.values())}) AS least FROM origins)
    JOIN folds ON origin_on BETWEEN train_end - 13 AND train_end - 7
    WHERE label_state = 'observed' AND target_gap_days BETWEEN 1 AND 7 AND episode_purchase_count >= least),
pv AS (SELECT fold, variant, product_id, MEDIAN(target_gap_days) AS g, COUNT(*) AS c FROM tv GROUP BY 1, 2, 3),
gv AS (SELECT fold, variant, MEDIAN(target_gap_days) AS g FROM tv GROUP BY 1, 2),
sv AS (SELECT gv.variant, CAST(greatest(1, floor(COALESCE(pv.g, gv.g) + 0.5)) AS BIGINT) - target_gap_days AS d, greatest(1, qty_last) - target_quantity AS q
  FROM pred JOIN gv ON gv.fold = pred.fold LEFT JOIN pv ON pv.fold = gv.fold AND pv.variant = gv.variant AND pv.product_id = pred.product_id AND pv.c >= 5
  WHERE outcome = 'observed' AND episode_purchase_count >= 2)
SELECT variant, COUNT(*) AS n, round(AVG((abs(d) <= 14)::INT), 6) AS date_within_14_rate, CAST(QUANTILE_DISC(abs(d), 0.8) AS BIGINT) AS date_80pct_tolerance_days,
 round(AVG((abs(d) <= 7 AND abs(q) <= 2)::INT), 6) AS joint_date_7_quantity_2_rate, round(AVG(abs(d)), 6) AS date_mae FROM sv GROUP BY 1""")
def history_ablation(spark, sf):
    """Training on all, repeat or regular histories, scored on the same repeat origins without their own gaps."""
    rows = stage(features.pair_features(hist(spark, sf)), "origins")
    train = baseline.fold_training_rows(rows, FOLDS, WINDOW_DAYS, HORIZON)
    train = features.training_variants(train, {name: features.has_history(least) for name, least in HISTORY_VARIANTS.items()})
    cell = F.concat_ws(":", "variant", "fold").alias("cell")  # variants x folds, both configured
    model = baseline.fit_baseline(train.select("*", cell), "cell")
    cohort = features.minimum_history(features.assign_folds(rows, FOLDS), 2).withColumn("gap_count", F.lit(0))
    asked = cohort.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in HISTORY_VARIANTS]))).select("*", cell)
    forecast = baseline.predict_baseline(asked, model, by="cell").withColumn("cart_quantity", baseline.quantity_rules()["last"])
    result = stage(baseline.scored(forecast, features.horizon_outcome(LAST_DAY, HORIZON)), "ablation")
    errors = result.filter(metrics.OBSERVED).groupBy("variant").agg(F.avg(F.abs(metrics.day_error())).alias("date_mae"))
    return rounded(metrics.score_extension(result, ["variant"]).join(errors, "variant"))
