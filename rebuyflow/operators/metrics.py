"""Forecast evaluation. Every metric is a grouped aggregate over a long table of scored predictions.

Customer-macro values take a first aggregate per customer, so that a customer with very many rows is combined before
the shuffle like any other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebuyflow.functions.calendar import CART_POLICIES, clipped_lead, policy_gap
from rebuyflow.functions.scalars import count_if, improvement, rate, safe_ratio

OBSERVED = "outcome = 'observed'"
ABSENT = "no_repurchase_within_horizon"
UNKNOWN = "unknown_due_to_hold"


def _observed() -> Column:
    return F.col("outcome") == "observed"


def day_error() -> Column:
    return F.col("predicted_gap_days") - F.col("target_gap_days")


def quantity_error() -> Column:
    return F.col("cart_quantity") - F.col("target_quantity")


def customer_macro(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """Mean over customers of the customer's mean value, with the number of customers."""
    per_customer = rows.groupBy(*by, "customer_id").agg(F.avg(value.cast("double")).alias("m"))
    return per_customer.groupBy(*by).agg(F.avg("m").alias(name), F.count("m").alias("customers"))


def point_metrics(rows: DataFrame, by: list[str], tolerance_days: int = 7, quantity: str = "predicted_quantity") -> DataFrame:
    """Quantity and date errors of predictions with known targets."""
    error = F.col(quantity).cast("double") - F.col("target_quantity")
    days = day_error()
    target = F.col("target_quantity").cast("double")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("quantity_rmse"), F.avg(F.abs(error)).alias("quantity_mae"),
        safe_ratio(F.sum(F.abs(error)), F.sum(target)).alias("quantity_wape"), F.sum(target).alias("actual_quantity_sum"),
        F.sum(F.col(quantity).cast("double")).alias("predicted_quantity_sum"), F.avg(error).alias("quantity_bias_mean"),
        rate(error == 0).alias("quantity_exact_rate"), rate(error < 0).alias("quantity_under_rate"), rate(error > 0).alias("quantity_over_rate"),
        F.avg(F.abs(days)).alias("date_mae_days"), F.avg(days).alias("date_bias_days"),
        rate(F.abs(days) <= tolerance_days).alias("date_within_tolerance_rate"))


def with_empty_groups(report: DataFrame, by: str, names: list[str]) -> DataFrame:
    """The report with a zero row for every named group that has no observation."""
    listed = report.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias(by))
    return listed.join(report, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def timing_summary(rows: DataFrame, by: list[str], horizon_days: int) -> DataFrame:
    """Timing and quantity accuracy on observed repurchases, and how often non-returners were predicted to return."""
    seen, absent = _observed(), F.col("outcome") == ABSENT
    d, q = day_error(), quantity_error()
    small = seen & (F.col("target_quantity") <= 2)
    def share(condition, base=seen):
        return F.avg(F.when(base, condition.cast("double")))
    overall = rows.groupBy(*by).agg(
        F.count("*").alias("origins"), count_if(seen).alias("n"), count_if(absent).alias("no_repurchase_n"),
        count_if(F.col("outcome") == UNKNOWN).alias("unknown_n"),
        F.avg(F.when(seen, F.abs(d))).alias("date_mae"), share(F.abs(d) <= 3).alias("date_within_3_rate"),
        share(F.abs(d) <= 7).alias("date_within_7_rate"), share(d == 0).alias("date_exact_rate"), F.avg(F.when(seen, d)).alias("date_bias"),
        F.percentile(F.when(seen, F.abs(d)), F.lit(0.9)).alias("date_p90_abs_error"), F.avg(F.when(seen, F.abs(q))).alias("quantity_mae"),
        share(F.abs(q) <= 1).alias("quantity_within_1_rate"), share(F.abs(q) <= 2).alias("quantity_within_2_rate"),
        share(q == 0).alias("quantity_exact_rate"), share(q > 2).alias("quantity_over_by_more_than_2_rate"),
        share(q < -2).alias("quantity_under_by_more_than_2_rate"), count_if(small).alias("small_quantity_n"),
        share(q == 0, small).alias("small_quantity_exact_rate"), share(q >= 2, small).alias("small_quantity_over_by_2_or_more_rate"),
        share(F.col("predicted_gap_days") <= horizon_days, absent).alias("no_repurchase_but_predicted_within_horizon_rate"))
    macro = customer_macro(rows.filter(OBSERVED), by, F.abs(d), "customer_macro_date_mae")
    return overall.join(macro, by, "left")


def score_extension(rows: DataFrame, by: list[str]) -> DataFrame:
    """Wider tolerance, the error that covers 80 % of cases, and joint date and quantity accuracy."""
    d, q = F.abs(day_error()), F.abs(quantity_error())
    seen = rows.filter(OBSERVED).withColumn("abs_days", d)
    return seen.groupBy(*by).agg(
        F.count("*").alias("n"), rate(F.col("abs_days") <= 14).alias("date_within_14_rate"),
        F.expr("percentile_disc(0.8) WITHIN GROUP (ORDER BY abs_days)").cast("bigint").alias("date_80pct_tolerance_days"),
        rate((F.col("abs_days") <= 7) & (q <= 2)).alias("joint_date_7_quantity_2_rate"))


def margin_counts(margin: Column) -> dict[str, Column]:
    """Counts of carts by their margin (actual day minus cart day; same day is not early)."""
    return {"early": count_if(margin > 0), "same_day": count_if(margin == 0), "late": count_if(margin < 0),
            "early_1_to_10": count_if(margin.between(1, 10)), "early_over_30": count_if(margin > 30), "at_least_7_days": count_if(margin >= 7)}


def cart_policies(rows: DataFrame, by: list[str], horizon_days: int = 90, policies=CART_POLICIES) -> DataFrame:
    """Cart timing under each lead policy. The policies are a constant array exploded in the projection."""
    long = (rows.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
            .withColumn("cart_gap", policy_gap(F.col("predicted_gap_days"), F.col("policy")))
            .withColumn("margin", F.when(_observed(), F.col("target_gap_days") - F.col("cart_gap"))))
    margin, absent = F.col("margin"), F.col("outcome") == ABSENT
    keys = [*by, "policy"]
    overall = long.groupBy(*keys).agg(
        F.count("margin").alias("observed_n"), *[c.alias(n) for n, c in margin_counts(margin).items()],
        F.avg(F.when(margin.isNotNull(), (margin < 0).cast("double"))).alias("late_rate"),
        F.percentile("margin", F.lit(0.5)).alias("median_margin_days"), rate(F.col("cart_gap") == 1).alias("next_day_suggestion_rate_all"),
        count_if(absent).alias("nonreturn_n"),
        F.avg(F.when(absent, (F.col("cart_gap") <= horizon_days).cast("double"))).alias("nonreturn_suggestion_within_horizon_rate"))
    macro = customer_macro(long.filter("margin IS NOT NULL"), keys, margin < 0, "customer_macro_late_rate").drop("customers")
    return overall.join(macro, keys, "left")


def weekly_metrics(rows: DataFrame, by: list[str], weekly_buyer_max_gap: int = 7, horizon_days: int = 90) -> DataFrame:
    """Margins from the cart's release day, ordering-window share, weekly buyers and unnecessary carts."""
    released = F.to_date("cart_at")
    rows = rows.withColumn("margin", F.when(_observed(), F.datediff("target_on", released)))
    margin, seen, absent = F.col("margin"), _observed(), F.col("outcome") == ABSENT
    overall = rows.groupBy(*by).agg(
        F.count("margin").alias("n"), *[c.alias(n) for n, c in margin_counts(margin).items()],
        count_if(seen & F.weekday(released).isin(6, 0)).alias("sunday_or_monday"),
        count_if(seen & (F.col("predicted_gap_days") <= weekly_buyer_max_gap)).alias("weekly_buyer"),
        F.percentile("margin", F.lit(0.5)).alias("median_margin_days"), count_if(absent).alias("nonreturn_n"),
        F.avg(F.when(absent, (F.datediff(released, "origin_on") <= horizon_days).cast("double"))).alias("nonreturn_cart_within_horizon_rate"))
    rates = {f"{c}_rate": safe_ratio(F.col(c), F.col("n")) for c in ("late", "early_1_to_10", "early_over_30")}
    macro = customer_macro(rows.filter("margin IS NOT NULL"), by, margin < 0, "customer_macro_late_rate").drop("customers")
    return overall.withColumns(rates).join(macro, by, "left")


def monitor_metrics(rows: DataFrame, by: list[str], days: int = 45) -> DataFrame:
    """Repurchases inside the monitoring window predicted within seven days; the rest closes as misses."""
    scored = F.col("outcome") != UNKNOWN
    within = _observed() & (F.col("target_gap_days") <= days)
    hit = within & (F.abs(day_error()) <= 7)
    totals = rows.groupBy(*by).agg(count_if(scored).alias("origins"), count_if(within).alias("repurchased"), count_if(hit).alias("hits"))
    return totals.withColumns({
        "hit_rate": safe_ratio(F.col("hits"), F.col("repurchased")), "hit_rate_all_origins": safe_ratio(F.col("hits"), F.col("origins")),
        "closed_without_purchase_rate": 1 - safe_ratio(F.col("repurchased"), F.col("origins"))})


def lead_policies(rows: DataFrame, by: list[str], leads=(0, 7, 10)) -> DataFrame:
    """How carts placed a fixed lead before the prediction relate to the actual repurchase."""
    available = F.date_add("origin_on", 1)
    predicted = F.date_add("origin_on", F.col("predicted_gap_days").cast("int"))
    long = (rows.filter(OBSERVED).withColumn("lead_days", F.explode(F.array(*[F.lit(n) for n in leads])))
            .withColumn("margin", F.datediff("target_on", clipped_lead(predicted, available, F.col("lead_days")))))
    m = F.col("margin")
    return long.groupBy(*by, "lead_days").agg(
        F.count("*").alias("n"), count_if(m > 0).alias("before_repurchase"), count_if(m == 0).alias("same_day"), count_if(m < 0).alias("late"),
        count_if(m >= 7).alias("at_least_7_days_before"), count_if(m >= 10).alias("at_least_10_days_before"),
        count_if(m > 30).alias("over_30_days_before"),
        count_if(F.datediff(predicted, available) < F.col("lead_days")).alias("clipped_to_feature_availability"))


def daily_cohorts(rows: DataFrame, start, end, quantity: str = "predicted_quantity") -> DataFrame:
    """One row per origin day of the range, days without predictions included with NULL errors."""
    error = F.col(quantity).cast("double") - F.col("target_quantity")
    per_day = rows.groupBy("origin_on").agg(
        F.count("*").alias("n"), F.avg("target_quantity").alias("actual_mean"), F.avg(quantity).alias("predicted_mean"),
        F.avg(F.abs(error)).alias("quantity_mae"), F.sqrt(F.avg(error * error)).alias("quantity_rmse"),
        F.avg(F.abs(day_error())).alias("date_mae"))
    calendar = rows.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("origin_on"))
    return calendar.join(per_day, "origin_on", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def reaggregate_days(daily: DataFrame) -> DataFrame:
    """Overall errors rebuilt from daily cohorts, to reconcile with the direct aggregate."""
    n = F.sum("n")
    return daily.agg(n.alias("n"), (F.sum(F.col("quantity_mae") * F.col("n")) / n).alias("quantity_mae"),
                     F.sqrt(F.sum(F.col("quantity_rmse") * F.col("quantity_rmse") * F.col("n")) / n).alias("quantity_rmse"),
                     (F.sum(F.col("date_mae") * F.col("n")) / n).alias("date_mae_days"))


def weekly_cohorts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Point metrics by Monday of the origin week."""
    return point_metrics(rows.filter(OBSERVED).withColumn("week", F.to_date(F.date_trunc("week", "origin_on"))), [*by, "week"],
                         quantity="cart_quantity")


def quantity_band(quantity: Column) -> Column:
    """Diagnostic band of the actual quantity."""
    return F.when(quantity <= 1, "1").when(quantity <= 2, "2").when(quantity <= 5, "3-5").otherwise("6+")


def customer_scores(rows: DataFrame) -> DataFrame:
    """Accuracy per candidate and customer."""
    seen = _observed()
    return rows.groupBy("candidate", "customer_id").agg(
        F.count("*").alias("origins"), count_if(seen).alias("observed"), F.avg(F.when(seen, F.abs(day_error()))).alias("date_mae"),
        F.avg(F.when(seen, (F.abs(quantity_error()) <= 1).cast("double"))).alias("quantity_within_1_rate"))


def compare(report: DataFrame, baseline: str, by: list[str], metrics: list[str]) -> DataFrame:
    """Each candidate's metric next to the baseline candidate's: delta and relative improvement, one row per metric."""
    report = report.withColumn("section", F.lit("all")) if not by else report
    keys = by or ["section"]
    base = report.filter(F.col("candidate") == baseline).select(*keys, *[F.col(m).alias(f"{m}_base") for m in metrics])
    joined = report.filter(F.col("candidate") != baseline).join(base, keys)
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_base").alias("baseline"), F.col(m).alias("value")) for m in metrics])
    return (joined.select("candidate", *by, F.explode(entries).alias("e"))
            .select("candidate", *by, "e.metric", "e.baseline", "e.value", (F.col("e.value") - F.col("e.baseline")).alias("delta"),
                    improvement(F.col("e.baseline"), F.col("e.value")).alias("improvement_fraction")))
