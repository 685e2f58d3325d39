"""Reports over scored predictions: sections, acceptance, ranking, routing, deterministic examples."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.functions.scalars import count_if, safe_ratio
from rebuyflow.operators.metrics import monitor_metrics, weekly_metrics
from rebuyflow.plans.stages import stage

DIMENSION = ["candidate", "dimension", "value"]


def by_dimension(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Rows once for `overall` and once per named dimension, in long form.

    The same expansion GROUPING SETS performs, in a form every metric (including two-level macros) can group by.
    """
    entries = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value"))]
    entries += [F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value")) for name, value in dimensions.items()]
    return (rows.withColumn("d", F.explode(F.array(*entries))).withColumn("dimension", F.col("d.dimension"))
            .withColumn("value", F.col("d.value")).drop("d"))


def section_report(rows: DataFrame, dimensions: dict[str, Column], weekly_buyer_max_gap: int, monitoring_days: int) -> DataFrame:
    """Weekly-order and monitoring metrics per candidate, overall and by every dimension."""
    long = by_dimension(rows, dimensions)
    week = weekly_metrics(long, DIMENSION, weekly_buyer_max_gap).select(
        *DIMENSION, "n", "late", "late_rate", "early_1_to_10_rate", "early_over_30_rate", "customer_macro_late_rate", "median_margin_days")
    watch = monitor_metrics(long, DIMENSION, monitoring_days).select(*DIMENSION, "origins", "repurchased", "hits", "hit_rate")
    return week.join(watch, DIMENSION)


def acceptance(report: DataFrame, challenger: str, champion: str) -> DataFrame:
    """Whether the challenger is not worse than the champion, as named booleans in one row."""
    fields = ["n", "late_rate", "early_1_to_10_rate", "early_over_30_rate", "hit_rate"]
    wide = (report.filter(F.col("candidate").isin(challenger, champion)).groupBy("dimension", "value")
            .agg(*[F.max(F.when(F.col("candidate") == name, F.col(f))).alias(f"{side}_{f}")
                   for side, name in (("new", challenger), ("old", champion)) for f in fields]))
    overall = F.col("dimension") == "overall"
    hit = F.col("new_hit_rate") >= F.col("old_hit_rate")
    late = F.col("new_late_rate") <= F.col("old_late_rate")
    def every(dimension, condition):
        return F.bool_and(F.when(F.col("dimension") == dimension, condition))
    def once(condition):
        return F.bool_or(overall & condition)
    return wide.agg(
        once(hit).alias("monitor_hit_rate_not_worse"), every("period", hit).alias("monitor_hit_rate_not_worse_by_period"),
        every("fold", hit).alias("monitor_hit_rate_not_worse_all_folds"), once(late).alias("late_not_worse"),
        once(F.col("new_early_1_to_10_rate") > F.col("old_early_1_to_10_rate")).alias("early_1_to_10_improved"),
        once(F.col("new_early_over_30_rate") <= F.col("old_early_over_30_rate")).alias("early_over_30_not_increased"),
        every("group", late | (F.col("new_n") == 0)).alias("no_group_later"),
        (every("fold", late) | every("fold", ~late)).alias("same_direction_across_folds"))


def routing_report(records: DataFrame) -> DataFrame:
    """Fallback, later-than-champion and route-change shares with late rates, per class and overall (class NULL)."""
    attempted = F.col("agent_gap_days").isNotNull()
    late = F.when(F.col("outcome") == "observed", (F.datediff("target_on", F.to_date("cart_at")) < 0).cast("double"))
    fallback = F.col("reason").isNotNull()
    later = F.avg(F.when(attempted, (F.col("agent_gap_days") > F.col("champion_gap_days")).cast("double")))
    return (records.rollup(F.col("route_group").alias("customer_group")).agg(
        F.count("*").alias("records"), count_if(fallback).alias("fallbacks"), F.avg(fallback.cast("double")).alias("fallback_rate"),
        count_if(F.col("reason") == "high_uncertainty").alias("high_uncertainty"),
        count_if(F.col("reason") == "later_than_champion").alias("later_fallbacks"), later.alias("later_than_champion_rate"),
        count_if(F.col("route_changed")).alias("route_changed"), F.avg(F.when(F.col("route_changed"), late)).alias("late_rate_route_changed"),
        F.avg(F.when(~F.col("route_changed"), late)).alias("late_rate_route_kept")))


def routing_counts(records: DataFrame) -> DataFrame:
    """Rows by routed class, raw class, final agent and fallback reason per class, in long form."""
    final = F.when(F.col("reason").isNotNull(), "champion").otherwise(F.col("selected_agent"))
    entries = {"class": F.col("route_group"), "raw_class": F.col("raw_group"), "final_agent": final,
               "fallback_reason": F.concat_ws(":", "route_group", "reason")}
    listed = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in entries.items()])
    wanted = F.filter(listed, lambda e: (e.kind != "fallback_reason") | F.col("reason").isNotNull())
    return records.select(F.explode(wanted).alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("rows"))


def hysteresis_summary(routed: DataFrame) -> DataFrame:
    """How often routes switched, and how often hysteresis held a class back."""
    return routed.agg(F.count("*").alias("origins"), count_if(F.col("route_changed")).alias("switches"),
                      count_if(F.col("raw_group") != F.col("route_group")).alias("held_back"))


def rank_by(summary: DataFrame, metric: str) -> DataFrame:
    """Candidates by one score, smallest first; one row per candidate."""
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(F.round(metric, 9), "candidate"))).select("rank", "candidate", metric)


def rank_candidates(summary: DataFrame, baseline: str, tolerance: float = 1e-12) -> DataFrame:
    """Candidates at least as good as the baseline on quantity, best timing first.

    The summary has one row per candidate, so the ordered window is over a short table. Scores are compared to nine
    decimals: sums taken in another order must not decide a tie.
    """
    marked = summary.withColumn(
        "baseline_quantity", F.max(F.when(F.col("candidate") == baseline, F.col("quantity_within_1_rate"))).over(Window.partitionBy()))
    passed = F.col("quantity_within_1_rate") + tolerance >= F.col("baseline_quantity")
    order = Window.orderBy(F.round("customer_macro_date_mae", 9), F.round("date_mae", 9),
                           F.round("quantity_within_1_rate", 9).desc(), "candidate")
    return (marked.withColumn("quantity_guardrail_passed", passed).filter("quantity_guardrail_passed")
            .withColumn("rank", F.row_number().over(order))
            .select("rank", "candidate", "customer_macro_date_mae", "date_mae", "quantity_within_1_rate"))


def first_customers(rows: DataFrame, group: str, per_group: int = 2) -> DataFrame:
    """The first rows of the first distinct customers of each group, by origin day and id.

    Each customer is reduced to its first row before ranking, and Spark applies the rank limit before the shuffle.
    """
    first = rows.groupBy(group, "customer_id").agg(F.min(F.struct("origin_on", "origin_event_id")).alias("first"))
    w = Window.partitionBy(group).orderBy("first.origin_on", "first.origin_event_id")
    return (first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_group)
            .select(group, "rank", "customer_id", "first.origin_on", "first.origin_event_id"))


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Deterministic sample of n rows, ordered by the digest of the id and independent of any label."""
    return rows.orderBy(F.sha2(F.col(key), 256)).limit(n)


def hash_sample_per(rows: DataFrame, group: str, key: str, n: int, salts: int = 64) -> DataFrame:
    """The same sample within every group.

    A group is ranked in salted parts first, each keeping n rows (none beyond them can be among the group's first n);
    the final rank of a group sees at most `salts` times n rows, whatever n and the group's size are.
    """
    digest = F.sha2(F.col(key), 256)
    salted = rows.withColumn("sample_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    first = F.row_number().over(Window.partitionBy(group, "sample_salt").orderBy(digest))
    kept = salted.withColumn("sample_rank", first).filter(F.col("sample_rank") <= n).drop("sample_salt")
    last = F.row_number().over(Window.partitionBy(group).orderBy(digest))
    return kept.withColumn("sample_rank", last).filter(F.col("sample_rank") <= n)


def top_products(rows: DataFrame, n: int = 2) -> DataFrame:
    """Most frequent products."""
    return rows.groupBy("product_id").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "product_id").limit(n)


def schedule_summary(schedule: DataFrame) -> DataFrame:
    """Schedule rows by status, with pulled and adjusted carts."""
    return schedule.groupBy("status").agg(
        F.count("*").alias("rows"), count_if(F.col("store_rhythm_pulled")).alias("carts_pulled"),
        count_if(F.col("pair_adjustment_days") != 0).alias("carts_adjusted"), F.sum("cart_quantity").alias("cart_quantity"))


def open_by_agent(schedule: DataFrame) -> DataFrame:
    """Open suggestions by the agent that finally set their gap."""
    return (schedule.filter(F.col("status").isin("due", "scheduled"))
            .groupBy(F.coalesce("fallback_agent", "selected_agent").alias("agent")).agg(F.count("*").alias("rows")))


def category_codes(rows: DataFrame, column: str) -> DataFrame:
    """Alphabetical code (0, 1, ...) of every distinct value; absent values stay without a code.

    Values are split into ordered ranges and numbered within each; a range's offset is the number of values in the
    ranges before it. Only those offsets, one per range, pass through a single window.
    """
    values = rows.filter(F.col(column).isNotNull()).select(column).distinct()
    ranged = stage(values.repartitionByRange(column).withColumn("part", F.spark_partition_id()), "codes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return ranged.withColumn("within", within).join(F.broadcast(offsets), "part").select(column, (F.col("within") + F.col("offset")).alias("code"))


def coverage(outcomes: DataFrame) -> DataFrame:
    """Origins and outcome shares per fold."""
    return outcomes.groupBy("fold").agg(
        F.count("*").alias("origins"), count_if(F.col("outcome") == "observed").alias("observed"),
        safe_ratio(count_if(F.col("outcome") == "observed"), F.count("*")).alias("evaluated_fraction"))
