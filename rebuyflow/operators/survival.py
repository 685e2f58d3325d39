"""Censored follow-up, Kaplan-Meier curves, landmark probabilities and their evaluation."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rebuyflow.functions.scalars import count_if, safe_ratio
from rebuyflow.functions.survival import aft_log_survival, conditional_probability
from rebuyflow.plans.stages import stage

# Landmark days, prediction window, alert thresholds and calibration bin edges.
LANDMARKS = (0, 7, 14, 21, 28, 35, 42, 49)
WINDOW_DAYS = 7
THRESHOLDS = (0.2, 0.35, 0.5)
BIN_EDGES = (0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)


def with_followup(labels: DataFrame, cutoff: Column, horizon_days: int) -> DataFrame:
    """Duration and event flag from what is known at the cutoff.

    Follow-up stops at the cutoff, the horizon, or the day before a hold; a target after the stop is censored.
    """
    stop = F.least(cutoff.cast("date"), F.date_add("origin_on", horizon_days), F.date_sub("blocking_on", 1))
    event = F.coalesce((F.col("label_state") == "observed") & (F.col("target_on") <= stop), F.lit(False))
    duration = F.when(event, F.datediff("target_on", "origin_on")).otherwise(F.greatest(F.lit(0), F.datediff(stop, "origin_on")))
    return labels.withColumn("event", event).withColumn("duration", duration)


def training_bounds(labels: DataFrame, folds, window_days: int, horizon_days: int) -> DataFrame:
    """Survival training rows per fold: mature origins with positive follow-up; upper bound NULL when censored."""
    listed = F.array(*[F.struct(F.lit(f.fold).alias("fold"), F.lit(f.train_end).alias("train_end")) for f in folds])
    usable = F.filter(listed, lambda f: F.col("origin_on").between(F.date_sub(f.train_end, window_days - 1),
                                                                   F.date_sub(f.train_end, horizon_days)))
    rows = (labels.withColumn("f", F.explode(usable))
            .select(*labels.columns, F.col("f.fold").alias("fold"), F.col("f.train_end").alias("train_end")))
    return (with_followup(rows, F.col("train_end"), horizon_days).filter("duration > 0")
            .withColumn("upper", F.when(F.col("event"), F.col("duration"))).drop("train_end"))


def kaplan_meier(bounds: DataFrame, by: list[str], horizon_days: int) -> DataFrame:
    """Discrete-day survival curve per group; events of a day are counted before that day's censored rows leave.

    Rows are reduced to counts per day first, so each curve is computed over horizon + 1 rows.
    """
    counts = bounds.groupBy(*by, F.col("duration").alias("day")).agg(
        count_if(F.col("event")).alias("events"), F.count("*").alias("leaving"))
    grid = (counts.groupBy(*by).agg(F.sum("leaving").alias("total"))
            .withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(horizon_days)))))
    days = grid.join(counts, [*by, "day"], "left").fillna(0, ["events", "leaving"])
    w = Window.partitionBy(*by).orderBy("day")
    left = F.coalesce(F.sum("leaving").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    factors = (days.withColumn("at_risk", F.col("total") - left)
               .withColumn("factor", F.when((F.col("at_risk") > 0) & (F.col("day") > 0), 1 - F.col("events") / F.col("at_risk")).otherwise(F.lit(1.0))))
    curve = F.product("factor").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return factors.select(*by, "day", "at_risk", "events", curve.alias("survival"))


def median_survival_day(curve: DataFrame, by: list[str], horizon_days: int) -> DataFrame:
    """First day on which survival is at most one half; the day after the horizon when it never is."""
    return curve.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("survival") <= 0.5, F.col("day"))), F.lit(horizon_days + 1)).alias("median_day"))


def landmarks(origins: DataFrame, days=LANDMARKS, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Origin x landmark rows still at risk whose outcome in the following window is known."""
    long = origins.withColumn("elapsed_days", F.explode(F.array(*[F.lit(d) for d in days])))
    end = F.col("elapsed_days") + window_days
    known = (F.col("duration") > F.col("elapsed_days")) & (F.col("event") | (F.col("duration") >= end))
    return long.filter(known).withColumn("event_next", (F.col("event") & (F.col("duration") <= end)).cast("int"))


def with_curve(rows: DataFrame, curve: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their group's curve as a map day -> survival; one map of horizon + 1 entries per group."""
    packed = curve.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("day", "survival"))).alias("curve"))
    return rows.join(packed, by)


def km_landmark_probability(rows: DataFrame, curve: DataFrame, by: list[str], window_days: int = WINDOW_DAYS) -> DataFrame:
    """Probability of an event within the window after each landmark, 1 - S(t+w)/S(t)."""
    start = F.element_at("curve", F.col("elapsed_days"))
    stop = F.element_at("curve", F.col("elapsed_days") + window_days)
    return with_curve(rows, curve, by).withColumn("probability", 1 - stop / F.nullif(start, F.lit(0.0))).drop("curve")


def aft_landmark_probability(margin: Column, distribution: str, scale, window_days: int = WINDOW_DAYS) -> Column:
    """The same probability from a survival regression's location of log time, for rows with `elapsed_days`."""
    start, stop = (aft_log_survival(margin, day, distribution, scale) for day in (F.col("elapsed_days"), F.col("elapsed_days") + window_days))
    return conditional_probability(start, stop)


def candidate_landmarks(rows: DataFrame, candidates: dict[str, Column]) -> DataFrame:
    """One long table of all candidates' probabilities: each landmark row is read once and repeated per candidate."""
    listed = F.array(*[F.struct(F.lit(name).alias("candidate"), value.alias("probability")) for name, value in candidates.items()])
    keep = [c for c in rows.columns if c not in ("candidate", "probability")]
    return rows.select(*keep, F.inline(listed))


def brier_macro(landmark_rows: DataFrame, by: list[str]) -> DataFrame:
    """Brier score plain and averaged landmark -> origin -> customer."""
    error = F.pow(F.col("probability") - F.col("event_next"), 2)
    per_origin = landmark_rows.groupBy(*by, "customer_id", "origin_event_id").agg(
        F.avg(error).alias("m"), F.sum(error).alias("s"), F.count("*").alias("k"), F.sum("event_next").alias("positives"))
    per_customer = per_origin.groupBy(*by, "customer_id").agg(
        F.avg("m").alias("m"), F.sum("s").alias("s"), F.sum("k").alias("k"), F.sum("positives").alias("positives"))
    return per_customer.groupBy(*by).agg(
        F.sum("k").alias("landmarks_n"), F.sum("positives").alias("landmark_positive_n"), F.avg("m").alias("landmark_customer_macro_brier"),
        (F.sum("s") / F.sum("k")).alias("landmark_brier"), F.count("*").alias("landmark_customers"))


def horizon_brier(origins: DataFrame, by: list[str], probability: str) -> DataFrame:
    """Brier score of the whole-horizon probability over origins with a known outcome."""
    known = origins.filter("outcome <> 'unknown_due_to_hold'")
    truth = (F.col("outcome") == "observed").cast("double")
    return known.groupBy(*by).agg(F.count("*").alias("horizon_known_n"), F.avg(F.pow(F.col(probability) - truth, 2)).alias("horizon_brier"))


def threshold_confusion(landmark_rows: DataFrame, by: list[str], thresholds=THRESHOLDS) -> DataFrame:
    """Confusion counts and rates per alert threshold."""
    long = landmark_rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    alert, truth = F.col("probability") >= F.col("threshold"), F.col("event_next") == 1
    counts = long.groupBy(*by, "threshold").agg(
        count_if(alert & truth).alias("tp"), count_if(alert & ~truth).alias("fp"), count_if(~alert & truth).alias("fn"),
        count_if(~alert & ~truth).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn),
                               "false_positive_rate": safe_ratio(fp, fp + tn), "alert_rate": safe_ratio(tp + fp, tp + fp + fn + tn)})


def calibration(landmark_rows: DataFrame, edges=BIN_EDGES) -> DataFrame:
    """Mean probability and event rate per probability bin; empty bins are kept, the last bin includes 1."""
    p = F.col("probability")
    number = F.lit(0)
    for edge in edges[1:-1]:
        number = number + (p >= edge).cast("int")
    filled = landmark_rows.groupBy(number.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg("event_next").alias("event_rate"))
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"))
                     for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    listed = landmark_rows.sparkSession.range(1).select(F.inline(bins))
    return listed.join(filled, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("bin")


def risk_coverage(origins: DataFrame, by: list[str], days=LANDMARKS, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Per elapsed day: already repurchased, unknown because of a hold, evaluable."""
    long = origins.withColumn("elapsed_days", F.explode(F.array(*[F.lit(d) for d in days])))
    bought = F.col("event") & (F.col("duration") <= F.col("elapsed_days"))
    unknown = ~F.col("event") & (F.col("duration") < F.col("elapsed_days") + window_days)
    return long.groupBy(*by, "elapsed_days").agg(
        count_if(bought).alias("already_repurchased"), count_if(unknown).alias("unknown_due_to_hold"), count_if(~bought & ~unknown).alias("evaluable"))


# --- paired bootstrap over customers ------------------------------------------------------------------------------

DRAWS_PER_DIGEST = 4


def poisson_cdf(most: int = 16) -> list[float]:
    """P(Poisson(1) <= k) for k = 0..most."""
    total, out = 0.0, []
    for k in range(most + 1):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return out


def bootstrap_weight(digest: Column, draw: int) -> Column:
    """Poisson(1) count of one replicate from 52 bits of the digest."""
    uniform = F.conv(F.substring(digest, 16 * draw + 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))
    weight = F.lit(0)
    for bound in poisson_cdf():
        weight = weight + (uniform >= bound).cast("int")
    return weight


CUSTOMERS_AT_ONCE = 512


def customer_weights(customers: list[str | None], replicates: int) -> np.ndarray:
    """`bootstrap_weight` of every replicate, one row per customer; a missing customer leaves the separator out."""
    blocks = range(replicates // DRAWS_PER_DIGEST)
    named, unnamed = [f"{b}:".encode() for b in blocks], [str(b).encode() for b in blocks]
    digests = b"".join(hashlib.sha256(block + own).digest() for customer in customers
                       for own in [(customer or "").encode()] for block in (unnamed if customer is None else named))
    uniform = (np.frombuffer(digests, ">u8") >> np.uint64(12)).astype(float) / 2**52
    return np.searchsorted(poisson_cdf(), uniform, side="right").reshape(len(customers), replicates).astype(float)


def weighted_sums(customers: DataFrame, by: list[str], values: list[str], replicates: int) -> DataFrame:
    """(by, replicate, values): per replicate the sums of the customers' values times their weights; a missing value adds nothing.

    Rows lie by customer, so a customer's weights are drawn once for all its rows. A row is hundreds of digests, so the
    number of tasks follows the session's and not the few bytes of a customer.
    """
    schema = customers.select(*by).schema
    groups, kinds = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema]), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, CUSTOMERS_AT_ONCE):
                batch = whole.slice(at, CUSTOMERS_AT_ONCE)
                coded = batch.column("customer").dictionary_encode("encode")
                weights = customer_weights(coded.dictionary.to_pylist(), replicates)[coded.indices.to_numpy()]
                amounts = np.column_stack([batch.column(v).fill_null(0.0).to_numpy() for v in values])
                keys = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows
                for key in set(keys):
                    mine = np.array([k == key for k in keys])
                    totals[key] = totals.get(key, 0) + weights[mine].T @ amounts[mine]
        for key, own in totals.items():
            named = [pa.array([k] * replicates, f.type) for k, f in zip(key, groups)]
            yield pa.RecordBatch.from_arrays([*named, pa.array(range(replicates), pa.int32()), *[pa.array(own[:, k]) for k in range(len(values))]], [*by, "replicate", *values])

    tasks = int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (customers.select(*by, F.col("customer_id").cast("string").alias("customer"), *[F.col(v).cast("double").alias(v) for v in values])
             .repartition(tasks, "customer").sortWithinPartitions("customer"))
    sums = dealt.mapInArrow(add, ", ".join([*([kinds] if by else []), "replicate int", *[f"`{v}` double" for v in values]]))
    return sums.groupBy(*by, "replicate").agg(*[F.sum(v).alias(v) for v in values])


def flag_bootstrap(pairs: DataFrame, by: list[str], flags: list[str], replicates: int = 2000) -> DataFrame:
    """Mean of each paired difference in `flags` with a 95 % interval from resampling whole customers, one row per flag.

    Each customer gets an independent Poisson(1) weight per replicate, derived from a digest of replicate and customer:
    the large-sample form of drawing customers with replacement. It needs neither an index over customers nor a join.
    A draw's weight multiplies the customer's whole vector of totals, so all flags and candidates share the same weights
    (paired) at one digest per customer and four draws; a task sends one vector of partial sums per replicate.
    """
    if replicates % DRAWS_PER_DIGEST:
        raise ValueError(f"Replicates must be a multiple of {DRAWS_PER_DIGEST}")
    totals = {f"t{k}": flag for k, flag in enumerate(flags)}
    customers = stage(pairs.groupBy(*by, "customer_id").agg(
        *[F.sum(flag).cast("double").alias(t) for t, flag in totals.items()], F.count("*").alias("n")), "customers")
    sums = weighted_sums(customers, by, [*totals, "n"], replicates)
    means = sums.select(*by, F.inline(F.array(*[F.struct(F.lit(flag).alias("flag"), safe_ratio(F.col(t), F.col("n")).alias("mean")) for t, flag in totals.items()])))
    interval = means.groupBy(*by, "flag").agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    point = customers.groupBy(*by).agg(*[(F.sum(t) / F.sum("n")).alias(t) for t in totals], F.sum("n").alias("n"), F.count("*").alias("customers"))
    listed = point.select(*by, "n", "customers", F.inline(F.array(*[F.struct(F.lit(flag).alias("flag"), F.col(t).alias("delta")) for t, flag in totals.items()])))
    joined = listed.join(interval, [*by, "flag"])
    return joined.withColumns({c: F.when(F.col("delta").isNotNull(), F.col(c)) for c in ("low", "high")})  # a flag that is never known has no mean


def paired_bootstrap(pairs: DataFrame, by: list[str], replicates: int = 2000) -> DataFrame:
    """Mean of `difference` with its interval: the bootstrap of one flag."""
    return flag_bootstrap(pairs, by, ["difference"], replicates).drop("flag")


def timing_flags(margin: Column, window_days: int = 10) -> dict[str, Column]:
    """The three flags of a cart by its margin (actual day minus cart day): in the window, late, too early."""
    return {"window": margin.between(0, window_days).cast("int"), "late": (margin < 0).cast("int"), "too_early": (margin > window_days).cast("int")}
