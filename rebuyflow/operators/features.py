"""Past-only features at each purchase day, and the purged calendar split.

Every ordered window runs on groups bounded by the calendar: a pair has one event per day, and customer and product
statistics are first summed per (customer, day) and (product, day). Facts of a whole day are attached to all events
of that day, so results do not depend on input order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.config import SplitConfig
from rebuyflow.functions.calendar import next_midnight, to_utc
from rebuyflow.functions.scalars import median_of, pstdev_of, total_of
from rebuyflow.operators.events import PAIR, label_columns

# Model features, the product being the only category.
BASE_FEATURES = ["product_id", "origin_weekday", "origin_month", "episode_purchase_count", "episode_age_days", "qty_last",
                 "qty_mean", "qty_mean_last3", "qty_median_last3", "qty_std_last3", "qty_sum_7d", "qty_sum_28d", "gap_count",
                 "gap_last_days", "gap_mean_days", "gap_median_days", "customer_purchase_days", "customer_product_count",
                 "product_purchase_events", "product_customer_count", "product_mean_quantity"]
NUMERIC_FEATURES = [c for c in BASE_FEATURES if c != "product_id"]

UNBOUNDED, CURRENT = Window.unboundedPreceding, Window.currentRow


def recent(column: str, window, n: int) -> Column:
    """The last n values up to the current row, oldest first, as an array of at most n elements."""
    return F.array_compact(F.array(*[F.lag(column, i).over(window) for i in range(n - 1, 0, -1)], F.col(column)))


def last_n(values: Column, n: int) -> Column:
    """The last n elements of an array."""
    return F.slice(values, F.greatest(F.size(values) - (n - 1), F.lit(1)), F.lit(n))


RECENT_GAPS = 6


def history(seq: DataFrame) -> DataFrame:
    """Active events with everything known about the pair's episode at the end of the day.

    All windows follow the pair, so they share one shuffle. Held rows stay (customer rhythm needs them); their
    quantity and gap are NULL and drop out of every statistic.
    """
    rows = seq.withColumn("day_number", F.unix_date("ordered_on"))
    episode = Window.partitionBy(*PAIR, "island").orderBy("day_number")
    so_far = episode.rowsBetween(UNBOUNDED, CURRENT)
    completed = F.col("event_state") == "completed"
    return (rows.withColumn("last3", recent("quantity", episode, 3))
            .withColumn("pair_gaps", recent("gap_days", episode, RECENT_GAPS))
            .withColumn("qty_mean", F.avg("quantity").over(so_far))
            .withColumn("qty_sum_7d", F.sum("quantity").over(episode.rangeBetween(-6, 0)))
            .withColumn("qty_sum_28d", F.sum("quantity").over(episode.rangeBetween(-27, 0)))
            .withColumn("episode_start", F.first(F.when(completed, F.col("ordered_on")), ignorenulls=True).over(so_far))
            .withColumn("gap_mean_days", F.avg("gap_days").over(so_far))
            .withColumn("gap_median_days", F.percentile("gap_days", F.lit(0.5)).over(so_far))
            .drop("day_number"))


def pair_features(hist: DataFrame) -> DataFrame:
    """Features of the pair and the label, one row per completed day; no shuffle after `history`."""
    index = F.col("episode_purchase_index")
    label = label_columns()
    return hist.filter("event_state = 'completed'").select(
        F.col("event_id").alias("origin_event_id"), *PAIR, F.col("ordered_on").alias("origin_on"), "episode_id",
        F.weekday("ordered_on").alias("origin_weekday"), F.month("ordered_on").alias("origin_month"),
        index.alias("episode_purchase_count"), F.datediff("ordered_on", "episode_start").alias("episode_age_days"),
        F.col("quantity").alias("qty_last"), "qty_mean",
        (total_of(F.col("last3")) / F.size("last3")).alias("qty_mean_last3"),
        median_of(F.col("last3")).alias("qty_median_last3"), pstdev_of(F.col("last3")).alias("qty_std_last3"),
        "qty_sum_7d", "qty_sum_28d", (index - 1).alias("gap_count"), F.col("gap_days").alias("gap_last_days"),
        "gap_mean_days", "gap_median_days", median_of(last_n(F.col("pair_gaps"), 3)).alias("recent3_gap"), "pair_gaps",
        *[c.alias(n) for n, c in label.items()])


def customer_days(hist: DataFrame) -> DataFrame:
    """Per customer and purchase day: running purchase days and distinct products, and the recent visit gaps.

    A product counts on the day of its first purchase, which turns a running distinct count into a running sum. A day
    with any held event clears the visit history first; a completed event of the same day starts a new one.
    """
    bought = F.max(F.when(F.col("event_state") == "completed", 1).otherwise(0))
    held = F.max(F.when(F.col("event_state") == "held", 1).otherwise(0))
    per_day = hist.groupBy("customer_id", "ordered_on").agg(
        bought.alias("bought"), held.alias("held"), F.sum(F.col("first_of_pair").cast("int")).alias("new_products"))
    ordered = Window.partitionBy("customer_id").orderBy("ordered_on")
    running = ordered.rowsBetween(UNBOUNDED, CURRENT)
    visits = (per_day.withColumn("customer_purchase_days", F.sum("bought").over(running))
              .withColumn("customer_product_count", F.sum("new_products").over(running))
              .withColumn("stretch", F.sum("held").over(running)).filter("bought = 1"))
    stretch = Window.partitionBy("customer_id", "stretch").orderBy("ordered_on")
    gaps = visits.withColumn("visit_gap", F.datediff("ordered_on", F.lag("ordered_on").over(stretch)))
    return gaps.select("customer_id", F.col("ordered_on").alias("origin_on"), "customer_purchase_days", "customer_product_count",
                       "visit_gap", F.row_number().over(stretch).alias("visit_index"),
                       recent("visit_gap", stretch, RECENT_GAPS).alias("customer_gaps"))


def product_days(hist: DataFrame) -> DataFrame:
    """Running events, distinct customers and mean quantity per product, at the end of each day."""
    per_day = hist.filter("event_state = 'completed'").groupBy("product_id", "ordered_on").agg(
        F.count("*").alias("events"), F.sum("quantity").alias("quantity"),
        F.sum(F.col("first_of_pair").cast("int")).alias("new_customers"))
    w = Window.partitionBy("product_id").orderBy("ordered_on").rowsBetween(UNBOUNDED, CURRENT)
    return per_day.select("product_id", F.col("ordered_on").alias("origin_on"),
                          F.sum("events").over(w).alias("product_purchase_events"),
                          F.sum("new_customers").over(w).alias("product_customer_count"),
                          (F.sum("quantity").over(w) / F.sum("events").over(w)).alias("product_mean_quantity"))


def known_snapshots(events: DataFrame) -> DataFrame:
    """Latest snapshot time seen up to each day, one row per calendar day.

    The unpartitioned window sees one row per day only; the maximum per day is taken before it.
    """
    per_day = (events.filter(F.col("event_state").isin("completed", "held"))
               .groupBy("ordered_on").agg(F.max("snapshot_observed_at").alias("seen")))
    w = Window.orderBy("ordered_on").rowsBetween(UNBOUNDED, CURRENT)
    return per_day.select(F.col("ordered_on").alias("origin_on"), F.max("seen").over(w).alias("feature_snapshot_observed_at"))


def origin_table(hist: DataFrame) -> DataFrame:
    """Every completed day with its 21 features and label.

    `hist` is read three times, so pass a stored table. The joins on (customer, day) and (product, day) spread a hot
    customer or product over its days.
    """
    return with_day_facts(pair_features(hist).drop("pair_gaps"), hist)


def with_day_facts(origins: DataFrame, hist: DataFrame) -> DataFrame:
    """Origins with what is known of their customer and product at the end of the day."""
    customers = customer_days(hist).drop("visit_gap", "visit_index", "customer_gaps")
    return origins.join(customers, ["customer_id", "origin_on"]).join(product_days(hist), ["product_id", "origin_on"])


def split_columns(origin_on: Column, cfg: SplitConfig) -> dict[str, Column]:
    """Outer split, fit role and the role's cutoff day of an origin day; NULL role outside the window."""
    day = lambda value: F.lit(value).cast("date")
    outside = (origin_on < day(cfg.start)) | (origin_on > day(cfg.test_end))
    core = origin_on <= day(cfg.train_core_end)
    train = origin_on <= day(cfg.train_end)
    valid = origin_on <= day(cfg.validation_end)
    return {
        "outer_split": F.when(outside, "out_of_window").when(train, "train").when(valid, "validation").otherwise("test"),
        "fit_role": (F.when(outside, F.lit(None).cast("string")).when(core, "train_core").when(train, "early_stop")
                     .when(valid, "validation").otherwise("final_test")),
        "role_cutoff": (F.when(outside, F.lit(None).cast("date")).when(core, day(cfg.train_core_end)).when(train, day(cfg.train_end))
                        .when(valid, day(cfg.validation_end)).otherwise(day(cfg.test_end)))}


def with_split(origins: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Origins with split, outcome and eligibility; a target beyond the role's cutoff is purged."""
    rows = origins.withColumns(split_columns(F.col("origin_on"), cfg))
    observed = F.col("label_state") == "observed"
    outcome = (F.when(F.col("outer_split") == "out_of_window", "out_of_window")
               .when(observed & (F.col("target_on") > F.col("role_cutoff")), "crosses_role_boundary")
               .otherwise(F.col("label_state")))
    pool = (F.col("outer_split") == "train") & observed & (F.col("target_on") <= F.lit(cfg.train_end).cast("date"))
    return (rows.withColumn("split_outcome", outcome).withColumn("role_eligible", F.col("split_outcome") == "observed")
            .withColumn("train_pool", F.coalesce(pool, F.lit(False))))


def with_availability(origins: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Whether features were known at prediction time and the label before the role's cutoff ended.

    `snapshots` has one row per calendar day, so it is broadcast.
    """
    rows = origins.join(F.broadcast(snapshots), "origin_on", "left")
    as_of = to_utc(next_midnight(F.col("origin_on")))
    known = F.col("feature_snapshot_observed_at").cast("timestamp_ntz") <= as_of
    label_known = F.col("label_snapshot_observed_at").cast("timestamp_ntz") < to_utc(next_midnight(F.col("role_cutoff")))
    return (rows.withColumn("prediction_asof", next_midnight(F.col("origin_on")))
            .withColumn("feature_timestamp_available", known)
            .withColumn("timestamp_availability_pass", F.coalesce(F.col("role_eligible") & known & label_known, F.lit(False))))


def build_origins(hist: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Origin table with split, eligibility and availability."""
    return with_availability(with_split(origin_table(hist), cfg), known_snapshots(hist))


def split_crosstab(origins: DataFrame) -> DataFrame:
    """Origins by role and outcome, with eligible and training-pool rows."""
    return origins.groupBy("outer_split", "fit_role", "split_outcome").agg(
        F.count("*").alias("origins"), F.sum(F.col("role_eligible").cast("bigint")).alias("eligible"),
        F.sum(F.col("train_pool").cast("bigint")).alias("train_pool_rows"))


def in_training_window(cutoff, window_days: int, horizon_days: int) -> Column:
    """Mature training rows: origins old enough to be followed for the horizon, observed within it."""
    end = F.lit(cutoff).cast("date")
    return (F.col("origin_on").between(F.date_sub(end, window_days - 1), F.date_sub(end, horizon_days))
            & (F.col("label_state") == "observed") & (F.col("target_gap_days") > 0) & (F.col("target_gap_days") <= horizon_days))


def training_window(origins: DataFrame, cutoff, window_days: int, horizon_days: int) -> DataFrame:
    """The mature training rows before a cutoff."""
    return origins.filter(in_training_window(cutoff, window_days, horizon_days))


def horizon_outcome(end, horizon_days: int) -> Column:
    """Outcome within the horizon after an origin; not mature when the horizon passes the data's end."""
    deadline = F.date_add("origin_on", horizon_days)
    state = F.col("label_state")
    return (F.when(deadline > F.lit(end).cast("date"), "not_mature")
            .when((state == "observed") & (F.col("target_on") <= deadline), "observed")
            .when((state == "blocked_by_hold") & (F.col("blocking_on") <= deadline), "unknown_due_to_hold")
            .otherwise("no_repurchase_within_horizon"))


def without_exceptional_period(rows: DataFrame, start, end) -> DataFrame:
    """Training rows whose origin and target both lie outside an exceptional period."""
    inside = lambda c: F.coalesce(F.col(c).between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
    return rows.filter(~(inside("origin_on") | inside("target_on")))


def has_history(purchases: int) -> Column:
    """The pair has at least this many purchases in the episode."""
    return F.col("episode_purchase_count") >= purchases


def minimum_history(origins: DataFrame, purchases: int) -> DataFrame:
    """Origins of pairs with at least this many purchases in the episode."""
    return origins.filter(has_history(purchases))


def training_variants(train: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """One long table (variant, training row): what each variant keeps is a flag of one table that is read once."""
    kept = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in keep.items()]))
    return train.withColumn("variant", F.explode(kept))


def assign_folds(origins: DataFrame, folds) -> DataFrame:
    """One row per origin and fold whose origin range contains it.

    Folds are a short configured list, kept as an array in the projection: no join.
    """
    listed = F.array(*[F.struct(F.lit(f.fold).alias("fold"), F.lit(f.train_end).alias("train_end"),
                                F.lit(f.origin_start).alias("start"), F.lit(f.origin_end).alias("end")) for f in folds])
    matching = F.filter(listed, lambda f: F.col("origin_on").between(f.start, f.end))
    return (origins.withColumn("f", F.explode(matching))
            .select(*origins.columns, F.col("f.fold").alias("fold"), F.col("f.train_end").alias("fold_train_end")))


# --- product identity as an input ---------------------------------------------------------------------------------

PRODUCT_TARGETS = ["product_target_count", "product_target_gap", "product_target_quantity"]


def product_targets(labels: DataFrame, prior_weight: float = 10.0) -> DataFrame:
    """(product_id, origin_on, ...): per product and origin day the mean gap and quantity of the labels known by then.

    A label is known once its target day lies before the origin day, so a row never sees its own outcome nor one of its
    day. Each mean is drawn towards that of all products, known at the same day, by `prior_weight` labels; the first
    days have no label at all and stay NULL. Labels are summed per product and day first: a product is as many rows as
    days, and the running sum over all products is one row a day.
    """
    known = (labels.filter("label_state = 'observed'").groupBy("product_id", F.col("target_on").alias("day"))
             .agg(F.count("*").alias("n"), F.sum("target_gap_days").alias("gap"), F.sum("target_quantity").alias("quantity")))
    asked = labels.select("product_id", F.col("origin_on").alias("day")).distinct()
    days = (asked.withColumn("asked", F.lit(True)).join(known, ["product_id", "day"], "full").withColumn("number", F.unix_date("day")))
    mine, every = Window.partitionBy("product_id").orderBy("number").rangeBetween(UNBOUNDED, -1), Window.orderBy("number").rangeBetween(UNBOUNDED, -1)
    own = days.withColumns({f"own_{c}": F.sum(c).over(mine) for c in ("n", "gap", "quantity")}).filter("asked")
    per_day = days.groupBy("day", "number").agg(*[F.sum(c).alias(c) for c in ("n", "gap", "quantity")])
    overall = per_day.select("day", *[F.sum(c).over(every).alias(f"all_{c}") for c in ("n", "gap", "quantity")])

    def mean(c):
        prior = F.col(f"all_{c}") / F.col("all_n")
        return (F.coalesce(f"own_{c}", F.lit(0)) + prior * prior_weight) / (F.coalesce("own_n", F.lit(0)) + prior_weight)

    return own.join(overall, "day").select("product_id", F.col("day").alias("origin_on"), F.coalesce("own_n", F.lit(0)).alias("product_target_count"),
                                           mean("gap").alias("product_target_gap"), mean("quantity").alias("product_target_quantity"))


def with_product_targets(origins: DataFrame, prior_weight: float = 10.0) -> DataFrame:
    """Origins with the target statistics of their product; joined on (product, day), which spreads a hot product."""
    return origins.join(product_targets(origins, prior_weight), ["product_id", "origin_on"], "left")
