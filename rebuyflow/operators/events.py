"""Daily purchase events, episodes between holds, and next-purchase labels."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.functions.scalars import count_if, list_key
from rebuyflow.plans.skew import attach_group_facts, balanced

PAIR = ["customer_id", "product_id"]


def event_key() -> Column:
    """Identifier of a daily event: a digest of its customer, product and day."""
    return list_key(*[F.col(c) for c in (*PAIR, "ordered_on")])


def day_states(policy_rows: DataFrame, stored: bool = False) -> DataFrame:
    """One event per customer, product and day from policy rows.

    Held when any active row is a barrier, completed when any row is active; otherwise an audit row. Quantity counts
    only on completed days. `stored` rows are a stored table: their orders and days are made in one shuffle by day, unless a
    day holds a large share of the rows (its orders combine before a shuffle of their own then).
    """
    day_keys = [*PAIR, "ordered_on"]
    if stored and balanced(policy_rows, day_keys):
        policy_rows = policy_rows.repartition(*day_keys)
    decision = F.col("purchase_decision")
    excluded = decision.startswith("exclude_")
    per_order = policy_rows.groupBy(*PAIR, "ordered_on", "order_id").agg(
        F.count("*").alias("n"), F.max(~excluded).alias("active"), F.max(~excluded & F.col("sequence_barrier")).alias("held"),
        F.max(excluded & (decision != "exclude_cancelled")).alias("other_exclusion"),
        F.sum(F.when(~excluded, F.col("quantity"))).alias("quantity"), F.max("extracted_at").alias("seen"))
    day = per_order.groupBy(*PAIR, "ordered_on").agg(
        F.sum("n").alias("source_rows"), F.count("*").alias("order_count"), F.max("active").alias("active"),
        F.max("held").alias("held"), F.max("other_exclusion").alias("other_exclusion"),
        F.sum("quantity").alias("quantity"), F.max("seen").alias("snapshot_observed_at"))
    state = (F.when(F.col("held"), "held").when(F.col("active"), "completed")
             .when(F.col("other_exclusion"), "excluded_only").otherwise("cancelled_only"))
    return day.select(event_key().alias("event_id"),
                      *PAIR, "ordered_on", state.alias("event_state"),
                      F.when(state == "completed", F.col("quantity")).alias("quantity"),
                      "source_rows", "order_count", "snapshot_observed_at")


def row_disposition(policy_rows: DataFrame, events: DataFrame, identity: Column, stored: bool = False) -> DataFrame:
    """Every source row with its event of `day_states`, disposition and contribution to the event's quantity.

    Rows meet their event by customer, product and day; the event's identifier, a digest of these, is made again from the
    row instead of being sent along. `stored`: the events are a stored table.
    """
    facts = events.select(*PAIR, "ordered_on", "event_state", "source_rows")
    rows = attach_group_facts(policy_rows, facts, [*PAIR, "ordered_on"], "source_rows", identity, stored=stored).withColumn("event_id", event_key())
    decision = F.col("purchase_decision")
    disposition = (F.when(decision.startswith("exclude_"), decision)
                   .when(F.col("event_state") == "completed", "include_completed")
                   .when(decision == "include_completed", "hold_same_day").otherwise(decision))
    return (rows.withColumn("row_disposition", disposition)
            .withColumn("event_quantity_contribution",
                        F.when(disposition == "include_completed", F.col("quantity")).otherwise(F.lit(0).cast("bigint"))))


def by_day(events: DataFrame) -> DataFrame:
    """Events known by their day instead of their identifier, for `sequence`: within a pair that is enough, and short."""
    return events.withColumn("event_id", F.struct("ordered_on"))


def named(rows: DataFrame) -> DataFrame:
    """A sequence of events known by their day (`by_day`), or labels made of one, with the identifiers made again: digests of pair and day.

    Columns that hold identifiers already stay as they are.
    """
    def name(event: Column) -> Column:
        return F.when(event.isNotNull(), list_key(*[F.col(c) for c in PAIR], event.ordered_on))
    kinds = dict(rows.dtypes)
    made = {c: name(F.col(c)) for c in ("event_id", "episode_id", "origin_event_id", "target_event_id", "blocking_event_id")
            if kinds.get(c, "").startswith("struct<")}
    if kinds.get("next_event", "").startswith("struct<event_id:struct<"):
        following = F.col("next_event")
        made["next_event"] = F.when(following.isNotNull(), following.withField("event_id", name(following.event_id)))
    return rows.withColumns(made) if made else rows


def sequence(events: DataFrame, digests: bool = False) -> DataFrame:
    """Active events (completed or held) in pair order, with episode, index, gap and the following event.

    A held day ends the episode. A pair has at most one event per day, so a partition of this window is bounded by the
    calendar whatever the number of source rows. `digests`: the events' identifiers are their `event_key`, which is
    made again instead of being sent along.
    """
    if digests:
        return named(sequence(by_day(events)))
    active = events.filter(F.col("event_state").isin("completed", "held"))
    pair = Window.partitionBy(*PAIR).orderBy("ordered_on")
    past = pair.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    completed = F.col("event_state") == "completed"
    following = F.struct("event_id", "event_state", "ordered_on", "quantity", "snapshot_observed_at")
    islands = (active
               .withColumn("island", F.sum(F.when(completed, 0).otherwise(1)).over(past))
               .withColumn("pair_purchases", F.sum(F.when(completed, 1).otherwise(0)).over(past))
               .withColumn("next_event", F.lead(following).over(pair)))
    episode = Window.partitionBy(*PAIR, "island").orderBy("ordered_on")
    so_far = episode.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first_completed = F.first(F.when(completed, F.col("event_id")), ignorenulls=True).over(so_far)
    previous_day = F.lag(F.when(completed, F.col("ordered_on"))).over(episode)
    return (islands
            .withColumn("episode_id", F.when(completed, first_completed))
            .withColumn("episode_purchase_index",
                        F.when(completed, F.sum(F.when(completed, 1).otherwise(0)).over(so_far)))
            .withColumn("gap_days", F.when(completed, F.datediff("ordered_on", previous_day)))
            .withColumn("previous_quantity", F.when(completed, F.lag("quantity").over(episode)))
            .withColumn("first_of_pair", completed & (F.col("pair_purchases") == 1)))


def with_episodes(events: DataFrame, digests: bool = False) -> DataFrame:
    """All events, audit rows included, with episode id and purchase index."""
    seq = sequence(events, digests).select(*events.columns, "episode_id", "episode_purchase_index")
    audit = (events.filter(~F.col("event_state").isin("completed", "held"))
             .withColumn("episode_id", F.lit(None).cast("string"))
             .withColumn("episode_purchase_index", F.lit(None).cast("bigint")))
    return seq.unionByName(audit)


def label_columns() -> dict[str, Column]:
    """Next-purchase label of a completed event of `sequence`.

    Observed when the next active event is completed, blocked when it is a hold, censored when there is none.
    """
    nxt = F.col("next_event")
    observed = nxt.event_state == "completed"
    return {
        "label_state": F.when(nxt.isNull(), "right_censored").when(observed, "observed").otherwise("blocked_by_hold"),
        "target_event_id": F.when(observed, nxt.event_id), "target_on": F.when(observed, nxt.ordered_on),
        "target_quantity": F.when(observed, nxt.quantity),
        "target_gap_days": F.when(observed, F.datediff(nxt.ordered_on, F.col("ordered_on"))),
        "blocking_event_id": F.when(~observed, nxt.event_id), "blocking_on": F.when(~observed, nxt.ordered_on),
        "label_snapshot_observed_at": F.when(observed, F.greatest("snapshot_observed_at", nxt.snapshot_observed_at))}


def labels_from(seq: DataFrame) -> DataFrame:
    """One label row per completed event."""
    return seq.filter("event_state = 'completed'").select(
        F.col("event_id").alias("origin_event_id"), *PAIR, F.col("ordered_on").alias("origin_on"), "episode_id",
        *[column.alias(name) for name, column in label_columns().items()])


def next_purchase_labels(events: DataFrame, digests: bool = False) -> DataFrame:
    return labels_from(sequence(events, digests))


def event_summary(events: DataFrame) -> DataFrame:
    """Events and pairs by state."""
    return events.groupBy("event_state").agg(F.count("*").alias("events"), F.sum("quantity").alias("quantity"),
                                             F.min("ordered_on").alias("first_day"), F.max("ordered_on").alias("last_day"))


def series_summary(events: DataFrame) -> DataFrame:
    """Number of pair series, and of series with a single completed event."""
    per_pair = events.groupBy(*PAIR).agg(count_if(F.col("event_state") == "completed").alias("completed"))
    return per_pair.agg(F.count("*").alias("series"), count_if(F.col("completed") == 1).alias("single_event_series"))


def lineage(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Label -> target event -> contributing source rows, one row per contributing source row.

    Rows stay flat: an event with very many source rows is never collected into one value. Labels and rows meet by pair and
    day; the identifiers, digests of these, are made again instead of being sent along.
    """
    observed = labels.filter("label_state = 'observed'").select(
        *[F.col(c).alias(f"_{c}") for c in PAIR], F.col("origin_on").alias("_origin_on"), F.col("target_on").alias("_target_on"), "target_quantity")
    contributing = links.filter("event_quantity_contribution > 0").select(
        *PAIR, F.col("ordered_on").alias("target_on"), "order_id", "order_section_item_no", "section_status", "event_quantity_contribution")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*PAIR, "target_on")])
    pair = [F.col(c) for c in PAIR]
    return contributing.join(observed, same).select(
        list_key(*pair, F.col("target_on")).alias("target_event_id"), list_key(*pair, F.col("_origin_on")).alias("origin_event_id"),
        "target_on", "target_quantity", "order_id", "order_section_item_no", "section_status", "event_quantity_contribution")
