"""Queries of release dates, corrections and the daily schedule."""
from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from rebuyflow.catalog.cadence import CLASSED_SQL, ROUTES_SQL, SPEED_SQL
from rebuyflow.catalog.common import DAYS_SQL, Catalog, rounded
from rebuyflow.catalog.evaluation import SCORED_SQL, forecasts, grid, release_sql, stored_scored
from rebuyflow.catalog.events import EVENTS_SQL, item_events, stored_events
from rebuyflow.catalog.features import HISTORY_SQL, HORIZON, LAST_DAY, hist
from rebuyflow.catalog.policy import customer_exclusions, product_exclusions
from rebuyflow.config import RouterConfig, ScheduleConfig
from rebuyflow.functions import calendar
from rebuyflow.functions.scalars import ab_bucket, ab_group, list_key
from rebuyflow.operators import baseline, cadence, events, features, feedback, reports, schedule
from rebuyflow.plans.daily import DailyInputs, run_daily
from rebuyflow.plans.stages import new_folder, stage
from rebuyflow.sources import driver_tables as tables
from rebuyflow.sources.readers import one_rhythm_per_pair
from rebuyflow.sources.sinks import merge_published, publishable

catalog = Catalog()

AS_OF, EARLIER = "2024-01-31T06:00:00", "2024-01-22T06:00:00"
ROUTER = RouterConfig(weekly_buyer_max_gap_days=3, monitoring_days=6)
PRODUCTION = ScheduleConfig(router=ROUTER)
WEEKLY = ScheduleConfig(first_purchase="skip", second_purchase="model", schedule="weekly_monday", lead_policy="fixed",
                        adjustment_mode="median", adjustment_cap_days=7, router=ROUTER)


def as_of(text: str):
    return F.lit(text).cast("timestamp_ntz")


# Gaps of ship dates after order dates: up to months, so every branch of the calendar rules occurs.
SHIP_SQL = """
ship AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS origin_on, greatest(1, CAST(abs(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS INT) % 100) AS gap
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def ship_gaps(spark, sf):
    line, orders = tables.table(spark, sf, "lineitem"), tables.table(spark, sf, "orders")
    origin, shipped = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    return (line.join(orders, line.l_orderkey == orders.o_orderkey)
            .select(origin.alias("origin_on"), F.greatest(F.lit(1), F.abs(F.datediff(shipped, origin)) % 100).alias("gap")).distinct())


@catalog.query("weekly_release", f"""
WITH {SHIP_SQL}, r AS (SELECT origin_on, gap, {release_sql('gap', 7)} AS cart_at FROM ship)
SELECT origin_on, gap, CAST(strftime(cart_at, '%Y-%m-%d %H:%M') AS VARCHAR) AS cart_at, CAST(CASE WHEN isodow(cart_at) = 7 THEN CAST(cart_at AS DATE) + 1 ELSE CAST(cart_at AS DATE) END AS DATE) AS order_day FROM r""")
def weekly_release(spark, sf):
    """Weekly cart time and ordering day over real date pairs."""
    rows = ship_gaps(spark, sf).withColumn("cart", calendar.weekly_cart(F.col("origin_on"), F.col("gap"), 22, 7))
    return rows.select("origin_on", "gap", F.date_format("cart", "yyyy-MM-dd HH:mm").alias("cart_at"), calendar.order_day(F.col("cart")).alias("order_day"))


@catalog.query("days_before", f"WITH {SHIP_SQL} SELECT origin_on, gap, CAST(greatest(origin_on + 1, origin_on + gap - 7) AS DATE) AS cart_on, strftime(to_utc, '%Y-%m-%d %H:%M') AS cart_utc FROM (SELECT *, greatest(origin_on + 1, origin_on + gap - 7) + INTERVAL 0 HOURS AS to_utc FROM ship)")
def days_before(spark, sf):
    """Notification seven days before the prediction (09:00 local is midnight UTC)."""
    rows = ship_gaps(spark, sf).withColumn("cart_on", calendar.days_before(F.col("origin_on"), F.col("gap")))
    utc = calendar.to_utc(calendar.at_hour(F.col("cart_on"), 9))
    return rows.select("origin_on", "gap", "cart_on", F.date_format(utc, "yyyy-MM-dd HH:mm").alias("cart_utc"))


@catalog.query("extra_lead", f"WITH {SHIP_SQL} SELECT gap, COUNT(*) AS n, CAST(least(14, greatest(7, round_even(gap * 0.3::DOUBLE, 0))) - 7 AS BIGINT) AS extra_lead FROM ship GROUP BY gap")
def extra_lead(spark, sf):
    """Proportional lead beyond a week."""
    return ship_gaps(spark, sf).groupBy("gap").agg(F.count("*").alias("n")).withColumn("extra_lead", calendar.extra_lead(F.col("gap")))


@catalog.query("clipped_leads", f"WITH {SHIP_SQL} SELECT origin_on, gap, CAST(greatest(origin_on + gap - 10, origin_on + 1) AS DATE) AS cart_on FROM ship")
def clipped_leads(spark, sf):
    """Ten-day lead kept after availability."""
    rows = ship_gaps(spark, sf)
    return rows.select("origin_on", "gap", calendar.clipped_lead(F.date_add("origin_on", F.col("gap")), F.date_add("origin_on", 1), F.lit(10)).alias("cart_on"))


PULL_SQL = f"""{SHIP_SQL},
w AS (SELECT origin_on, gap, {release_sql('gap', 7)} AS cart_at FROM ship),
x AS (SELECT *, CASE WHEN isodow(cart_at) = 7 THEN CAST(cart_at AS DATE) + 1 ELSE CAST(cart_at AS DATE) END AS planned, origin_on + CAST(gap // 2 AS INT) AS rhythm FROM w),
y AS (SELECT *, greatest(rhythm, planned - 7) AS target FROM x),
z AS (SELECT *, greatest((target - CAST(CASE WHEN isodow(target) = 7 THEN 7 ELSE isodow(target) END AS INT)) + INTERVAL 22 HOURS, (origin_on + 1) + INTERVAL 0 HOURS) AS release FROM y),
q AS (SELECT *, rhythm < planned AND release < cart_at AS pulled FROM z)"""


@catalog.query("pull_forward", f"""
WITH {PULL_SQL} SELECT origin_on, gap, pulled, strftime(CASE WHEN pulled THEN release ELSE cart_at END, '%Y-%m-%d %H:%M') AS cart_at,
CAST(CASE WHEN NOT pulled THEN planned WHEN isodow(release) = 7 THEN CAST(release AS DATE) + 1 ELSE CAST(release AS DATE) END AS DATE) AS cart_on FROM q""")
def pull_forward(spark, sf):
    """Earlier carts when a rhythm forecast (half the gap) is earlier than plan."""
    rows = ship_gaps(spark, sf).withColumn("cart", calendar.weekly_cart(F.col("origin_on"), F.col("gap"), 22, 7))
    pulled = calendar.pull_forward(calendar.order_day(F.col("cart")), F.col("cart"), F.date_add("origin_on", F.floor(F.col("gap") / 2).cast("int")),
                                   calendar.next_midnight(F.col("origin_on")), 22)
    return (rows.withColumn("p", pulled).select("origin_on", "gap", F.col("p.pulled").alias("pulled"), F.date_format("p.cart_at", "yyyy-MM-dd HH:mm").alias("cart_at"),
                                                F.col("p.cart_on").alias("cart_on")))


@catalog.query("ab_groups", """
SELECT customer_id, CAST(bucket AS INT) AS bucket, CASE WHEN bucket < 5 THEN 'holdout' WHEN bucket < 50 THEN 'control' ELSE 'treatment' END AS ab_group FROM (
 SELECT CAST(c_custkey AS VARCHAR) AS customer_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(CAST(c_custkey AS VARCHAR)), ''), lambda h: (strpos('0123456789abcdef', h) - 1)::BIGINT)), lambda a, h: (a * 16 + h) % 100) AS bucket FROM customer)""")
def ab_groups(spark, sf):
    """Assignment bucket and group of every customer."""
    key = F.col("c_custkey").cast("string")
    return tables.table(spark, sf, "customer").select(key.alias("customer_id"), ab_bucket(key).alias("bucket"), ab_group(key).alias("ab_group"))


@catalog.query("suggestion_keys", f"""
WITH {HISTORY_SQL} SELECT origin_event_id, sha256('["' || customer_id || '", "' || product_id || '", "' || origin_event_id || '"]') AS suggestion_key FROM labels""")
def suggestion_keys(spark, sf):
    """Stable key per customer, product and origin."""
    rows = events.next_purchase_labels(tables.daily_events(spark, sf))
    return rows.select("origin_event_id", list_key(F.col("customer_id"), F.col("product_id"), F.col("origin_event_id")).alias("suggestion_key"))


# --- feedback -----------------------------------------------------------------------------------------------------

def memory(rows):
    """Error memory of observed predictions; the alarm is the weekly cart."""
    cart = calendar.weekly_cart(F.col("origin_on"), F.col("predicted_gap_days"), 22, 3)
    return feedback.pair_errors(rows.filter("outcome = 'observed'").withColumn("cart_on", calendar.order_day(cart)))


def combined_memory(spark, sf):
    return memory_of(stored_scored(spark, sf))


def memory_of(rows):
    """Memory of the recent-three rule in both folds, then fold b replaced by the pair-median rule."""
    fresh = rows.filter("fold = 'b' AND candidate = 'pair_median_qlast'")
    return feedback.upsert(memory(rows.filter("candidate = 'recent3_gap_qlast'")), memory(fresh))


MEMORY_SQL = SCORED_SQL + f""",
mem AS (SELECT origin_event_id, customer_id, product_id, origin_on, gap AS predicted_gap, CAST(tg AS BIGINT) AS actual_gap, CAST(tg - gap AS BIGINT) AS error_days,
         CAST(CASE WHEN isodow(cart_at) = 7 THEN CAST(cart_at AS DATE) + 1 ELSE CAST(cart_at AS DATE) END - origin_on AS BIGINT) AS alarm_gap
        FROM (SELECT *, {release_sql('gap')} AS cart_at FROM scored WHERE outcome = 'observed'
              AND ((fold = 'a' AND candidate = 'recent3_gap_qlast') OR (fold = 'b' AND candidate = 'pair_median_qlast'))))"""
RATCHET_SQL = "SELECT customer_id, product_id, -least(21, SUM(CASE WHEN actual_gap < alarm_gap THEN alarm_gap - actual_gap + 1 ELSE 0 END))::BIGINT AS adjustment_days FROM mem GROUP BY 1, 2"
MEDIAN_SQL = "SELECT customer_id, product_id, trunc(greatest(-7, least(0, MEDIAN(error_days))))::BIGINT AS adjustment_days FROM mem GROUP BY 1, 2"


@catalog.query("memory_upsert", f"WITH {MEMORY_SQL} SELECT * FROM mem")
def memory_upsert(spark, sf):
    """Error memory after replacing fold b by another candidate's rows."""
    return combined_memory(spark, sf)


@catalog.query("pair_median_adjustment", f"WITH {MEMORY_SQL} SELECT * FROM ({MEDIAN_SQL}) WHERE adjustment_days <> 0")
def pair_median_adjustment(spark, sf):
    """Median correction per pair."""
    return feedback.adjustments(combined_memory(spark, sf), "median", 7)


@catalog.query("pair_ratchet", f"WITH {MEMORY_SQL} SELECT * FROM ({RATCHET_SQL}) WHERE adjustment_days <> 0")
def pair_ratchet(spark, sf):
    """Ratchet correction per pair."""
    return feedback.adjustments(combined_memory(spark, sf), "ratchet", 21)


@catalog.query("pair_ratchet_before", f"WITH {MEMORY_SQL}, m2 AS (SELECT * FROM mem WHERE origin_on < DATE '2024-01-20') SELECT * FROM ({RATCHET_SQL.replace('FROM mem', 'FROM m2')}) WHERE adjustment_days <> 0")
def pair_ratchet_before(spark, sf):
    """Ratchet correction as it stood before a day."""
    return feedback.adjustments(combined_memory(spark, sf), "ratchet", 21, date(2024, 1, 20))


@catalog.query("memory_stats", f"WITH {MEMORY_SQL} SELECT (SELECT COUNT(*) FROM mem) AS errors, COUNT(*) AS pairs, COUNT(*) FILTER (adjustment_days <> 0) AS adjusted_pairs FROM ({RATCHET_SQL})")
def memory_stats(spark, sf):
    """Size of the memory and number of corrected pairs."""
    return feedback.memory_stats(combined_memory(spark, sf))


# --- schedule -----------------------------------------------------------------------------------------------------

def stored_history(day_events):
    """History of events whose identifiers are digests, stored by day."""
    return stage(features.history(events.sequence(events.by_day(day_events))), "history")


def open_rows(table, when):
    """Open origins with route, item speed and baseline forecast fitted on all observed labels; `table` is a stored history.

    Only open origins (one per pair at most) meet the product facts.
    """
    rows = events.named(cadence.with_routes(cadence.pair_profile(features.pair_features(table)), ROUTER)).withColumn("fold", F.lit("all"))
    model = baseline.fit_baseline(features.pair_features(table).filter("label_state = 'observed'").withColumn("fold", F.lit("all")))
    speed = cadence.item_speed(events.named(table)).select("product_id", "origin_on", "item_gap_median")  # intervals of a day rank by identifier
    waiting = schedule.open_origins(rows, when).join(speed, ["product_id", "origin_on"])
    none = F.lit(None)
    return (baseline.predict_baseline(waiting, model)
            .withColumn("champion_gap_days", F.col("predicted_gap_days")).withColumn("champion_quantity", F.col("qty_last"))
            .withColumns({"agent_gap_days": none.cast("bigint"), "agent_quantity": none.cast("bigint"), "relative_iqr": none.cast("double")})
            .drop("predicted_gap_days"))


def stored_memory(table):
    """Error memory from the same stored history the schedule reads."""
    wanted = F.col("candidate").isin("recent3_gap_qlast", "pair_median_qlast")
    return memory_of(stage(grid(forecasts(events.named(features.pair_features(table)))).filter(wanted), "scored"))


def rhythm(spark, sf):
    """External forecast per pair: two days after its last event, none for errors."""
    rows = (tables.daily_events(spark, sf).groupBy("customer_id", "product_id")
            .agg(F.max("ordered_on").alias("last_on"), F.max("quantity").alias("cart_quantity")))
    return one_rhythm_per_pair(rows.select("customer_id", "product_id", F.when(F.col("product_id") != "error", F.date_add("last_on", 2)).alias("cart_on"), "cart_quantity"))


def production_schedule(spark, sf):
    table = stored_history(tables.daily_events(spark, sf))
    return schedule.build_schedule(open_rows(table, as_of(AS_OF)), as_of(AS_OF), PRODUCTION, feedback.adjustments(stored_memory(table)))


def weekly_schedule(spark, sf):
    table = stored_history(tables.daily_events(spark, sf))
    moves = feedback.adjustments(stored_memory(table), "median", 7)
    return schedule.build_schedule(open_rows(table, as_of(AS_OF)), as_of(AS_OF), WEEKLY, moves, rhythm(spark, sf))


def earlier_schedule(spark, sf):
    """Production schedule from the events before 22 January, without corrections."""
    table = stored_history(tables.daily_events(spark, sf).filter("ordered_on <= DATE '2024-01-21'"))
    return schedule.build_schedule(open_rows(table, as_of(EARLIER)), as_of(EARLIER), PRODUCTION)


# The tail of a query after a shared prefix; all use the same base definitions.
ENRICHED_SQL = ROUTES_SQL + SPEED_SQL[len(HISTORY_SQL):] + """,
am AS (SELECT product_id, MEDIAN(target_gap_days) AS gm, COUNT(*) AS n FROM origins WHERE label_state = 'observed' GROUP BY 1),
ag AS (SELECT MEDIAN(target_gap_days) AS gg FROM origins WHERE label_state = 'observed'),
open_rows AS (
  SELECT o.origin_event_id, o.customer_id, o.product_id, o.origin_on, qty_last, item_gap_median, gaps6[-1] AS lag1, COALESCE(len(gaps6), 0) + 1 AS purchases, walk.current AS grp,
         round(len(list_filter(walk.last3, lambda g: g = walk.current)) / len(walk.last3), 3) AS route_confidence, walk.changed AS route_changed,
         CAST(greatest(1, floor(CASE WHEN gap_count > 0 THEN gap_median_days ELSE COALESCE(CASE WHEN am.n >= 5 THEN am.gm END, (SELECT gg FROM ag)) END + 0.5)) AS BIGINT) AS cgap
  FROM origins o JOIN walk USING (origin_event_id) JOIN speed s ON s.product_id = o.product_id AND s.origin_on = o.origin_on LEFT JOIN am ON am.product_id = o.product_id
  WHERE label_state = 'right_censored'),
staged AS (SELECT *, CASE WHEN purchases = 1 THEN 'first' WHEN purchases = 2 THEN 'second' WHEN grp = 'insufficient' THEN 'third_fourth' ELSE 'cadence' END AS purchase_stage FROM open_rows)"""

PRODUCTION_SQL = """,
gapped AS (SELECT *, CAST(CASE WHEN purchases = 1 AND item_gap_median IS NOT NULL THEN greatest(1, round_even(item_gap_median, 0)) WHEN purchases = 2 THEN greatest(1, lag1) ELSE cgap END AS BIGINT) AS gap,
  CASE WHEN purchases = 1 AND item_gap_median IS NOT NULL THEN 'first_purchase_item_median' WHEN purchases = 1 THEN 'first_purchase_model_fallback' WHEN purchases = 2 THEN 'second_purchase_last_gap' ELSE 'champion' END AS agent FROM staged),
led AS (SELECT gapped.*, COALESCE(adj.adjustment_days, 0) AS adj, CAST(least(14, greatest(7, round_even(gap * 0.3::DOUBLE, 0))) - 7 AS BIGINT) AS extra FROM gapped LEFT JOIN adj USING (customer_id, product_id)),
sch AS (SELECT *, greatest(1, gap + adj - extra) AS sgap, greatest(origin_on + 1, origin_on + CAST(greatest(1, gap + adj - extra) AS INT) - 7) AS cart_on, origin_on + CAST(greatest(6, gap + 7) AS INT) AS monitor_until FROM led),
schedule AS (SELECT sha256('["' || customer_id || '", "' || product_id || '", "' || origin_event_id || '"]') AS suggestion_key, customer_id, product_id, origin_event_id, origin_on, grp AS customer_group, purchase_stage,
  agent AS selected_agent, CASE WHEN purchases > 2 THEN 'champion' END AS fallback_agent, gap AS predicted_gap_days, CAST(origin_on + CAST(gap AS INT) AS DATE) AS predicted_repurchase_on, adj AS pair_adjustment_days, 7 + extra AS lead_days,
  sgap AS scheduled_gap_days, qty_last AS cart_quantity, CAST(cart_on AS DATE) AS cart_on, CAST(monitor_until AS DATE) AS monitor_until,
  CASE WHEN {asof}::DATE > monitor_until THEN 'closed' WHEN cart_on + INTERVAL 9 HOURS <= {asof} THEN 'due' ELSE 'scheduled' END AS status, route_confidence, route_changed,
  CASE WHEN purchases > 2 THEN 'routed_to_champion' ELSE grp || '_pair' END AS reason FROM sch)"""

SCHEDULE_COLUMNS = ["suggestion_key", "customer_id", "product_id", "origin_event_id", "origin_on", "customer_group", "purchase_stage", "selected_agent", "fallback_agent",
                    "predicted_gap_days", "predicted_repurchase_on", "pair_adjustment_days", "lead_days", "scheduled_gap_days", "cart_quantity", "cart_on",
                    "monitor_until", "status", "route_confidence", "route_changed", "reason"]
FULL_SQL = ENRICHED_SQL + MEMORY_SQL[len(HISTORY_SQL):] + f", adj AS (SELECT * FROM ({RATCHET_SQL}))" + PRODUCTION_SQL.format(asof="TIMESTAMP '2024-01-31 06:00:00'")
EARLIER_SQL = (ENRICHED_SQL.replace("FROM events GROUP BY", "FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-21' GROUP BY")
               + ", adj AS (SELECT '' AS customer_id, '' AS product_id, 0::BIGINT AS adjustment_days)" + PRODUCTION_SQL.format(asof="TIMESTAMP '2024-01-22 06:00:00'"))


@catalog.query("schedule", f"WITH {FULL_SQL} SELECT {', '.join(SCHEDULE_COLUMNS)} FROM schedule")
def schedule_query(spark, sf):
    """Daily schedule under the production profile."""
    return production_schedule(spark, sf).select(*SCHEDULE_COLUMNS)


WEEKLY_SQL = ENRICHED_SQL + MEMORY_SQL[len(HISTORY_SQL):] + f""",
adj AS (SELECT * FROM ({MEDIAN_SQL})),
rh AS (SELECT customer_id, product_id, MAX(ordered_on) + 2 AS rhythm, MAX(quantity) AS rq FROM days WHERE product_id <> 'error' GROUP BY 1, 2),
g1 AS (SELECT staged.*, cgap AS gap, purchases > 1 AS suggest, CASE WHEN purchases > 1 THEN COALESCE(adjustment_days, 0) ELSE 0 END AS adj FROM staged LEFT JOIN adj USING (customer_id, product_id)),
g2 AS (SELECT g1.*, greatest(1, gap + adj) AS sgap, rhythm, rq FROM g1 LEFT JOIN rh USING (customer_id, product_id)),
g3 AS (SELECT *, {release_sql('sgap')} AS wcart FROM g2),
g4 AS (SELECT *, CASE WHEN isodow(wcart) = 7 THEN CAST(wcart AS DATE) + 1 ELSE CAST(wcart AS DATE) END AS planned FROM g3),
g5 AS (SELECT *, greatest(rhythm, planned - 7) AS target FROM g4),
g6 AS (SELECT *, greatest((target - CAST(CASE WHEN isodow(target) = 7 THEN 7 ELSE isodow(target) END AS INT)) + INTERVAL 22 HOURS, (origin_on + 1) + INTERVAL 0 HOURS) AS release FROM g5),
g7 AS (SELECT *, COALESCE(suggest AND rhythm IS NOT NULL AND rhythm < planned AND release < wcart, FALSE) AS pulled FROM g6),
g8 AS (SELECT *, CASE WHEN pulled THEN release ELSE wcart END AS cart_at, origin_on + CAST(greatest(6, gap + 7) AS INT) AS monitor_until FROM g7),
schedule AS (SELECT origin_event_id, purchase_stage, gap AS predicted_gap_days, adj AS pair_adjustment_days, sgap AS scheduled_gap_days, pulled AS store_rhythm_pulled, COALESCE(nullif(rq, 0), qty_last) AS cart_quantity,
  strftime(cart_at, '%Y-%m-%d %H:%M') AS cart_at, CAST(CASE WHEN isodow(cart_at) = 7 THEN CAST(cart_at AS DATE) + 1 ELSE CAST(cart_at AS DATE) END AS DATE) AS cart_on,
  CASE WHEN NOT suggest THEN 'no_suggestion_first_purchase' WHEN DATE '2024-01-31' > monitor_until THEN 'closed' WHEN cart_at <= TIMESTAMP '2024-01-31 06:00:00' THEN 'due' ELSE 'scheduled' END AS status FROM g8)"""


@catalog.query("schedule_weekly", f"WITH {WEEKLY_SQL} SELECT * FROM schedule")
def schedule_weekly(spark, sf):
    """Weekly Monday schedule with median correction and external rhythm; first purchases skipped."""
    return weekly_schedule(spark, sf).select("origin_event_id", "purchase_stage", "predicted_gap_days", "pair_adjustment_days", "scheduled_gap_days", "store_rhythm_pulled",
                                             "cart_quantity", F.date_format("cart_at", "yyyy-MM-dd HH:mm").alias("cart_at"), "cart_on", "status")


@catalog.query("schedule_summary", f"""
WITH {WEEKLY_SQL} SELECT status, COUNT(*) AS rows, COUNT(*) FILTER (store_rhythm_pulled) AS carts_pulled, COUNT(*) FILTER (pair_adjustment_days <> 0) AS carts_adjusted, CAST(SUM(cart_quantity) AS BIGINT) AS cart_quantity FROM schedule GROUP BY 1""")
def schedule_summary(spark, sf):
    """Weekly schedule by status."""
    return reports.schedule_summary(weekly_schedule(spark, sf))


@catalog.query("open_by_agent", f"WITH {FULL_SQL} SELECT COALESCE(fallback_agent, selected_agent) AS agent, COUNT(*) AS rows FROM schedule WHERE status IN ('due', 'scheduled') GROUP BY 1")
def open_by_agent(spark, sf):
    """Open suggestions by final agent."""
    return reports.open_by_agent(production_schedule(spark, sf))


@catalog.query("outcome_feedback", f"""
WITH {EARLIER_SQL}, real AS (SELECT event_id, LEAD(event_state) OVER w AS ns, CAST(LEAD(ordered_on) OVER w - ordered_on AS BIGINT) AS tg
  FROM (SELECT sha256('["' || user_id || '", "' || event_type || '", "' || d || '"]') AS event_id, user_id, event_type, d AS ordered_on, CASE WHEN MAX(value) > 250 THEN 'held' ELSE 'completed' END AS event_state
        FROM (SELECT *, CAST(ts AS DATE) AS d FROM events) GROUP BY user_id, event_type, d) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ordered_on))
SELECT origin_event_id, customer_id, product_id, origin_on, predicted_gap_days AS predicted_gap, tg AS actual_gap, CAST(tg - predicted_gap_days AS BIGINT) AS error_days, CAST(cart_on - origin_on AS BIGINT) AS alarm_gap
FROM schedule JOIN real ON origin_event_id = event_id WHERE ns = 'completed' AND status IN ('due', 'scheduled')""")
def outcome_feedback(spark, sf):
    """Errors of an earlier schedule against labels observed since."""
    labels = events.next_purchase_labels(tables.daily_events(spark, sf))
    return feedback.pair_errors(feedback.outcomes(earlier_schedule(spark, sf), labels))


@catalog.query("publish_merge", f"""
WITH {FULL_SQL}, o AS (SELECT suggestion_key, status, cart_quantity FROM ({'{earlier}'}) WHERE status <> 'closed'), n AS (SELECT suggestion_key, status, cart_quantity FROM schedule WHERE status <> 'closed')
SELECT * FROM n UNION ALL SELECT * FROM o WHERE suggestion_key NOT IN (SELECT suggestion_key FROM n)""".replace("{earlier}", f"WITH {EARLIER_SQL} SELECT suggestion_key, status, cart_quantity FROM schedule"))
def publish_merge(spark, sf):
    """Published table after two runs: the later run replaces equal keys."""
    return (merge_published(publishable(earlier_schedule(spark, sf)), publishable(production_schedule(spark, sf)))
            .select("suggestion_key", "status", "cart_quantity"))


# --- routing of specialists ---------------------------------------------------------------------------------------

def routed(spark, sf):
    """Fold predictions routed to a recent-three agent for stable and irregular pairs, guarded against the baseline."""
    origins = stage(features.pair_features(hist(spark, sf)), "origins")
    rows = cadence.with_routes(cadence.pair_profile(origins), ROUTER)
    joined = (forecasts(origins, rows).withColumn("item_gap_median", F.lit(None).cast("double"))
              .withColumn("champion_gap_days", F.col("predicted_gap_days")).withColumn("champion_quantity", F.col("qty_last")))
    served = F.col("route_group").isin("stable", "irregular")
    agent = F.when(served & F.col("recent3_gap").isNotNull(), F.greatest(F.lit(1), F.floor(F.col("recent3_gap") + 0.5)).cast("bigint"))
    joined = joined.withColumn("agent_gap_days", agent).withColumn("agent_quantity", F.col("qty_last")).withColumn("relative_iqr", F.when(served, F.col("pair_cv")))
    cfg = ScheduleConfig(first_purchase="skip", second_purchase="model", router=RouterConfig(max_relative_iqr=0.6, late_guard=True, second_purchase_last_gap=True))
    return schedule.choose_gap(joined.drop("predicted_gap_days"), cfg, {"stable": "recent_agent", "irregular": "recent_agent"})


ROUTED_SQL = ROUTES_SQL + SCORED_SQL[len(HISTORY_SQL):] + """,
rt AS (SELECT pred.*, walk.current AS grp, walk.changed, CASE WHEN walk.current IN ('stable', 'irregular') AND pred.recent3_gap IS NOT NULL THEN CAST(greatest(1, floor(pred.recent3_gap + 0.5)) AS BIGINT) END AS agap,
  CASE WHEN walk.current IN ('stable', 'irregular') THEN sqrt(len(pred.gaps6) * list_sum(list_transform(pred.gaps6, lambda x: x * x)) - pow(list_sum(pred.gaps6), 2)) / list_sum(pred.gaps6) END AS iqr,
  COALESCE(len(pred.gaps6), 0) + 1 AS purchases FROM pred JOIN walk USING (origin_event_id)),
rr AS (SELECT *, CASE WHEN purchases = 2 THEN NULL WHEN agap IS NULL THEN CASE WHEN grp IN ('stable', 'irregular') THEN 'specialist_unavailable' ELSE 'routed_to_champion' END
  WHEN iqr > 0.6 THEN 'high_uncertainty' WHEN agap > base_gap THEN 'later_than_champion' END AS reason FROM rt),
rz AS (SELECT *, CASE WHEN purchases = 2 THEN greatest(1, gaps6[-1]) WHEN reason IS NULL THEN agap ELSE base_gap END AS gap FROM rr)"""


@catalog.query("guarded_gaps", f"""
WITH {ROUTED_SQL} SELECT fold, origin_event_id, CAST(gap AS BIGINT) AS predicted_gap_days, reason AS fallback_reason,
CASE WHEN purchases = 1 THEN 'first' WHEN purchases = 2 THEN 'second' WHEN grp = 'insufficient' THEN 'third_fourth' ELSE 'cadence' END AS purchase_stage, purchases > 1 AS suggest FROM rz""")
def guarded_gaps(spark, sf):
    """Routed gap with guard, stage rule and fallback reason."""
    return routed(spark, sf).select("fold", "origin_event_id", "predicted_gap_days", "fallback_reason", "purchase_stage", "suggest")


@catalog.query("routing_report", f"""
WITH {ROUTED_SQL}, l AS (SELECT *, CASE WHEN outcome = 'observed' THEN (target_on < CAST({release_sql('gap')} AS DATE))::INT END AS late FROM rz)
SELECT grp AS customer_group, COUNT(*) AS records, COUNT(reason) AS fallbacks, round(COUNT(reason) / COUNT(*), 6) AS fallback_rate, COUNT(*) FILTER (reason = 'high_uncertainty') AS high_uncertainty,
COUNT(*) FILTER (reason = 'later_than_champion') AS later_fallbacks, round(AVG((agap > base_gap)::INT), 6) AS later_than_champion_rate, COUNT(*) FILTER (changed) AS route_changed,
round(AVG(late) FILTER (changed), 6) AS late_rate_route_changed, round(AVG(late) FILTER (NOT changed), 6) AS late_rate_route_kept FROM l GROUP BY ROLLUP (grp)""")
def routing_report(spark, sf):
    """Fallbacks, later agents and route changes per class and overall."""
    rows = routed(spark, sf).withColumn("outcome", features.horizon_outcome(LAST_DAY, HORIZON)).withColumn("reason", F.col("fallback_reason"))
    return rounded(reports.routing_report(rows.withColumn("cart_at", calendar.weekly_cart(F.col("origin_on"), F.col("predicted_gap_days"), 22, 3))))


@catalog.query("routing_counts", f"""
WITH {ROUTED_SQL}, k AS (SELECT grp, reason, (SELECT raw FROM walk WHERE walk.origin_event_id = rz.origin_event_id) AS raw,
  CASE WHEN reason IS NOT NULL THEN 'champion' WHEN purchases = 2 THEN 'second_purchase_last_gap' WHEN grp IN ('stable', 'irregular') THEN 'recent_agent' ELSE 'champion' END AS final FROM rz)
SELECT 'class' AS kind, grp AS value, COUNT(*) AS rows FROM k GROUP BY 2 UNION ALL SELECT 'raw_class', raw, COUNT(*) FROM k GROUP BY 2
UNION ALL SELECT 'final_agent', final, COUNT(*) FROM k GROUP BY 2 UNION ALL SELECT 'fallback_reason', grp || ':' || reason, COUNT(*) FROM k WHERE reason IS NOT NULL GROUP BY 2""")
def routing_counts(spark, sf):
    """Classes, final agents and fallback reasons of the routed fold predictions."""
    return reports.routing_counts(routed(spark, sf).withColumn("reason", F.col("fallback_reason")))


@catalog.query("hysteresis_summary", f"""
WITH {ROUTES_SQL} SELECT COUNT(*) AS origins, COUNT(*) FILTER (changed) AS switches, COUNT(*) FILTER (raw <> current) AS held_back FROM walk""")
def hysteresis_summary(spark, sf):
    """Route switches over all origins."""
    return reports.hysteresis_summary(cadence.with_routes(cadence.pair_profile(features.pair_features(hist(spark, sf))), ROUTER))


@catalog.query("open_origins", f"WITH {CLASSED_SQL} SELECT origin_event_id, origin_on FROM labels WHERE label_state = 'right_censored' AND origin_on + 1 <= DATE '2024-01-28'")
def open_origins(spark, sf):
    """Open origins whose purchase day is complete."""
    labels = events.next_purchase_labels(tables.daily_events(spark, sf))
    return schedule.open_origins(labels, as_of("2024-01-28T06:00:00")).select("origin_event_id", "origin_on")


BATCH_AS_OF = "2002-01-01T06:00:00"
BATCH_DAYS_SQL = EVENTS_SQL + """,
days AS (SELECT event_id, customer_id, product_id, ordered_on, event_state, quantity, source_rows, seen AS snapshot_observed_at FROM ev)"""
BATCH_SQL = FULL_SQL.replace(DAYS_SQL, BATCH_DAYS_SQL).replace("2024-01-31", "2002-01-01")


@catalog.query("daily_batch", f"WITH {BATCH_SQL} SELECT {', '.join(SCHEDULE_COLUMNS)} FROM schedule")
def daily_batch(spark, sf):
    """The daily batch from order items: policy, daily events, features, routing, forecast, corrections and schedule."""
    table = stored_history(stored_events(item_events(spark, sf)))
    return schedule.build_schedule(open_rows(table, as_of(BATCH_AS_OF)), as_of(BATCH_AS_OF), PRODUCTION, feedback.adjustments(stored_memory(table))).select(*SCHEDULE_COLUMNS)


# The same without an error memory: a first run has none.
FIRST_RUN_SQL = (ENRICHED_SQL + ", adj AS (SELECT '' AS customer_id, '' AS product_id, 0::BIGINT AS adjustment_days)" + PRODUCTION_SQL.format(asof="TIMESTAMP '2024-01-31 06:00:00'")).replace(
    DAYS_SQL, BATCH_DAYS_SQL).replace("2024-01-31", "2002-01-01")


@catalog.query("daily_run", f"WITH {FIRST_RUN_SQL} SELECT {', '.join(SCHEDULE_COLUMNS)} FROM schedule")
def daily_run(spark, sf):
    """The batch as it runs, from nested order versions: extraction, gates, quarantine, policy, reconciled events, forecast, schedule; each stage written."""
    inputs = DailyInputs(tables.whole_orders(spark, sf), product_exclusions=product_exclusions(spark, sf), product_list_version="product-exclusions-v2",
                         customer_exclusions=customer_exclusions(spark, sf))
    made = run_daily(inputs, datetime.fromisoformat(BATCH_AS_OF), new_folder(spark, "daily"), PRODUCTION, history_start=date(1990, 1, 1))
    return made["schedule"].select(*SCHEDULE_COLUMNS)
