"""Queries of censored follow-up, survival curves and probability evaluation."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from rebuyflow.catalog.common import Catalog, rounded
from rebuyflow.catalog.evaluation import CART_SQL, FOLDS, SCORED_SQL, WINDOW_DAYS, predictions, stored_scored, with_cart
from rebuyflow.catalog.features import HORIZON
from rebuyflow.functions.survival import ERFC_FIT, aft_log_survival, conditional_probability
from rebuyflow.operators import events, features, survival
from rebuyflow.operators.reports import rank_by
from rebuyflow.plans.stages import stage
from rebuyflow.sources import driver_tables as tables

catalog = Catalog()

# Landmarks scaled to the seven-day horizon of the events table.
MARKS, STEP = (0, 1, 2, 3, 4, 5), 2

FOLLOW_SQL = SCORED_SQL + """,
tb AS (SELECT o.*, f.fold, f.train_end, least(f.train_end, origin_on + 7, COALESCE(blocking_on - 1, origin_on + 7)) AS stop
       FROM origins o JOIN folds f ON origin_on BETWEEN train_end - 13 AND train_end - 7),
bounds AS (SELECT * FROM (SELECT fold, origin_event_id, customer_id, COALESCE(label_state = 'observed' AND target_on <= stop, FALSE) AS event,
             CAST(CASE WHEN label_state = 'observed' AND target_on <= stop THEN target_on - origin_on ELSE greatest(0, stop - origin_on) END AS INT) AS duration FROM tb) WHERE duration > 0),
km_d AS (SELECT fold, total, CAST(d AS INT) AS day FROM (SELECT fold, COUNT(*) AS total, unnest(range(0, 8)) AS d FROM bounds GROUP BY 1)),
km_f AS (SELECT fold, day, total - (SELECT COUNT(*) FROM bounds b WHERE b.fold = km_d.fold AND b.duration < km_d.day) AS at_risk,
                (SELECT COUNT(*) FROM bounds b WHERE b.fold = km_d.fold AND b.duration = km_d.day AND b.event) AS events FROM km_d),
km AS (SELECT fold, day, at_risk, events, (SELECT product(CASE WHEN k2.at_risk > 0 AND k2.day > 0 THEN 1 - k2.events / k2.at_risk ELSE 1 END) FROM km_f k2 WHERE k2.fold = km_f.fold AND k2.day <= km_f.day) AS survival FROM km_f),
vf AS (SELECT fold, origin_event_id, customer_id, outcome, event, CAST(CASE WHEN event THEN target_on - origin_on ELSE greatest(0, stop - origin_on) END AS INT) AS duration FROM (
        SELECT *, COALESCE(label_state = 'observed' AND target_on <= stop, FALSE) AS event FROM (
         SELECT *, least(DATE '2024-01-30', origin_on + 7, COALESCE(blocking_on - 1, origin_on + 7)) AS stop FROM pred))),
lmk AS (SELECT fold, origin_event_id, customer_id, elapsed_days, CASE WHEN event AND duration <= elapsed_days + 2 THEN 1 ELSE 0 END AS event_next,
         1 - (SELECT survival FROM km WHERE km.fold = x.fold AND day = elapsed_days + 2) / (SELECT survival FROM km WHERE km.fold = x.fold AND day = elapsed_days) AS probability
        FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS elapsed_days FROM vf) x WHERE duration > elapsed_days AND (event OR duration >= elapsed_days + 2))"""


def labels(spark, sf):
    """Labels for one consumer."""
    return events.next_purchase_labels(tables.daily_events(spark, sf))


def bounds(rows, window_days=WINDOW_DAYS):
    return survival.training_bounds(rows, FOLDS, window_days, HORIZON)


def followed(rows):
    rows = features.assign_folds(rows, FOLDS)
    outcome = features.horizon_outcome(date(2024, 1, 30), HORIZON)
    return survival.with_followup(rows, F.lit(date(2024, 1, 30)), HORIZON).withColumn("outcome", outcome)


def curve(rows, window_days=WINDOW_DAYS):
    """Survival curves: a stored table of horizon + 1 rows per fold."""
    counts = survival.kaplan_meier(bounds(rows, window_days), ["fold"], HORIZON)
    return stage(counts, "curve")


def landmark_rows(spark, sf):
    rows = stage(labels(spark, sf), "labels")
    return survival.km_landmark_probability(survival.landmarks(followed(rows), MARKS, STEP), curve(rows), ["fold"], STEP)


@catalog.query("followup_bounds", f"WITH {FOLLOW_SQL} SELECT fold, origin_event_id, duration, event, CASE WHEN event THEN duration END AS upper FROM bounds")
def followup_bounds(spark, sf):
    """Censored training durations of both folds."""
    return bounds(labels(spark, sf)).select("fold", "origin_event_id", "duration", "event", "upper")


@catalog.query("kaplan_meier", f"WITH {FOLLOW_SQL} SELECT fold, day, at_risk, events, round(survival, 6) AS survival FROM km")
def kaplan_meier(spark, sf):
    """Survival curve of each fold."""
    return rounded(curve(labels(spark, sf)))


@catalog.query("median_survival", f"WITH {FOLLOW_SQL} SELECT fold, COALESCE(MIN(day) FILTER (survival <= 0.5), 8) AS median_day FROM km GROUP BY 1")
def median_survival(spark, sf):
    """First day with survival at most one half."""
    return survival.median_survival_day(curve(labels(spark, sf)), ["fold"], HORIZON)


@catalog.query("landmarks", f"WITH {FOLLOW_SQL} SELECT fold, origin_event_id, elapsed_days, event_next, round(probability, 6) AS probability FROM lmk")
def landmarks(spark, sf):
    """At-risk landmark rows with their Kaplan-Meier probability."""
    return rounded(landmark_rows(spark, sf).select("fold", "origin_event_id", "elapsed_days", "event_next", "probability"))


@catalog.query("brier_macro", f"""
WITH {FOLLOW_SQL}, o AS (SELECT fold, customer_id, origin_event_id, AVG(pow(probability - event_next, 2)) AS m FROM lmk GROUP BY 1, 2, 3),
c AS (SELECT fold, customer_id, AVG(m) AS m FROM o GROUP BY 1, 2)
SELECT fold, landmarks_n, CAST(landmark_positive_n AS BIGINT) AS landmark_positive_n, round(landmark_brier, 6) AS landmark_brier, round(macro, 6) AS landmark_customer_macro_brier, landmark_customers
FROM (SELECT fold, COUNT(*) AS landmarks_n, SUM(event_next) AS landmark_positive_n, AVG(pow(probability - event_next, 2)) AS landmark_brier FROM lmk GROUP BY 1)
JOIN (SELECT fold, AVG(m) AS macro, COUNT(*) AS landmark_customers FROM c GROUP BY 1) USING (fold)""")
def brier_macro(spark, sf):
    """Brier scores of the landmark probabilities."""
    return rounded(survival.brier_macro(landmark_rows(spark, sf), ["fold"]))


def _brier_sql(name: str, first: int) -> str:
    """Customer-macro Brier of the curve trained on origins from `train_end - first`."""
    return f"""SELECT '{name}' AS candidate, AVG(m) AS b FROM (SELECT customer_id, AVG(m) AS m FROM (
      SELECT customer_id, origin_event_id, AVG(pow(probability - event_next, 2)) AS m FROM (
        WITH {FOLLOW_SQL.replace("train_end - 13", f"train_end - {first}")} SELECT * FROM lmk) GROUP BY 1, 2) GROUP BY 1)"""


@catalog.query("brier_ranking", f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY round(b, 9), candidate) AS INT) AS rank, candidate, round(b, 6) AS landmark_customer_macro_brier
FROM ({_brier_sql("w14_km", 13)} UNION ALL {_brier_sql("w10_km", 9)})""")
def brier_ranking(spark, sf):
    """Training windows of the survival curve ranked by Brier score."""
    rows = stage(labels(spark, sf), "labels")
    marks = survival.landmarks(followed(rows), MARKS, STEP)
    scored = [survival.km_landmark_probability(marks, curve(rows, days), ["fold"], STEP).withColumn("candidate", F.lit(f"w{days}_km")) for days in (14, 10)]
    return rounded(rank_by(survival.brier_macro(scored[0].unionByName(scored[1]), ["candidate"]), "landmark_customer_macro_brier"))


@catalog.query("horizon_brier", f"""
WITH {FOLLOW_SQL} SELECT fold, COUNT(*) AS horizon_known_n, round(AVG(pow(1 - s - (outcome = 'observed')::INT, 2)), 6) AS horizon_brier
FROM vf JOIN (SELECT fold, survival AS s FROM km WHERE day = 7) USING (fold) WHERE outcome <> 'unknown_due_to_hold' GROUP BY 1""")
def horizon_brier(spark, sf):
    """Brier score of the seven-day probability."""
    rows = stage(labels(spark, sf), "labels")
    last = curve(rows).filter(F.col("day") == HORIZON).select("fold", (1 - F.col("survival")).alias("probability"))
    return rounded(survival.horizon_brier(followed(rows).join(F.broadcast(last), "fold"), ["fold"], "probability"))  # one row per fold


@catalog.query("threshold_confusion", f"""
WITH {FOLLOW_SQL}, t AS (SELECT *, round(probability, 9) AS p, unnest([0.2, 0.35, 0.5]::DOUBLE[]) AS threshold FROM lmk),
c AS (SELECT fold, threshold, COUNT(*) FILTER (p >= threshold AND event_next = 1) AS tp, COUNT(*) FILTER (p >= threshold AND event_next = 0) AS fp,
 COUNT(*) FILTER (p < threshold AND event_next = 1) AS fn, COUNT(*) FILTER (p < threshold AND event_next = 0) AS tn FROM t GROUP BY 1, 2)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate, round((tp + fp) / (tp + fp + fn + tn), 6) AS alert_rate FROM c""")
def threshold_confusion(spark, sf):
    """Confusion counts per alert threshold."""
    return rounded(survival.threshold_confusion(landmark_rows(spark, sf).withColumn("probability", F.round("probability", 9)), ["fold"]))


@catalog.query("calibration", f"""
WITH {FOLLOW_SQL}, b AS (SELECT *, unnest([0, 0.1, 0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS lower, unnest([0.1, 0.2, 0.4, 0.6, 0.8, 1]::DOUBLE[]) AS upper FROM (SELECT 1))
SELECT lower, upper, COUNT(probability) AS n, round(AVG(probability), 6) AS mean_probability, round(AVG(event_next), 6) AS event_rate
FROM b LEFT JOIN lmk ON round(probability, 9) >= lower AND (round(probability, 9) < upper OR upper = 1) GROUP BY 1, 2""")
def calibration(spark, sf):
    """Mean probability and event rate per bin."""
    return rounded(survival.calibration(landmark_rows(spark, sf).withColumn("probability", F.round("probability", 9))))


@catalog.query("risk_coverage", f"""
WITH {FOLLOW_SQL}, e AS (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS elapsed_days FROM vf)
SELECT fold, elapsed_days, COUNT(*) FILTER (event AND duration <= elapsed_days) AS already_repurchased, COUNT(*) FILTER (NOT event AND duration < elapsed_days + 2) AS unknown_due_to_hold,
COUNT(*) FILTER (NOT (event AND duration <= elapsed_days) AND NOT (NOT event AND duration < elapsed_days + 2)) AS evaluable FROM e GROUP BY 1, 2""")
def risk_coverage(spark, sf):
    """Risk-set coverage per fold and elapsed day."""
    return survival.risk_coverage(followed(labels(spark, sf)), ["fold"], MARKS, STEP)


@catalog.query("aft_probability", f"""
WITH {SCORED_SQL}, p AS (SELECT fold, origin_event_id, ln(base_gap) AS mu, d, unnest([0, 1, 3]) AS elapsed_days FROM (SELECT *, 1.0 AS d FROM pred))
SELECT fold, origin_event_id, elapsed_days, round(1 - (1 / (1 + exp((ln(elapsed_days + 2) - mu) / 0.5))) / CASE WHEN elapsed_days = 0 THEN 1 ELSE 1 / (1 + exp((ln(nullif(elapsed_days, 0)) - mu) / 0.5)) END, 6) AS logistic,
 round(1 - exp(-exp((ln(elapsed_days + 2) - mu) / 0.5)) / CASE WHEN elapsed_days = 0 THEN 1 ELSE exp(-exp((ln(nullif(elapsed_days, 0)) - mu) / 0.5)) END, 6) AS weibull FROM p""")
def aft_probability(spark, sf):
    """Two-day event probabilities of logistic and Weibull time-to-event models centred on the baseline gap."""
    rows = predictions(spark, sf).withColumn("elapsed_days", F.explode(F.array(*[F.lit(d) for d in (0, 1, 3)])))
    mu, t = F.log(F.col("predicted_gap_days").cast("double")), F.col("elapsed_days")
    def probability(kind):
        return conditional_probability(aft_log_survival(mu, t, kind, 0.5), aft_log_survival(mu, t + 2, kind, 0.5))
    return rounded(rows.select("fold", "origin_event_id", "elapsed_days", probability("logistic").alias("logistic"), probability("weibull").alias("weibull")))


def _fixed_aft_sql(name: str, survival_at: str) -> str:
    """Landmark probability of a fixed regression centred on the baseline gap; `{t}` stands for the day."""
    later, now = survival_at.format(t="(elapsed_days + 2)"), survival_at.format(t="nullif(elapsed_days, 0)")
    return f"""SELECT '{name}' AS candidate, customer_id, origin_event_id, event_next, 1 - {later} / CASE WHEN elapsed_days = 0 THEN 1 ELSE {now} END AS probability
      FROM lmk JOIN (SELECT fold, origin_event_id, ln(base_gap) AS mu FROM pred) USING (fold, origin_event_id)"""


@catalog.query("survival_ranking", f"""
WITH {FOLLOW_SQL}, c AS (SELECT 'km' AS candidate, customer_id, origin_event_id, event_next, probability FROM lmk
  UNION ALL {_fixed_aft_sql("aft_logistic", "(1 / (1 + exp((ln({t}) - mu) / 0.5)))")} UNION ALL {_fixed_aft_sql("aft_weibull", "exp(-exp((ln({t}) - mu) / 0.5))")}),
b AS (SELECT candidate, AVG(m) AS b FROM (SELECT candidate, customer_id, AVG(m) AS m FROM (
  SELECT candidate, customer_id, origin_event_id, AVG(pow(probability - event_next, 2)) AS m FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY round(b, 9), candidate) AS INT) AS rank, candidate, round(b, 6) AS landmark_customer_macro_brier FROM b""")
def survival_ranking(spark, sf):
    """The survival curve against two fixed regressions on the same landmarks, ranked by Brier score."""
    rows = stage(labels(spark, sf), "labels")
    marks = survival.km_landmark_probability(survival.landmarks(followed(rows), MARKS, STEP), curve(rows), ["fold"], STEP)
    base = predictions(spark, sf).select("fold", "origin_event_id", F.log(F.col("predicted_gap_days").cast("double")).alias("mu"))
    candidates = {"km": F.col("probability"), **{f"aft_{kind}": survival.aft_landmark_probability(F.col("mu"), kind, 0.5, STEP) for kind in ("logistic", "weibull")}}
    scored = survival.candidate_landmarks(marks.join(base, ["fold", "origin_event_id"]), candidates)
    return rounded(rank_by(survival.brier_macro(scored, ["candidate"]), "landmark_customer_macro_brier"))


def _normal_tail_sql(z):
    """log P(Z > z) in SQL, the same approximation as `log_normal_tail`."""
    a = f"abs({z} / sqrt(2.0))"
    t = f"(1 / (1 + 0.5 * {a}))"
    poly = repr(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    far = f"(ln({t}) - {a} * {a} + {poly})"
    return f"CASE WHEN {z} >= 0 THEN {far} ELSE ln(2 - exp({far})) END - ln(2.0)"


@catalog.query("aft_probability_normal", f"""
WITH {SCORED_SQL}, p AS (SELECT fold, origin_event_id, ln(base_gap) AS mu FROM pred),
z AS (SELECT *, (ln(1.0) - mu) / 0.5 AS za, (ln(3.0) - mu) / 0.5 AS zb FROM p)
SELECT fold, origin_event_id, round(1 - exp(({_normal_tail_sql('zb')}) - ({_normal_tail_sql('za')})), 6) AS normal FROM z""")
def aft_probability_normal(spark, sf):
    """The same with a normal error."""
    rows = predictions(spark, sf)
    mu = F.log(F.col("predicted_gap_days").cast("double"))
    p = conditional_probability(aft_log_survival(mu, F.lit(1), "normal", 0.5), aft_log_survival(mu, F.lit(3), "normal", 0.5))
    return rounded(rows.select("fold", "origin_event_id", p.alias("normal")))


REPLICATES = 2000


def _weights_sql():
    return " + ".join(f"(CASE WHEN u >= {bound!r} THEN 1 ELSE 0 END)" for bound in survival.poisson_cdf())


@catalog.query("paired_bootstrap", f"""
WITH {SCORED_SQL}, f AS (SELECT candidate, origin_event_id, customer_id, CASE WHEN abs(d) <= 1 THEN 1 ELSE 0 END AS hit FROM scored WHERE outcome = 'observed'),
p AS (SELECT a.candidate, a.customer_id, a.hit - b.hit AS difference FROM f a JOIN f b USING (origin_event_id) WHERE b.candidate = 'pair_median_qlast' AND a.candidate IN ('last_gap_qlast', 'recent3_gap_qlast')),
c AS (SELECT candidate, customer_id, SUM(difference)::DOUBLE AS total, COUNT(*) AS n FROM p GROUP BY 1, 2),
r AS (SELECT *, unnest(range({REPLICATES})) AS rep FROM c),
w AS (SELECT *, CAST('0x' || substr(sha256((rep // 4) || ':' || customer_id), CAST(16 * (rep % 4) + 1 AS INT), 13) AS BIGINT) / pow(2, 52) AS u FROM r),
m AS (SELECT candidate, rep, SUM(({_weights_sql()}) * total) / SUM(({_weights_sql()}) * n) AS mean FROM w GROUP BY 1, 2)
SELECT candidate, round(delta, 6) AS delta, CAST(n AS BIGINT) AS n, customers, round(low, 6) AS low, round(high, 6) AS high
FROM (SELECT candidate, SUM(total) / SUM(n) AS delta, SUM(n) AS n, COUNT(*) AS customers FROM c GROUP BY 1)
JOIN (SELECT candidate, QUANTILE_CONT(mean, 0.025) AS low, QUANTILE_CONT(mean, 0.975) AS high FROM m GROUP BY 1) USING (candidate)""")
def paired_bootstrap(spark, sf):
    """Interval of the hit-rate difference to the pair median, resampling customers."""
    rows = stored_scored(spark, sf).filter("outcome = 'observed'").withColumn("hit", (F.abs(F.col("predicted_gap_days") - F.col("target_gap_days")) <= 1).cast("int"))
    base = rows.filter("candidate = 'pair_median_qlast'").select("origin_event_id", F.col("hit").alias("base_hit"))
    pairs = (rows.filter(F.col("candidate").isin("last_gap_qlast", "recent3_gap_qlast")).join(base, "origin_event_id")
             .select("candidate", "customer_id", (F.col("hit") - F.col("base_hit")).alias("difference")))
    return rounded(survival.paired_bootstrap(pairs, ["candidate"], REPLICATES))


CART_WINDOW = 2


@catalog.query("flag_bootstrap", f"""
WITH {CART_SQL}, f AS (SELECT candidate, origin_event_id, customer_id, CAST(target_on - cart_on AS INT) AS m FROM cart WHERE outcome = 'observed'),
g AS (SELECT candidate, origin_event_id, customer_id, unnest(['window', 'late', 'too_early']) AS flag,
             unnest([(m BETWEEN 0 AND {CART_WINDOW})::INT, (m < 0)::INT, (m > {CART_WINDOW})::INT]) AS hit FROM f),
p AS (SELECT a.candidate, a.flag, a.customer_id, a.hit - b.hit AS difference FROM g a JOIN g b ON a.origin_event_id = b.origin_event_id AND a.flag = b.flag
      WHERE b.candidate = 'pair_median_qlast' AND a.candidate IN ('last_gap_qlast', 'recent3_gap_qlast')),
c AS (SELECT candidate, flag, customer_id, SUM(difference)::DOUBLE AS total, COUNT(*) AS n FROM p GROUP BY 1, 2, 3),
r AS (SELECT *, unnest(range({REPLICATES})) AS rep FROM c),
w AS (SELECT *, CAST('0x' || substr(sha256((rep // 4) || ':' || customer_id), CAST(16 * (rep % 4) + 1 AS INT), 13) AS BIGINT) / pow(2, 52) AS u FROM r),
m AS (SELECT candidate, flag, rep, SUM(({_weights_sql()}) * total) / SUM(({_weights_sql()}) * n) AS mean FROM w GROUP BY 1, 2, 3)
SELECT candidate, flag, round(delta, 6) AS delta, CAST(n AS BIGINT) AS n, customers, round(low, 6) AS low, round(high, 6) AS high
FROM (SELECT candidate, flag, SUM(total) / SUM(n) AS delta, SUM(n) AS n, COUNT(*) AS customers FROM c GROUP BY 1, 2)
JOIN (SELECT candidate, flag, QUANTILE_CONT(mean, 0.025) AS low, QUANTILE_CONT(mean, 0.975) AS high FROM m GROUP BY 1, 2) USING (candidate, flag)""")
def flag_bootstrap(spark, sf):
    """Intervals of the window, late and too-early rates against the pair median, from one pass of shared weights."""
    margin = F.datediff("target_on", F.to_date("cart_at"))
    rows = with_cart(stored_scored(spark, sf).filter("outcome = 'observed'")).select(
        "candidate", "origin_event_id", "customer_id", *[c.alias(n) for n, c in survival.timing_flags(margin, CART_WINDOW).items()])
    flags = ["window", "late", "too_early"]
    base = rows.filter("candidate = 'pair_median_qlast'").select("origin_event_id", *[F.col(n).alias(f"base_{n}") for n in flags])
    pairs = rows.filter(F.col("candidate").isin("last_gap_qlast", "recent3_gap_qlast")).join(base, "origin_event_id").select(
        "candidate", "customer_id", *[(F.col(n) - F.col(f"base_{n}")).alias(n) for n in flags])
    return rounded(survival.flag_bootstrap(pairs, ["candidate"], flags, REPLICATES))
