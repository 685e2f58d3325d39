"""Survival curves, probability scores and error metrics on worked values."""
import random
from datetime import date

import pytest
from helpers import by
from pyspark.sql import functions as F

from rebuyflow.config import Fold
from rebuyflow.operators import baseline, metrics, reports, survival


def test_kaplan_meier_worked_curve(spark):
    df = spark.createDataFrame([("x", 2, True), ("x", 2, False), ("x", 4, True), ("x", 6, False)], "fold string, duration int, event boolean")
    curve = survival.kaplan_meier(df, ["fold"], 6).orderBy("day")
    assert [r["survival"] for r in curve.collect()] == [1, 1, .75, .75, .375, .375, .375]
    assert survival.median_survival_day(curve, ["fold"], 6).first()["median_day"] == 4


def test_curve_reaches_zero(spark):
    df = spark.createDataFrame([("x", 1, True), ("x", 1, True)], "fold string, duration int, event boolean")
    assert [r["survival"] for r in survival.kaplan_meier(df, ["fold"], 3).orderBy("day").collect()] == [1, 0, 0, 0]


FOLLOW = "id string, origin_on date, label_state string, target_on date, target_gap_days int, blocking_on date"


def test_followup_censors_before_hold_and_at_cutoff(spark):
    o = date(2026, 1, 1)
    rows = [("seen", o, "observed", date(2026, 1, 5), 4, None), ("future", o, "observed", date(2026, 2, 20), 50, None), ("hold", o, "blocked_by_hold", None, None, date(2026, 1, 9)),
            ("next_day_hold", o, "blocked_by_hold", None, None, date(2026, 1, 2)), ("open", o, "right_censored", None, None, None)]
    df = survival.with_followup(spark.createDataFrame(rows, FOLLOW), F.lit(date(2026, 1, 31)), 60)
    assert by(df, "id", "duration", "event") == {"seen": (4, True), "future": (30, False), "hold": (7, False), "next_day_hold": (0, False), "open": (30, False)}
    bounds = survival.training_bounds(spark.createDataFrame(rows, FOLLOW), [Fold("f", date(2026, 1, 31), o, o)], 40, 20)
    assert by(bounds, "id", "upper") == {"seen": 4, "future": None, "hold": None, "open": None}


def test_landmarks_need_known_outcomes(spark):
    df = spark.createDataFrame([("a", 10, True), ("b", 10, False), ("c", 60, False)], "id string, duration int, event boolean")
    got = sorted((r["id"], r["elapsed_days"], r["event_next"]) for r in survival.landmarks(df, (0, 7, 14), 7).collect())
    assert got == [("a", 0, 0), ("a", 7, 1), ("b", 0, 0), ("c", 0, 0), ("c", 7, 0), ("c", 14, 0)]


def test_brier_averages_landmark_origin_customer(spark):
    rows = [("x", "c1", "o1", 0.5, 1), ("x", "c1", "o1", 0.0, 1), ("x", "c1", "o2", 1.0, 1), ("x", "c2", "o3", 1.0, 0)]
    df = spark.createDataFrame(rows, "f string, customer_id string, origin_event_id string, probability double, event_next int")
    r = survival.brier_macro(df, ["f"]).first()
    assert r["landmark_customer_macro_brier"] == pytest.approx(((0.625 + 0) / 2 + 1) / 2)
    assert (r["landmark_brier"], r["landmarks_n"], r["landmark_positive_n"], r["landmark_customers"]) == (pytest.approx((0.25 + 1 + 0 + 1) / 4), 4, 3, 2)
    bins = {b["lower"]: b["n"] for b in survival.calibration(df).collect()}
    assert bins == {0.0: 1, 0.1: 0, 0.2: 0, 0.4: 1, 0.6: 0, 0.8: 2}
    confusion = survival.threshold_confusion(df, ["f"], (0.5,)).first()
    assert (confusion["tp"], confusion["fp"], confusion["fn"], confusion["tn"]) == (2, 1, 1, 0)


def test_bootstrap_interval_covers_the_mean_and_is_degenerate_without_spread(spark):
    rng = random.Random(1)
    rows = [("x", f"c{i}", rng.choice([0, 1])) for i in range(400)] + [("same", f"c{i}", 1) for i in range(50)]
    df = spark.createDataFrame(rows, "candidate string, customer_id string, difference int")
    got = by(survival.paired_bootstrap(df, ["candidate"], 400), "candidate", "delta", "low", "high")
    mean = sum(r[2] for r in rows[:400]) / 400
    delta, low, high = got["x"]
    assert delta == pytest.approx(mean) and low < mean < high
    assert (high - low) / 2 == pytest.approx(1.96 * (mean * (1 - mean) / 400) ** 0.5, rel=0.2)
    assert got["same"] == (1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        survival.paired_bootstrap(df, ["candidate"], 401)


def test_bootstrap_weights_are_poisson_one(spark):
    df = spark.range(40000).select(survival.bootstrap_weight(F.sha2(F.col("id").cast("string"), 256), 1).alias("w"))
    mean, var = df.agg(F.avg("w"), F.var_pop("w")).first()
    assert mean == pytest.approx(1, abs=0.03) and var == pytest.approx(1, abs=0.05)


TRAIN = "fold string, product_id string, target_gap_days int"


def test_baseline_falls_back_from_pair_to_product_to_global(spark):
    train = spark.createDataFrame([("all", "a", g) for g in (2, 4, 6, 8, 10)] + [("all", "b", 30)], TRAIN)
    model = baseline.fit_baseline(train)
    rows = spark.createDataFrame([("1", "all", "a", 3, 2, 4.5), ("2", "all", "a", 3, 0, None), ("3", "all", "b", 3, 0, None), ("4", "all", "z", 3, 0, None)],
                                 "id string, fold string, product_id string, qty_last int, gap_count int, gap_median_days double")
    got = by(baseline.predict_baseline(rows, model), "id", "predicted_gap_days", "gap_source")
    assert got == {"1": (5, "pair"), "2": (6, "product"), "3": (7, "global"), "4": (7, "global")}
    bad = spark.createDataFrame([(0, 0, None), (1, 0, 3.0), (1, 2, None), (1, 1, 2.0)], "qty_last int, gap_count int, gap_median_days double")
    assert baseline.invalid_baseline_inputs(bad).count() == 3


SCORED = ("candidate string, customer_id string, origin_on date, outcome string, predicted_gap_days int, cart_quantity int, target_gap_days int, target_quantity int, "
          "target_on date, cart_at string")


def scored(spark, rows):
    df = spark.createDataFrame([("m", *r) for r in rows], SCORED)
    return df.withColumn("cart_at", F.col("cart_at").cast("timestamp_ntz"))


def test_weekly_metrics_same_day_is_not_early(spark):
    cart = "2026-09-27 22:00:00"
    rows = [("a", date(2026, 9, 1), "observed", 7, 1, 1, 1, date(2026, 9, 28), cart), ("a", date(2026, 9, 1), "observed", 20, 1, 1, 1, date(2026, 9, 27), cart),
            ("b", date(2026, 9, 1), "observed", 20, 1, 1, 1, date(2026, 9, 20), cart), ("c", date(2026, 6, 1), "no_repurchase_within_horizon", 20, 1, None, None, None, "2026-06-14 22:00:00"),
            ("c", date(2026, 6, 1), "no_repurchase_within_horizon", 20, 1, None, None, None, "2026-09-06 22:00:00")]
    r = metrics.weekly_metrics(scored(spark, rows), ["candidate"]).first()
    assert (r["n"], r["late"], r["same_day"], r["early_1_to_10"], r["sunday_or_monday"], r["weekly_buyer"]) == (3, 1, 1, 1, 3, 1)
    assert (r["customer_macro_late_rate"], r["nonreturn_n"], r["nonreturn_cart_within_horizon_rate"]) == (0.5, 2, 0.5)


def test_monitor_metrics_score_only_the_window(spark):
    rows = [("a", date(2026, 1, 1), o, p, 1, t, 1, None, None) for o, p, t in (
        ("observed", 14, 10), ("observed", 30, 44), ("observed", 58, 60), ("no_repurchase_within_horizon", 20, None), ("unknown_due_to_hold", 20, None))]
    r = metrics.monitor_metrics(scored(spark, rows), ["candidate"], 45).first()
    assert (r["origins"], r["repurchased"], r["hits"], r["hit_rate"], r["hit_rate_all_origins"], r["closed_without_purchase_rate"]) == (4, 2, 1, 0.5, 0.25, 0.5)


def test_timing_summary_and_empty_cohort(spark):
    rows = [("a", date(2026, 1, 1), "observed", 10, 3, 7, 1, None, None), ("a", date(2026, 1, 1), "observed", 10, 1, 10, 1, None, None), ("b", date(2026, 1, 1), "observed", 10, 9, 18, 5, None, None),
            ("b", date(2026, 1, 1), "no_repurchase_within_horizon", 61, 1, None, None, None, None), ("b", date(2026, 1, 1), "unknown_due_to_hold", 1, 1, None, None, None, None)]
    r = metrics.timing_summary(scored(spark, rows), ["candidate"], 60).first()
    assert (r["n"], r["origins"], r["customers"], r["small_quantity_n"]) == (3, 5, 2, 2)
    assert r["customer_macro_date_mae"] == pytest.approx((1.5 + 8) / 2) and r["date_mae"] == pytest.approx(11 / 3)
    assert r["small_quantity_over_by_2_or_more_rate"] == 0.5 and r["no_repurchase_but_predicted_within_horizon_rate"] == 0
    ext = metrics.score_extension(scored(spark, rows), ["candidate"]).first()
    assert (ext["date_80pct_tolerance_days"], ext["joint_date_7_quantity_2_rate"]) == (8, pytest.approx(2 / 3))
    empty = metrics.timing_summary(scored(spark, rows[3:]), ["candidate"], 60).first()
    assert (empty["n"], empty["date_mae"], empty["customers"]) == (0, None, None)


def test_daily_cohorts_keep_empty_days_and_reconcile(spark):
    df = spark.createDataFrame([(date(2026, 7, 14), 4, 2, 6, 4), (date(2026, 7, 14), 2, 4, 7, 10)],
                               "origin_on date, target_quantity int, predicted_quantity int, target_gap_days int, predicted_gap_days int")
    daily = metrics.daily_cohorts(df, date(2026, 7, 14), date(2026, 7, 15)).orderBy("origin_on")
    first, second = daily.collect()
    assert (first["actual_mean"], first["predicted_mean"], first["quantity_mae"], first["quantity_rmse"], first["date_mae"]) == (3, 3, 2, 2, 2.5)
    assert (second["n"], second["quantity_mae"]) == (0, None)
    total = metrics.reaggregate_days(daily).first()
    assert (total["n"], total["quantity_mae"], total["date_mae_days"]) == (2, 2, 2.5)


def test_comparison_is_null_for_a_perfect_baseline(spark):
    df = spark.createDataFrame([("base", 0.0, 4.0), ("new", 1.0, 3.0)], "candidate string, a double, b double")
    got = by(metrics.compare(df, "base", [], ["a", "b"]), "metric", "delta", "improvement_fraction")
    assert got == {"a": (1.0, None), "b": (-1.0, 0.25)}


def test_sample_ignores_labels(spark):
    df = spark.createDataFrame([(f"id{i}", i) for i in range(100)], "id string, label int")
    flipped = df.withColumn("label", -F.col("label"))
    pick = lambda x: sorted(r["id"] for r in reports.hash_sample(x, "id", 10).collect())
    assert pick(df) == pick(flipped) == pick(df.repartition(5))


def test_category_codes_are_dense_and_alphabetical_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        names = [f"p{i:04d}" for i in range(500)]
        df = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "name string").repartition(6)
        got = by(reports.category_codes(df, "name"), "name", "code")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {n: i for i, n in enumerate(names)}


def test_three_flags_share_the_weights_of_a_draw(spark):
    rng = random.Random(3)
    rows = [("x", f"c{i % 60}", a := rng.choice([0, 1]), -a, rng.choice([-1, 0, 1])) for i in range(300)]
    df = spark.createDataFrame(rows, "candidate string, customer_id string, window int, late int, difference int")
    got = by(survival.flag_bootstrap(df, ["candidate"], ["window", "late", "difference"], 400), "flag", "delta", "low", "high", "n", "customers")
    delta, low, high, *size = got["window"]
    assert got["late"] == (pytest.approx(-delta), pytest.approx(-high), pytest.approx(-low), *size)  # a mirrored flag has a mirrored interval
    alone = by(survival.paired_bootstrap(df, ["candidate"], 400), "candidate", "delta", "low", "high", "n", "customers")
    assert alone["x"] == pytest.approx(got["difference"])


def test_salted_sample_equals_the_plain_one(spark):
    import hashlib
    rows = [("hot" if i % 3 else "cold", str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id string")
    for n in (1, 40, 5000):
        got = sorted((r["g"], r["sample_rank"], r["id"]) for r in reports.hash_sample_per(df, "g", "id", n).collect())
        want = []
        for g in ("cold", "hot"):
            ids = sorted((i for h, i in rows if h == g), key=lambda i: hashlib.sha256(i.encode()).hexdigest())
            want += [(g, k, i) for k, i in enumerate(ids[:n], 1)]
        assert got == want


def test_weighted_sums_draw_the_stated_weights_once_per_customer_in_many_tasks(spark):
    rows = [(c, f"u{i % 37}" if i % 10 else None, float(i % 7 - 3) if i % 4 else None, 1) for i in range(300) for c in ("x", "y", None)]
    df = spark.createDataFrame(rows, "candidate string, customer_id string, t double, n long")
    digest = F.sha2(F.concat_ws(":", F.floor(F.col("replicate") / 4).cast("string"), "customer_id"), 256)
    drawn = F.expr("CASE replicate % 4 " + " ".join(f"WHEN {i} THEN w{i}" for i in range(4)) + " END")
    plain = (df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumns({f"w{i}": survival.bootstrap_weight(digest, i) for i in range(4)})
             .groupBy("candidate", "replicate").agg(F.sum(drawn * F.col("t")).alias("t"), F.sum(drawn * F.col("n")).cast("double").alias("n")))
    sums = survival.weighted_sums(df, ["candidate"], ["t", "n"], 20)
    assert sorted(map(tuple, sums.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    # a customer is few bytes and many digests: adaptive execution must not put all of them into one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "REPARTITION_BY_NUM" in sums._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")) and tasks > 1


def test_a_flag_that_is_never_known_has_no_interval(spark):
    df = spark.createDataFrame([("x", f"c{i}", None, 1) for i in range(8)], "candidate string, customer_id string, window int, late int")
    got = by(survival.flag_bootstrap(df, ["candidate"], ["window", "late"], 40), "flag", "delta", "low", "high", "n")
    assert got == {"window": (None, None, None, 8), "late": (1.0, 1.0, 1.0, 8)}
