"""Past-only behaviour, day batches, item speed and routing."""
import random
from datetime import date, timedelta

import pytest
from helpers import by, events

from rebuyflow.config import CadenceConfig, Fold, RouterConfig, SplitConfig, VisitConfig
from rebuyflow.operators import cadence, features
from rebuyflow.operators.events import sequence
from rebuyflow.sources import driver_tables

SF = "/root/testdata/sf0.001"


def hist(df):
    return features.history(sequence(df))


def generated(customers=12, products=3, days=60, seed=3):
    rng, rows = random.Random(seed), []
    for c in range(customers):
        for p in range(products):
            for d in range(days):
                if rng.random() < 0.25:
                    state = "held" if rng.random() < 0.05 else "completed"
                    rows.append((f"{c}-{p}-{d:03d}", f"c{c}", f"p{p}", str(date(2026, 1, 1) + timedelta(days=d)), state, rng.randint(1, 9)))
    return rows


def test_features_are_past_only(spark):
    rows = generated()
    cutoff = "2026-02-05"
    cfg = CadenceConfig(minimum_product_intervals=5, minimum_product_customers=2)
    def table(selected):
        out = cadence.enriched_origins(hist(events(spark, selected)), cfg).filter(f"origin_on <= '{cutoff}'")
        keep = [c for c in out.columns if not c.startswith(("target_", "label_", "blocking_"))]
        return sorted(map(str, out.select(*keep).collect()))
    assert table(rows) == table([r for r in rows if r[3] <= cutoff])


def test_input_order_does_not_matter(spark):
    rows = generated(customers=5)
    shuffled = rows[:]
    random.Random(9).shuffle(shuffled)
    a, b = (sorted(map(str, cadence.enriched_origins(hist(events(spark, r).repartition(n)), CadenceConfig()).collect())) for r, n in ((rows, 1), (shuffled, 7)))
    assert a == b


def brute_force_speed(rows, cfg):
    """Day by day recomputation of item speed for the completed days."""
    import statistics
    last, intervals, out = {}, {}, {}
    for day in sorted({r[3] for r in rows}):
        batch = sorted(r for r in rows if r[3] == day)
        for event_id, c, p, _, state, q in batch:
            if state == "held":
                last.pop((c, p), None)
                continue
            if (c, p) in last:
                d0, q0 = last[c, p]
                gap = (date.fromisoformat(day) - d0).days
                intervals.setdefault(p, []).append((gap, gap / q0, c))
            last[c, p] = (date.fromisoformat(day), q)
        for p in {r[2] for r in batch if r[4] == "completed"}:
            recent = intervals.get(p, [])[-cfg.product_recent_intervals:]
            enough = len(recent) >= cfg.minimum_product_intervals and len({c for *_, c in recent}) >= cfg.minimum_product_customers
            gaps = [g for g, *_ in recent]
            out[p, day] = (len(recent), len({c for *_, c in recent}), statistics.median(gaps) if enough else None,
                           statistics.pstdev(gaps) / statistics.mean(gaps) if enough else None, statistics.median(u for _, u, _ in recent) if enough else None)
    return out


@pytest.mark.parametrize("window", [7, 100])
def test_item_speed_against_brute_force(spark, window):
    rows = generated(customers=15, products=2, days=50)
    cfg = CadenceConfig(product_recent_intervals=window, minimum_product_intervals=5, minimum_product_customers=2)
    expected = brute_force_speed(rows, cfg)
    got = {(r["product_id"], str(r["origin_on"])): r for r in cadence.item_speed(hist(events(spark, rows)), cfg).collect()}
    assert set(got) == set(expected)
    for key, (n, customers, median, cv, unit) in expected.items():
        r = got[key]
        assert (r["item_gap_count"], r["item_interval_customers"], r["item_gap_median"]) == (n, customers, median)
        assert (r["item_gap_cv"], r["item_days_per_previous_unit"]) == (pytest.approx(cv) if cv is not None else None, pytest.approx(unit) if unit is not None else None)


def test_customer_days_share_products_and_holds_clear_them(spark):
    rows = [("1", "c", "a", "2026-01-01", "completed", 1), ("2", "c", "b", "2026-01-08", "completed", 1), ("3", "c", "a", "2026-01-15", "completed", 1),
            ("4", "c", "a", "2026-01-22", "completed", 1), ("5", "c", "b", "2026-01-22", "completed", 1), ("6", "c", "a", "2026-02-01", "held", None),
            ("8", "c", "b", "2026-02-01", "completed", 1), ("7", "c", "a", "2026-02-10", "completed", 1)]
    got = by(cadence.customer_cadence(hist(events(spark, rows)), VisitConfig()), "origin_on", "cadence_class")
    assert got[date(2026, 1, 15)] == "insufficient_history" and got[date(2026, 1, 22)] == "within_14d" and got[date(2026, 2, 10)] == "insufficient_history"
    days = by(features.customer_days(hist(events(spark, rows))), "origin_on", "visit_index", "visit_gap", "customer_purchase_days", "customer_product_count")
    assert days[date(2026, 2, 1)] == (1, None, 5, 2) and days[date(2026, 2, 10)] == (2, 9, 6, 2)


def walk(classes, window, votes):
    """Sequential definition of the hysteresis."""
    current, seen, out = None, [], []
    for raw in classes:
        seen.append(raw)
        last, before = seen[-window:], current
        if raw == "insufficient" or current in (None, "insufficient") or (raw != current and last.count(raw) >= votes):
            current = raw
        out.append((current, round(last.count(current) / len(last), 3), before is not None and current != before))
    return out


def routed(spark, classes, cfg):
    rows = [(f"e{i:04d}", "c", "p", date(2026, 1, 1) + timedelta(days=i), g) for i, g in enumerate(classes)]
    df = spark.createDataFrame(rows, "origin_event_id string, customer_id string, product_id string, origin_on date, pair_group string")
    out = cadence.with_routes(df, cfg).orderBy("origin_on").collect()
    return [(r["route_group"], r["route_confidence"], r["route_changed"]) for r in out]


def test_worked_route_sequence(spark):
    classes = ["stable", "stable", "irregular", "stable", "irregular", "irregular", "insufficient", "speeding_up"]
    got = routed(spark, classes, RouterConfig())
    assert [g for g, *_ in got] == ["stable"] * 4 + ["irregular"] * 2 + ["insufficient", "speeding_up"]
    assert [i for i, (*_, changed) in enumerate(got) if changed] == [4, 6, 7]


@pytest.mark.parametrize("window, votes", [(3, 2), (4, 3), (5, 2), (3, 1)])
def test_routes_equal_the_sequential_rule(spark, window, votes):
    rng = random.Random(window * 10 + votes)
    classes = [rng.choice(["stable", "irregular", "insufficient", "rebound"]) for _ in range(200)]
    assert routed(spark, classes, RouterConfig(switch_window=window, switch_min_votes=votes)) == walk(classes, window, votes)


def test_split_purges_targets_beyond_the_role(spark):
    cfg = SplitConfig(date(2026, 1, 1), date(2026, 1, 10), date(2026, 1, 20), date(2026, 1, 25), date(2026, 1, 31))
    rows = [("a", date(2026, 1, 5), "observed", date(2026, 1, 9)), ("b", date(2026, 1, 5), "observed", date(2026, 1, 15)), ("c", date(2026, 1, 12), "observed", date(2026, 1, 20)),
            ("d", date(2026, 1, 21), "right_censored", None), ("e", date(2026, 2, 1), "observed", date(2026, 2, 3)), ("f", date(2026, 1, 26), "blocked_by_hold", None)]
    df = spark.createDataFrame(rows, "origin_event_id string, origin_on date, label_state string, target_on date")
    got = by(features.with_split(df, cfg), "origin_event_id", "fit_role", "split_outcome", "role_eligible", "train_pool")
    assert got == {"a": ("train_core", "observed", True, True), "b": ("train_core", "crosses_role_boundary", False, True),
                   "c": ("early_stop", "observed", True, True), "d": ("validation", "right_censored", False, False),
                   "e": (None, "out_of_window", False, False), "f": ("final_test", "blocked_by_hold", False, False)}
    with pytest.raises(ValueError):
        SplitConfig(date(2026, 1, 1), date(2026, 1, 20), date(2026, 1, 20), date(2026, 1, 25), date(2026, 1, 31))


def test_fold_assignment_and_horizon(spark):
    rows = [("a", date(2026, 1, 5), "observed", date(2026, 1, 9), None), ("b", date(2026, 1, 6), "blocked_by_hold", None, date(2026, 1, 8)), ("c", date(2026, 1, 30), "right_censored", None, None)]
    df = spark.createDataFrame(rows, "origin_event_id string, origin_on date, label_state string, target_on date, blocking_on date")
    folds = [Fold("x", date(2026, 1, 4), date(2026, 1, 5), date(2026, 1, 6)), Fold("y", date(2026, 1, 5), date(2026, 1, 6), date(2026, 1, 9))]
    got = sorted((r["origin_event_id"], r["fold"]) for r in features.assign_folds(df, folds).collect())
    assert got == [("a", "x"), ("b", "x"), ("b", "y")]
    outcome = by(df.select("origin_event_id", features.horizon_outcome(date(2026, 1, 31), 3).alias("o")), "origin_event_id", "o")
    assert outcome == {"a": "no_repurchase_within_horizon", "b": "unknown_due_to_hold", "c": "not_mature"}


def test_exceptional_period(spark):
    rows = [(date(2026, 1, 10), date(2026, 3, 10)), (date(2025, 12, 20), date(2026, 1, 5)), (date(2025, 12, 1), date(2025, 12, 20)), (date(2026, 3, 1), None)]
    df = spark.createDataFrame(rows, "origin_on date, target_on date")
    assert features.without_exceptional_period(df, date(2026, 1, 1), date(2026, 2, 28)).count() == 2


def test_driver_tables_are_past_only(spark):
    full = driver_tables.daily_events(spark, SF)
    part = full.filter("ordered_on <= DATE '2024-01-20'")
    def rows(df):
        return sorted(map(str, features.origin_table(hist(df)).filter("origin_on <= DATE '2024-01-20'").select("origin_event_id", *features.BASE_FEATURES).collect()))
    assert rows(full) == rows(part)
