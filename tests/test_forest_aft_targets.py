"""Quantile forest, survival regression by Newton steps and product target statistics against plain versions."""
import math
import random
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rebuyflow.functions.survival import aft_log_survival
from rebuyflow.operators import aft, features, forest, models
from rebuyflow.plans.stages import stage

DAY = date(2024, 1, 1)


# --- forest -----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def gaps(spark):
    """Rows whose gap depends on one input: short and narrow below 10, long and wide above; some inputs are missing."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        x = float(r.integers(0, 20))
        gap = int(r.integers(3, 8)) if x < 10 else int(r.integers(10, 40))
        rows.append((f"o{i}", "train" if i < 2000 else "test", None if i % 11 == 0 else x, "short" if x < 10 else "long", gap))
    names = [n for n in models.feature_names("base") if n != "gap_last_days"]
    frame = spark.createDataFrame(rows, "origin_event_id string, part string, gap_last_days double, kind string, target_gap_days int")
    return frame.withColumns({n: F.lit(1.0) for n in names})


def test_forest_quantiles_equal_a_plain_reading_of_the_leaves(gaps):
    cfg = forest.ForestConfig(trees=7, max_depth=4)
    grown = forest.fit_quantile_forest(gaps.filter("part = 'train'"), "target_gap_days", "base", cfg)
    assert grown.leaves.count() <= 7 * 2 ** 4
    leaf_of = {r["origin_event_id"]: r["l"] for r in grown.model.setLeafCol("leaf_ids").transform(models.design(gaps, "base"))
               .select("origin_event_id", vector_to_array("leaf_ids").alias("l")).collect()}
    rows = {r["origin_event_id"]: r for r in gaps.collect()}
    held = defaultdict(list)
    for key, leaves in leaf_of.items():
        if rows[key]["part"] == "train":
            for tree, leaf in enumerate(leaves):
                held[tree, leaf].append(rows[key]["target_gap_days"])
    got = {r["origin_event_id"]: r for r in forest.with_forest_quantiles(gaps.filter("part = 'test'"), grown).collect()}
    assert len(got) == 1000
    for key, row in got.items():
        share = defaultdict(float)
        for tree, leaf in enumerate(leaf_of[key]):
            for v in held[tree, leaf]:
                share[v] += 1 / len(held[tree, leaf]) / len(leaf_of[key])
        for q, name in ((.25, "gap_q25"), (.5, "gap_q50"), (.75, "gap_q75")):
            total = 0.0
            for v in sorted(share):
                total += share[v]
                if total >= q - 1e-9:
                    break
            assert row[name] == v


def test_forest_intervals_cover_half_of_unseen_gaps_per_class(gaps):
    grown = forest.fit_quantile_forest(gaps.filter("part = 'train' AND gap_last_days IS NOT NULL"), "target_gap_days", "base", forest.ForestConfig(trees=20, feature_share="all"))
    got = {r["kind"]: r for r in forest.coverage(forest.with_forest_quantiles(gaps.filter("part = 'test' AND gap_last_days IS NOT NULL"), grown), ["kind"], "target_gap_days").collect()}
    assert .45 <= got["long"]["coverage"] <= .65 and got["long"]["mean_width"] > 10
    assert .45 <= got["short"]["coverage"] <= .65 and got["short"]["mean_width"] < 4  # whole days: both ends count


def test_weights_move_leaf_densities(spark):
    rows = spark.createDataFrame([(0, 1, 2.0, 1.0), (0, 1, 5.0, 3.0), (0, 2, 5.0, 2.0)], "tree int, leaf int, value_of double, w double")
    got = {r["leaf"]: r["density"] for r in forest.leaf_densities(rows, (2.0, 5.0), "value_of", F.col("w")).collect()}
    assert got == {1: [.25, .75], 2: [0.0, 1.0]}


# --- survival regression ----------------------------------------------------------------------------------------------

def plain_log_likelihood(kind, intercept, b, scale, rows):
    total = 0.0
    for x, duration, event in rows:
        z = (math.log(duration) - intercept - sum(p * q for p, q in zip(b, x))) / scale
        if kind == "normal":
            total += -z * z / 2 - math.log(2 * math.pi) / 2 - math.log(scale) if event else math.log(math.erfc(z / math.sqrt(2)) / 2)
        elif kind == "logistic":
            total += z - 2 * math.log1p(math.exp(z)) - math.log(scale) if event else -math.log1p(math.exp(z))
        else:
            total += z - math.exp(z) - math.log(scale) if event else -math.exp(z)
    return total


def plain_fit(kind, rows):
    """Coordinate-free plain climb: Newton steps on numeric derivatives of the plain likelihood."""
    p = len(rows[0][0]) + 2

    def value(t):
        try:
            return plain_log_likelihood(kind, t[0], t[1:-1], math.exp(t[-1]), rows)
        except (ValueError, OverflowError):
            return -math.inf
    theta = np.zeros(p)
    theta[0], theta[-1] = np.mean([math.log(d) for _, d, _ in rows]), math.log(.8)
    h = 1e-4
    for _ in range(60):
        eye = np.eye(p) * h
        g = np.array([(value(theta + e) - value(theta - e)) / (2 * h) for e in eye])
        hess = np.array([[(value(theta + a + b) - value(theta + a - b) - value(theta - a + b) + value(theta - a - b)) / (4 * h * h) for b in eye] for a in eye])
        ridge = 0.0
        step = np.linalg.solve(-hess, g)
        while value(theta + step) < value(theta) - 1e-12 and ridge < 1e9:  # bend the step towards the gradient until it goes uphill
            ridge = max(1.0, 4 * ridge)
            step = np.linalg.solve(-hess + ridge * np.eye(p), g)
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return theta


@pytest.mark.parametrize("kind", aft.DISTRIBUTIONS)
def test_newton_fit_equals_a_plain_fit(spark, kind):
    r = np.random.default_rng(8)
    x = r.normal(size=(160, 2))
    noise = {"normal": r.normal(size=160), "logistic": r.logistic(size=160), "weibull": np.log(r.exponential(size=160))}[kind]
    time, stop = np.exp(1.5 + x @ [.6, -.3] + .5 * noise), r.uniform(2, 12, 160)
    rows = [([float(a), float(b)], float(min(t, s)), bool(t <= s)) for (a, b), t, s in zip(x, time, stop)]
    frame = spark.createDataFrame([(*v, d, e, 3.0) for v, d, e in rows], "a double, b double, duration double, event boolean, same double").repartition(3)
    model = aft.fit_newton(frame, kind, ("a", "b", "same"), ())
    slopes = [c / s for c, s in zip(model.coefficients[:2], model.spreads)]
    expected = plain_fit(kind, rows)
    assert np.allclose([model.intercept - sum(c * m for c, m in zip(slopes, model.means)), *slopes, math.log(model.scale)], expected, atol=1e-6)
    assert model.coefficients[2] == 0.0 and model.spreads[2] == 0.0  # a constant input decides nothing
    assert math.isclose(model.log_likelihood, plain_log_likelihood(kind, expected[0], expected[1:-1], math.exp(expected[-1]), rows), abs_tol=1e-6)
    row = frame.filter("a > 0").select("a", "b", aft_log_survival(model.margin(), F.lit(4), kind, model.scale).alias("s")).first()
    z = (math.log(4) - expected[0] - row["a"] * expected[1] - row["b"] * expected[2]) / math.exp(expected[-1])
    tail = {"normal": lambda: math.log(math.erfc(z / math.sqrt(2)) / 2), "logistic": lambda: -math.log1p(math.exp(z)), "weibull": lambda: -math.exp(z)}[kind]()
    assert math.isclose(row["s"], tail, abs_tol=1e-5)


def test_derivatives_are_those_of_the_likelihood():
    z, h = np.linspace(-6, 9, 61), 1e-5
    for kind in aft.DISTRIBUTIONS:
        z_own = np.minimum(z, 4) if kind == "weibull" else z
        for event in (np.ones(61, bool), np.zeros(61, bool)):
            _, first, second = aft.terms(kind, z_own, event)
            up, down = aft.terms(kind, z_own + h, event), aft.terms(kind, z_own - h, event)
            assert np.allclose(first, (up[0] - down[0]) / (2 * h), rtol=1e-5, atol=1e-6)
            assert np.allclose(second, (up[1] - down[1]) / (2 * h), rtol=1e-5, atol=1e-6)


def test_missing_inputs_unusable_rows_and_no_event(spark):
    schema = "a double, duration double, event boolean"
    rows = [(float(i % 5) if i % 4 else None, float(1 + i % 7), i % 3 != 0) for i in range(60)]
    frame = spark.createDataFrame([*rows, (1.0, 0.0, True), (1.0, None, True), (1.0, 2.0, None)], schema)
    model = aft.fit_newton(frame, "normal", ("a",), ("a",))
    same = aft.fit_newton(spark.createDataFrame(rows, schema), "normal", ("a",), ("a",))
    assert np.allclose(model.coefficients, same.coefficients, atol=1e-9) and len(model.coefficients) == 2
    with pytest.raises(ValueError, match="event"):
        aft.fit_newton(spark.createDataFrame([(1.0, 2.0, False)], schema), "normal", ("a",), ())


# --- product targets --------------------------------------------------------------------------------------------------

LABEL = "product_id string, origin_on date, label_state string, target_on date, target_gap_days int, target_quantity bigint"


def label(product, day, gap, quantity=2):
    known = gap is not None
    return product, DAY + timedelta(day), "observed" if known else "no_target", DAY + timedelta(day + gap) if known else None, gap, quantity if known else None


def test_targets_of_the_same_or_a_later_day_are_unknown(spark):
    rows = [label("p", 0, 3, 4), label("p", 1, 2, 8), label("p", 3, 1), label("p", 4, None), label("q", 4, None), label(None, 4, None)]
    got = {(r["product_id"], (r["origin_on"] - DAY).days): r for r in features.product_targets(spark.createDataFrame(rows, LABEL), 1.0).collect()}
    assert got["p", 3]["product_target_count"] == 0 and got["p", 3]["product_target_gap"] is None  # both targets fall on day 3 itself
    assert got["p", 4]["product_target_count"] == 2 and got["p", 4]["product_target_gap"] == (5 + 2.5) / 3 and got["p", 4]["product_target_quantity"] == (12 + 6) / 3
    assert got["q", 4]["product_target_count"] == 0 and got["q", 4]["product_target_gap"] == 2.5


def test_changing_a_later_outcome_changes_nothing_before_it(spark):
    """Leak test: whatever happens from a day on, statistics up to that day stay."""
    rows = [label(f"p{i % 3}", i % 25, 1 + (i * 7) % 9, 1 + i % 4) for i in range(120)]
    border = DAY + timedelta(15)
    changed = [(p, o, s, t, g + 5 if t >= border else g, 99 if t >= border else q) for p, o, s, t, g, q in rows]
    before, after = ({(r["product_id"], r["origin_on"]): tuple(r)[2:] for r in features.product_targets(spark.createDataFrame(x, LABEL)).collect()} for x in (rows, changed))
    assert before.keys() == after.keys()
    assert all(before[k] == after[k] for k in before if k[1] <= border)
    assert any(before[k] != after[k] for k in before)


def test_products_reach_the_models_as_statistics():
    assert set(models.feature_names("products")) - set(models.feature_names("base")) == set(features.PRODUCT_TARGETS)
    assert not {"product_id", "target_gap_days", "target_quantity"} & set(models.feature_names("everything"))


def test_survival_designs_of_all_groups_come_from_one_pass(spark, monkeypatch):
    designs = []
    monkeypatch.setattr(aft, "stage", lambda df, name: designs.append(df) or stage(df, name))
    rng = random.Random(3)
    rows = [(f"g{i % 3}", rng.random() * (1 + i % 3), rng.randint(1, 9), i % 4 > 0) for i in range(300)]
    train = spark.createDataFrame(rows, "g string, x double, duration int, event boolean")
    fitted = aft.fit_many(train, "g", ("normal",), ("x",), ("x",))
    scans = designs[0]._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("LogicalRDD") + scans.count("LocalRelation") == 1
    for g in ("g0", "g1", "g2"):
        alone = aft.fit_newton(train.filter(F.col("g") == g), "normal", ("x",), ("x",))
        assert fitted[g, "normal"].coefficients == pytest.approx(alone.coefficients) and fitted[g, "normal"].scale == pytest.approx(alone.scale)


def test_only_censored_rows_need_a_tail(monkeypatch):
    asked = []
    hazard = aft.log_normal_hazard
    monkeypatch.setattr(aft, "log_normal_hazard", lambda z: (asked.append(len(z)), hazard(z))[1])
    z, event = np.linspace(-3, 8, 12), np.arange(12) % 3 > 0
    value, first, second = aft.terms("normal", z, event)
    assert asked == [4]
    tail = hazard(z)
    density = -0.5 * z * z - 0.5 * np.log(2 * np.pi)
    assert np.array_equal(value, np.where(event, density, density - np.log(tail))) and np.array_equal(first, np.where(event, -z, -tail))
    assert np.array_equal(second, np.where(event, -1.0, -tail * (tail - z)))
