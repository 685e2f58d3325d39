"""Hand-worked values of the scalar, calendar and gap functions."""
import hashlib
import json
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from rebuyflow.functions import calendar as c
from rebuyflow.functions.gaps import profile, two_type
from rebuyflow.functions.scalars import ab_bucket, half_even, half_up_min1, list_key, median_of, pstdev_of, quantile_of, variation_of
from rebuyflow.functions.survival import aft_log_survival, conditional_probability


def values(spark, schema, rows, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[col.alias(name) for name, col in columns.items()]).collect()]


def test_two_roundings(spark):
    got = values(spark, "x double", [(0.2,), (1.5,), (2.5,), (3.49,)], up=half_up_min1(F.col("x")), even=half_even(F.col("x")))
    assert got == [(1, 0), (2, 2), (3, 2), (3, 3)]


def test_short_array_statistics_match_python(spark):
    lists = [[7, 7, 8, 7, 7, 8], [2, 60, 2, 60], [5], [3, 5, 4]]
    got = values(spark, "g array<int>", [(g,) for g in lists], m=median_of(F.col("g")), s=pstdev_of(F.col("g")), v=variation_of(F.col("g")),
                 q=quantile_of(F.col("g"), 0.25))
    for g, (m, s, v, q) in zip(lists, got):
        assert m == statistics.median(g)
        assert s == pytest.approx(statistics.pstdev(g))
        assert v == pytest.approx(statistics.pstdev(g) / statistics.mean(g))
        ordered, pos = sorted(g), (len(g) - 1) * 0.25
        low = int(pos)
        high = min(low + 1, len(g) - 1)
        assert q == pytest.approx(ordered[low] + (ordered[high] - ordered[low]) * (pos - low))


def test_boundary_variation_is_exact(spark):
    # squares are summed as whole numbers, so a value on the class limit stays on it
    (v,), = values(spark, "g array<int>", [([3, 1, 3, 1],)], v=variation_of(F.col("g")))
    assert v == 0.5


def test_keys_match_json_digest(spark):
    rows = [("a", "p", "2026-05-01"), ('quote"d', "back\\slash", "x"), ("", "한글", '","'), ("line\nbreak", "tab\t", "é")]
    got = values(spark, "a string, b string, c string", rows, k=list_key(F.col("a"), F.col("b"), F.col("c")))
    for row, (key,) in zip(rows, got):
        assert key == hashlib.sha256(json.dumps(list(row), ensure_ascii=False).encode()).hexdigest()


def test_assignment_bucket_is_the_digest_modulo_100(spark):
    ids = [f"m{i}" for i in range(300)]
    got = values(spark, "id string", [(i,) for i in ids], b=ab_bucket(F.col("id")))
    assert [b for b, in got] == [int(hashlib.sha256(i.encode()).hexdigest(), 16) % 100 for i in ids]
    holdout = spark.range(20000).filter(ab_bucket(F.col("id").cast("string")) < 5).count() / 20000
    assert 0.04 < holdout < 0.06


@pytest.mark.parametrize("gaps, expected", [
    ([7, 7, 8, 7, 7, 8], "stable"), ([30, 25, 20, 15, 10, 5], "speeding_up"), ([5, 10, 15, 20, 25, 30], "slowing_down"),
    ([30, 20, 10, 5, 15, 25], "rebound"), ([2, 60, 2, 60, 2, 60], "irregular"), ([7, 7, 7], "insufficient"), ([], "insufficient")])
def test_cadence_classes(spark, gaps, expected):
    df = spark.createDataFrame([(gaps,)], "g array<int>")
    assert df.select(profile(F.col("g"))["group"].alias("x")).first()["x"] == expected


def test_two_type_rule_tolerates_a_long_gap(spark):
    got = values(spark, "g array<int>", [([14, 14, 14, 28],), ([14, 14, 60, 40],), ([1, 2],)], t=two_type(F.col("g")))
    assert [t for t, in got] == ["regular", "irregular", "insufficient"]


def _weekly(spark, predicted, available):
    df = spark.createDataFrame([(date.fromisoformat(predicted), available)], "p date, a string")
    return df.select(F.date_format(c.weekly_release(F.col("p"), F.col("a").cast("timestamp_ntz"), 22), "yyyy-MM-dd HH:mm").alias("r")).first()["r"]


def test_weekly_release_calendar(spark):
    for day in range(5, 12):
        assert _weekly(spark, f"2026-10-{day:02d}", "2026-01-01 00:00:00") == "2026-09-27 22:00"
    assert _weekly(spark, "2027-01-01", "2026-01-01 00:00:00") == "2026-12-20 22:00"
    assert _weekly(spark, "2026-10-08", "2026-10-01 00:00:00") == "2026-10-04 22:00"
    assert _weekly(spark, "2026-10-02", "2026-10-01 00:00:00") == "2026-10-01 00:00"
    assert _weekly(spark, "2026-10-08", "2026-10-05 10:00:00") == "2026-10-05 10:00"
    assert _weekly(spark, "2026-10-08", "2026-10-04 23:00:00") == "2026-10-04 23:00"


@pytest.mark.parametrize("origin, gap, limit, cart, order", [
    ("2026-09-14", 24, 0, "2026-09-27 22:00", "2026-09-28"), ("2026-09-16", 4, 0, "2026-09-17 00:00", "2026-09-17"),
    ("2026-09-16", 4, 7, "2026-09-20 22:00", "2026-09-21"), ("2026-09-19", 7, 7, "2026-09-20 22:00", "2026-09-21"),
    ("2026-09-20", 7, 7, "2026-09-21 00:00", "2026-09-21"), ("2026-09-14", 24, 7, "2026-09-27 22:00", "2026-09-28")])
def test_weekly_cart(spark, origin, gap, limit, cart, order):
    df = spark.createDataFrame([(date.fromisoformat(origin), gap)], "o date, g int").select(c.weekly_cart(F.col("o"), F.col("g"), 22, limit).alias("at"))
    row = df.select(F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"), c.order_day(F.col("at")).cast("string").alias("day")).first()
    assert (row["at"], row["day"]) == (cart, order)


def test_extra_lead_is_clamped(spark):
    got = values(spark, "g int", [(10,), (24,), (30,), (47,), (120,)], fixed=c.extra_lead(F.col("g"), "fixed"), part=c.extra_lead(F.col("g")))
    assert got == [(0, 0), (0, 0), (0, 2), (0, 7), (0, 7)]
    with pytest.raises(ValueError):
        c.extra_lead(F.col("g"), "linear")


def test_pull_forward_limits_and_ignores_later_rhythm(spark):
    rows = [("2026-10-12", "2026-10-11 22:00:00", "2026-10-20", "2026-09-01 00:00:00"),   # later rhythm
            ("2026-10-12", "2026-10-11 22:00:00", "2026-09-01", "2026-08-01 00:00:00"),   # at most a week
            ("2026-10-12", "2026-10-11 22:00:00", "2026-10-08", "2026-10-11 23:00:00")]   # not before availability
    df = spark.createDataFrame(rows, "d string, at string, r string, av string")
    at = lambda n: F.col(n).cast("timestamp_ntz")
    p = c.pull_forward(F.to_date("d"), at("at"), F.to_date("r"), at("av"), 22)
    got = df.select(p.alias("p")).select(F.col("p.cart_on").cast("string"), F.date_format("p.cart_at", "yyyy-MM-dd HH:mm"), "p.pulled").collect()
    assert [tuple(r) for r in got] == [("2026-10-12", "2026-10-11 22:00", False), ("2026-10-05", "2026-10-04 22:00", True), ("2026-10-12", "2026-10-11 22:00", False)]


def test_policy_gaps(spark):
    got = values(spark, "g bigint", [(5,), (20,), (60,)], **{p: c.policy_gap(F.col("g"), F.lit(p)) for p in c.CART_POLICIES})
    assert got == [(5, 1, 1, 3), (20, 13, 10, 15), (60, 53, 50, 53)]


def test_survival_functions(spark):
    df = spark.createDataFrame([(3.0,)], "mu double")
    log = lambda t, kind: aft_log_survival(F.col("mu"), F.lit(t), kind, 1.0)
    row = df.select(conditional_probability(log(0, "logistic"), log(7, "logistic")).alias("a"),
                    conditional_probability(log(7, "normal"), log(14, "normal")).alias("b"), F.exp(log(60, "normal")).alias("s")).first()
    import math
    tail = lambda t: 0.5 * math.erfc(((math.log(t) - 3) / 1) / math.sqrt(2))
    assert row["a"] == pytest.approx(1 - 1 / (1 + math.exp(math.log(7) - 3)))
    assert row["b"] == pytest.approx(1 - tail(14) / tail(7))
    assert row["s"] == pytest.approx(tail(60))
    with pytest.raises(ValueError):
        aft_log_survival(F.col("mu"), F.lit(1), "normal", 0.0)
