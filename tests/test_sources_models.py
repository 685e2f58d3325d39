"""Readers, writers and model jobs on small inputs."""
import random
import threading
from datetime import date, timedelta

import pytest
from helpers import by, events
from pyspark.sql import functions as F

from rebuyflow.config import Fold
from rebuyflow.operators import cadence, features, ingest, models
from rebuyflow.operators.events import sequence
from rebuyflow.operators.schedule import relative_iqr
from rebuyflow.plans.ordering import with_positions
from rebuyflow.plans.stages import stage
from rebuyflow.schemas import require_columns
from rebuyflow.sources import readers, sinks


def test_store_rhythm_file(spark, tmp_path):
    path = tmp_path / "rhythm.csv"
    path.write_text("customer_id,product_id,cart_on,cart_quantity\nc,p,2026-01-05,3.0\nc,q,,2\nd,p,2026-01-07,\n")
    rows = readers.read_store_rhythm(spark, str(path))
    assert by(rows, "customer_id", "product_id", "cart_on", "cart_quantity") == {"c": ("p", date(2026, 1, 5), 3), "d": ("p", date(2026, 1, 7), None)}


def test_line_breaks_in_quotes_are_read_by_default(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n')
    rows = [("1", "x\ny"), ("2", "z")]
    assert [tuple(r) for r in readers.read_text_csv(spark, str(path), ["a", "b"]).collect()] == rows
    flagged = readers.read_text_csv(spark, str(path), ["a", "b"], strict=False).cache()
    assert readers.corrupt_rows(flagged).count() == 0 and [tuple(r)[:2] for r in flagged.collect()] == rows


def test_timestamps_without_zone_are_utc(spark):
    df = spark.createDataFrame([("2026-05-01 01:00:00",), ("2026-05-01 01:00:00 UTC",), ("2026-05-01T10:00:00+09:00",)], "t string")
    assert {str(r["t"]) for r in df.select(ingest.as_utc(F.col("t")).cast("string").alias("t")).collect()} == {"2026-05-01 01:00:00"}


def test_shards_are_disjoint_and_complete(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("order_id"))
    parts = [readers.shard(df, "order_id", 3, i) for i in range(3)]
    assert sum(p.count() for p in parts) == 1000 and parts[0].join(parts[1], "order_id").count() == 0
    with pytest.raises(ValueError):
        readers.shard(df, "order_id", 3, 3)


def test_role_tables(spark, folder):
    df = spark.createDataFrame([("a", "train_core", True), ("b", "validation", False), ("c", "early_stop", True)], "origin_event_id string, fit_role string, train_pool boolean")
    sinks.write_role_tables(df, folder + "/roles")
    assert spark.read.parquet(folder + "/roles/train_pool").count() == 2
    assert spark.read.parquet(folder + "/roles/origins").filter("fit_role = 'validation'").count() == 1


def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b", "c"])


def test_relative_spread(spark):
    row = spark.range(1).select(relative_iqr(F.lit(4.0), F.lit(8.0), F.lit(12.0)).alias("a"), relative_iqr(F.lit(0.0), F.lit(0.5), F.lit(2.0)).alias("b")).first()
    assert (row["a"], row["b"]) == (1.0, 2.0)


@pytest.fixture(scope="module")
def origins(spark):
    """Pairs with a fixed rhythm per product, so a model can learn it."""
    rng, rows = random.Random(2), []
    for c in range(30):
        for p, gap in (("a", 5), ("b", 10), ("c", 15)):
            day = rng.randint(0, 5)
            while day < 120:
                rows.append((f"{c}-{p}-{day:03d}", f"c{c}", p, str(date(2026, 1, 1) + timedelta(days=day)), "completed", 1 + (p == "b") * 4))
                day += gap
    hist = stage(features.history(sequence(events(spark, rows))), "history")
    return stage(cadence.enriched_origins(hist), "enriched")


CFG = models.TreeConfig(max_depth=3, max_rounds=6, step=0.5)


def error(rows, predicted="predicted_gap_days"):
    return rows.agg(F.avg(F.abs(F.col(predicted) - F.col("target_gap_days"))).alias("e")).first()["e"]


def test_two_target_training_learns_the_rhythm(spark, origins):
    seen = origins.filter("label_state = 'observed'")
    core, early, valid = (seen.filter(c) for c in ("origin_on < '2026-02-15'", "origin_on BETWEEN '2026-02-15' AND '2026-03-01'", "origin_on > '2026-03-01'"))
    out = models.two_target(core, early, core.unionByName(early), valid, CFG)
    assert out.count() == valid.count() and error(out) < 1.0
    assert out.agg(F.avg(F.abs(F.col("cart_quantity") - F.col("target_quantity"))).alias("e")).first()["e"] < 0.5


def test_log_target_and_unknown_product(spark, origins):
    seen = origins.filter("label_state = 'observed'")
    trees = models.fit_fixed(models.labelled(seen, "base"), "target_gap_days", CFG, 5, log_target=True)
    unknown = seen.limit(5).withColumn("product_id", F.lit("never seen"))
    out = models.predict_value(unknown, trees, "base", "gap", log_target=True)
    assert out.count() == 5 and out.filter("gap IS NULL OR gap <= 0").count() == 0
    assert error(models.predict_value(seen, trees, "base", "gap", True), "gap") < 1.5


def test_specialists_fall_back_to_the_global_model(spark, origins):
    seen = origins.filter("label_state = 'observed'")
    out = models.specialists(seen.filter("origin_on < '2026-03-01'"), seen.filter("origin_on >= '2026-03-01'"), "pair_group", CFG, 3, minimum_rows=50, minimum_customers=5)
    routes = {(r["pair_group"], r["route"]) for r in out.select("pair_group", "route").distinct().collect()}
    assert ("insufficient", "insufficient") not in routes and ("stable", "stable") in routes
    assert out.count() == seen.filter("origin_on >= '2026-03-01'").count()


def test_residual_quantiles_back_off(spark):
    rows = spark.createDataFrame([("a", 10.0, 10 + i % 5) for i in range(100)] + [("b", 10.0, 12)], "g string, p double, t int")
    res = models.residual_quantiles(rows, "p", "t", "g", 50)
    out = models.with_gap_quantiles(rows.select("g", "p").distinct(), res, "p", "g")
    got = by(out, "g", "gap_q25", "gap_q50", "gap_q75")
    assert got["a"] == (11.0, 12.0, 13.0) and got["b"][1] == 12.0


def test_feature_allow_list_has_no_identity_or_target():
    names = models.feature_names("all")
    assert len(names) == len(set(names)) == 63
    assert not {"customer_id", "origin_event_id"} & set(names) and not any(n.startswith("target") for n in names)


def test_the_last_row_of_the_rhythm_file_wins(spark, tmp_path):
    path = tmp_path / "rhythm.csv"
    lines = [f"c{i % 7},p,2026-01-{28 - i % 28:02d},{i}" for i in range(2000)] + ["c0,p,,9"]
    path.write_text("customer_id,product_id,cart_on,cart_quantity\n" + "\n".join(lines) + "\n")
    want = {f"c{i % 7}": i for i in range(2000)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits of one file
    try:
        assert by(readers.read_store_rhythm(spark, str(path)), "customer_id", "cart_quantity") == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_positions_number_all_rows_in_order(spark):
    values = [None, "b", "a", "c", "a", "d"] * 50
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int").repartition(7)
    got = [(r["position"], r["v"], r["i"]) for r in with_positions(df, ["v", "i"]).collect()]
    ordered = sorted(enumerate(values), key=lambda x: (x[1] is not None, x[1] or "", x[0]))
    assert sorted(got) == [(k, v, i) for k, (i, v) in enumerate(ordered, 1)]
    assert with_positions(df.limit(0), ["v"]).count() == 0


def test_folds_and_classes_are_fitted_side_by_side_as_on_their_own(spark, origins, monkeypatch):
    folds = [Fold("a", date(2026, 2, 10), date(2026, 2, 11), date(2026, 2, 20)), Fold("b", date(2026, 2, 25), date(2026, 2, 26), date(2026, 3, 10))]
    fit, meet = models.fit_fixed, threading.Barrier(2, timeout=120)
    stored = stage(origins, "origins")
    out = {}
    for name in ("together", "alone"):
        monkeypatch.setattr(models, "fit_fixed", (lambda *a, **k: (meet.wait(), fit(*a, **k))[1]) if name == "together" else fit)
        monkeypatch.setattr(models, "side_by_side", models.side_by_side if name == "together" else (lambda spark, work, jobs, parallel=4: [work(j) for j in jobs]))
        rows = models.walk_forward(stored, folds, 40, 21, CFG, 3)
        out[name] = sorted(map(tuple, rows.select("fold", "origin_event_id", "predicted_gap_days", "cart_quantity").collect()))
    assert out["together"] == out["alone"] and {r[0] for r in out["alone"]} == {"a", "b"}
