"""Quantile forecasts from the leaves of a forest.

A tree sorts training rows into leaves; the targets of a leaf are a distribution. A row's forecast distribution is the
mean of its leaves' distributions over the trees, and its quantiles are read from that. Leaves are a small table: trees
x leaves rows, each with a density over the grid of target values (whole days), both bounded by configuration and
calendar. Scored rows are exploded per tree, looked up, and summed again before the shuffle.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebuyflow.operators.models import design
from rebuyflow.plans.stages import stage

QUANTILES = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 40
    max_depth: int = 6
    min_instances: int = 10
    bins: int = 64
    feature_share: str = "onethird"
    seed: int = 42


@dataclass(frozen=True)
class QuantileForest:
    """`leaves`: stored (tree, leaf, density); `grid`: the target values a density refers to, ascending."""
    model: RandomForestRegressionModel
    leaves: DataFrame
    grid: tuple[float, ...]
    mode: str


def _per_tree(rows: DataFrame, model: RandomForestRegressionModel, *keep: str) -> DataFrame:
    """One row per row and tree with its leaf."""
    assigned = model.setLeafCol("leaf_ids").transform(rows)
    return assigned.select(*keep, F.posexplode(vector_to_array("leaf_ids")).alias("tree", "leaf"))


def leaf_densities(assigned: DataFrame, grid: tuple[float, ...], target: str, weight: Column | None = None) -> DataFrame:
    """(tree, leaf, density): share of a leaf's weight per grid value.

    Counted per (tree, leaf, value) before the shuffle, so a leaf that holds most rows is a few dozen sums.
    """
    counts = assigned.groupBy("tree", "leaf", F.col(target).alias("value")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("w"))
    by_value = F.map_from_entries(F.collect_list(F.struct("value", "w")))
    leaves = counts.groupBy("tree", "leaf").agg(F.sum("w").alias("total"), by_value.alias("held"))
    values = F.array(*[F.lit(float(v)) for v in grid])
    return leaves.select("tree", "leaf", F.transform(values, lambda v: F.coalesce(F.try_element_at("held", v), F.lit(0.0)) / F.col("total")).alias("density"))


def fit_quantile_forest(train: DataFrame, target: str, mode: str = "all", cfg: ForestConfig = ForestConfig(), weight_col: str | None = None) -> QuantileForest:
    """Forest on the training rows and the distributions of its leaves, both weighted by `weight_col` if given."""
    rows = design(train, mode).withColumn("label", F.round(F.col(target).cast("double")))
    rows = stage(rows.filter("label IS NOT NULL"), "forest-design")
    forest = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=cfg.trees, maxDepth=cfg.max_depth, minInstancesPerNode=cfg.min_instances,
                                   maxBins=cfg.bins, featureSubsetStrategy=cfg.feature_share, seed=cfg.seed)
    model = (forest.setWeightCol(weight_col) if weight_col else forest).fit(rows)
    grid = tuple(sorted(r["label"] for r in rows.select("label").distinct().collect()))  # whole days: bounded by the calendar
    keep = ["label", *([weight_col] if weight_col else [])]
    leaves = leaf_densities(_per_tree(rows, model, *keep), grid, "label", F.col(weight_col) if weight_col else None)
    return QuantileForest(model, stage(leaves, "forest-leaves"), grid, mode)


def grid_quantile(density: Column, grid: tuple[float, ...], q: float) -> Column:
    """First grid value at which the running share of a density reaches q."""
    start = F.struct(F.lit(0.0).alias("share"), F.lit(None).cast("double").alias("value"))
    pairs = F.zip_with(density, F.array(*[F.lit(float(v)) for v in grid]), lambda d, v: F.struct(d.alias("d"), v.alias("v")))

    def step(state, pair):
        share = state["share"] + pair["d"]
        reached = state["value"].isNull() & (share >= q - 1e-9)
        return F.struct(share.alias("share"), F.when(reached, pair["v"]).otherwise(state["value"]).alias("value"))
    return F.coalesce(F.aggregate(pairs, start, step)["value"], F.lit(float(grid[-1])))


def forecast_densities(rows: DataFrame, forest: QuantileForest, key: str) -> DataFrame:
    """(key, density): the mean of the leaves' densities of each row; a leaf without training rows does not count."""
    assigned = _per_tree(design(rows, forest.mode), forest.model, key)
    looked_up = assigned.join(F.broadcast(forest.leaves.withColumn("density", array_to_vector("density"))), ["tree", "leaf"])  # trees x leaves rows
    return looked_up.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("density"))).alias("density"))


def with_forest_quantiles(rows: DataFrame, forest: QuantileForest, key: str = "origin_event_id", prefix: str = "gap", quantiles=QUANTILES) -> DataFrame:
    """Rows with `{prefix}_q25`, ... from their leaves; `key` must be unique."""
    columns = {f"{prefix}_q{round(100 * q)}": grid_quantile(F.col("density"), forest.grid, q) for q in quantiles}
    return rows.join(forecast_densities(rows, forest, key), key).withColumns(columns).drop("density")


def coverage(rows: DataFrame, by: list[str], actual: str, low: str = "gap_q25", high: str = "gap_q75") -> DataFrame:
    """How often the actual value lies between two quantiles, both included, and the mean width."""
    inside = F.col(actual).between(F.col(low), F.col(high)).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(inside).alias("coverage"), F.avg((F.col(actual) < F.col(low)).cast("double")).alias("below"), F.avg(F.col(high) - F.col(low)).alias("mean_width"))
