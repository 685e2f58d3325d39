"""Learned forecasts with Spark ML: two-target trees, specialists, residual quantiles, walk-forward, survival regression.

Driver loops run over targets, folds and cadence classes (configuration-sized), never over rows. Spark's boosted trees
replace the original boosting library: no quantile loss (intervals come from residual quantiles instead) and a Weibull
survival regression instead of boosted normal or logistic ones.
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import AFTSurvivalRegression, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rebuyflow.functions.scalars import half_up_min1, recency_weight
from rebuyflow.operators.cadence import ITEM_FEATURES, PATTERN_FEATURES, group_eligibility
from rebuyflow.operators.features import NUMERIC_FEATURES, PRODUCT_TARGETS, training_window
from rebuyflow.plans.stages import stage

MISSING = -1000.0


@dataclass(frozen=True)
class TreeConfig:
    """Gaps are fitted on absolute, quantities on squared error (`specialist_quantity_loss` for those of a class).

    An absolute loss moves a leaf by at most one step a round, hence a whole day instead of a fraction.
    """
    max_depth: int = 4
    max_rounds: int = 1000
    step: float = 0.1
    absolute_step: float = 1.0
    gap_loss: str = "absolute"
    quantity_loss: str = "squared"
    specialist_quantity_loss: str = "absolute"
    seed: int = 42
    bins: int = 64
    min_instances: int = 10
    patience_tolerance: float = 0.001

    def loss_of(self, target: str, specialist: bool = False) -> str:
        if target == "target_gap_days":
            return self.gap_loss
        return self.specialist_quantity_loss if specialist else self.quantity_loss


# A mode's inputs: the product enters through what was known of it on the day (its buyers, events, mean quantity, speed),
# in "products" and "everything" also through the outcomes of its earlier purchases.
MODES = {"base": (NUMERIC_FEATURES,), "products": (NUMERIC_FEATURES, PRODUCT_TARGETS), "patterns": (NUMERIC_FEATURES, PATTERN_FEATURES),
         "all": (NUMERIC_FEATURES, PATTERN_FEATURES, ITEM_FEATURES), "everything": (NUMERIC_FEATURES, PATTERN_FEATURES, ITEM_FEATURES, PRODUCT_TARGETS)}


def feature_names(mode: str = "base") -> list[str]:
    """Allow-list of model inputs; identifiers and targets can never enter."""
    if mode not in MODES:
        raise ValueError(f"No feature mode {mode}: {sorted(MODES)}")
    return [name for group in MODES[mode] for name in group]


def design(rows: DataFrame, mode: str) -> DataFrame:
    """Rows with `features`; a missing input has a value outside every range."""
    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in feature_names(mode)]
    return rows.withColumn("features", array_to_vector(F.array(*inputs)))


def labelled(rows: DataFrame, mode: str) -> DataFrame:
    """Design of training rows with both targets as doubles; stored, so that both targets' fits read it."""
    return stage(design(rows, mode).withColumns({c: F.col(c).cast("double") for c in ("target_gap_days", "target_quantity")}), "design")


def side_by_side(spark: SparkSession, work, jobs, parallel: int = 4) -> list:
    """Results of independent jobs in their order, a few at a time: one fit alone leaves most of a cluster idle between its short rounds."""
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), jobs))


def _trees(cfg: TreeConfig, label: str, rounds: int, loss: str) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=label, maxDepth=cfg.max_depth, maxIter=rounds, lossType=loss, seed=cfg.seed, maxBins=cfg.bins,
                        stepSize=cfg.absolute_step if loss == "absolute" else cfg.step, minInstancesPerNode=cfg.min_instances, validationTol=cfg.patience_tolerance)


def train_target(inner: DataFrame, pool: DataFrame, label: str, cfg: TreeConfig = TreeConfig(), half_life_days: float | None = None,
                 core_cutoff=None, pool_cutoff=None):
    """Choose the number of rounds on the inner split (`is_early` marks its later part), refit on the whole pool; (model, rounds).

    Both are designs. With a half-life each fit weights its rows by their age at its own cutoff; early rows weigh 1.
    """
    loss = cfg.loss_of(label)
    probe = _trees(cfg, label, cfg.max_rounds, loss).setValidationIndicatorCol("is_early")
    weigh = half_life_days is not None
    if weigh:
        def age(cutoff):
            return recency_weight(F.datediff(F.lit(cutoff).cast("date"), "target_on"), half_life_days)
        inner = inner.withColumn("weight", F.when(F.col("is_early"), 1.0).otherwise(age(core_cutoff)))
        pool = pool.withColumn("weight", age(pool_cutoff))
        probe = probe.setWeightCol("weight")
    rounds = max(1, probe.fit(inner).getNumTrees)
    refit = _trees(cfg, label, rounds, loss)
    return (refit.setWeightCol("weight") if weigh else refit).fit(pool), rounds


def fit_fixed(train: DataFrame, label: str, cfg: TreeConfig, rounds: int, log_target: bool = False, specialist: bool = False):
    """Fixed number of rounds on a design, optionally on log(1 + target)."""
    target = F.col(label).cast("double")
    rows = train.withColumn("label", F.log1p(target) if log_target else target)
    loss = "squared" if log_target else cfg.loss_of(label, specialist)
    return _trees(cfg, "label", rounds, loss).fit(rows)


def predict_values(rows: DataFrame, fitted: dict, mode: str) -> DataFrame:
    """Rows with a forecast per entry, name: (trees, log target); the inputs are assembled once."""
    out = design(rows, mode)
    for name, (trees, log_target) in fitted.items():
        value = F.expm1("prediction") if log_target else F.col("prediction")
        out = trees.transform(out).withColumn(name, value).drop("prediction")
    return out.drop("features")


def predict_value(rows: DataFrame, trees, mode: str, name: str, log_target: bool = False) -> DataFrame:
    return predict_values(rows, {name: (trees, log_target)}, mode)


def two_target(core: DataFrame, early: DataFrame, pool: DataFrame, valid: DataFrame, cfg: TreeConfig = TreeConfig(), mode: str = "base") -> DataFrame:
    """Quantity and gap forecasts of the validation rows: continuous, rounded for the cart, rounded days."""
    inner = labelled(core.withColumn("is_early", F.lit(False)).unionByName(early.withColumn("is_early", F.lit(True))), mode)
    every = labelled(pool, mode)
    for target, name in (("target_quantity", "raw_quantity"), ("target_gap_days", "raw_gap_days")):
        trees, rounds = train_target(inner, every, target, cfg)
        valid = predict_value(valid, trees, mode, name).withColumn(f"{name}_rounds", F.lit(rounds))
    continuous = F.greatest("raw_quantity", F.lit(1.0))
    return (valid.withColumn("predicted_quantity", continuous).withColumn("cart_quantity", half_up_min1(continuous))
            .withColumn("predicted_gap_days", half_up_min1(F.greatest("raw_gap_days", F.lit(1.0)))))


def among(column: Column, values) -> Column:
    """Membership that is false, not NULL, for a missing value."""
    return F.coalesce(column.isin(*values), F.lit(False)) if values else F.lit(False)


def specialists(train: DataFrame, valid: DataFrame, group_col: str, cfg: TreeConfig, rounds: int, mode: str = "all",
                minimum_rows: int = 200, minimum_customers: int = 30) -> DataFrame:
    """Gap forecast by a model per eligible class; every other class uses the model of all rows."""
    train = labelled(train, mode)
    eligible = sorted(r["customer_group"] for r in group_eligibility(train, group_col, minimum_rows, minimum_customers).filter("eligible").collect())
    routes = {"global": train, **{g: train.filter(F.col(group_col) == g) for g in eligible}}
    fitted = side_by_side(train.sparkSession, lambda route: fit_fixed(routes[route], "target_gap_days", cfg, rounds, specialist=route != "global"), routes)
    parts = []
    for route, trees in zip(routes, fitted):
        mine = F.col(group_col) == route if route != "global" else ~among(F.col(group_col), eligible)
        parts.append(predict_value(valid.filter(mine), trees, mode, "raw_gap_days").withColumn("route", F.lit(route)))
    joined = reduce(lambda a, b: a.unionByName(b), parts)
    return joined.withColumn("predicted_gap_days", half_up_min1(F.col("raw_gap_days")))


def residual_quantiles(calibration: DataFrame, predicted: str, actual: str, group_col: str, minimum: int = 50) -> DataFrame:
    """25/50/75 % residual quantiles per class, and overall (class NULL) for classes with too few rows."""
    rows = calibration.withColumn("residual", F.round(F.col(actual) - F.col(predicted)))  # whole days: few distinct values
    grouped = rows.groupingSets([[F.col(group_col)], []], F.col(group_col)).agg(
        F.grouping(group_col).alias("overall"), F.count("*").alias("n"),
        *[F.percentile("residual", F.lit(q)).alias(f"r{int(q * 100)}") for q in (0.25, 0.5, 0.75)])
    return grouped.filter((F.col("overall") == 1) | (F.col("n") >= minimum))


def with_gap_quantiles(rows: DataFrame, residuals: DataFrame, point: str, group_col: str) -> DataFrame:
    """Gap quantiles around the point forecast; the class's residuals, else the overall ones."""
    residuals = stage(residuals, "residuals")  # one row per class
    own = residuals.filter("overall = 0").select(group_col, *[F.col(f"r{q}").alias(f"own{q}") for q in (25, 50, 75)])
    every = residuals.filter("overall = 1").select(*[F.col(f"r{q}") for q in (25, 50, 75)]).withColumn("section", F.lit("all"))
    joined = rows.withColumn("section", F.lit("all")).join(F.broadcast(every), "section").join(F.broadcast(own), group_col, "left")
    return joined.withColumns({f"gap_q{q}": F.greatest(F.lit(1.0), F.col(point) + F.coalesce(f"own{q}", f"r{q}")) for q in (25, 50, 75)}).drop(
        "section", *[f"r{q}" for q in (25, 50, 75)], *[f"own{q}" for q in (25, 50, 75)])


def walk_forward(origins: DataFrame, folds, window_days: int, horizon_days: int, cfg: TreeConfig, rounds: int, mode: str = "base",
                 keep_training=None, candidate: str = "train_all") -> DataFrame:
    """Refit per fold on its mature window and forecast its origins; one long table over all folds.

    `keep_training` filters the training rows only (minimum history, regular history, exceptional period), so that
    variants are scored on the same origins. The fits of folds and targets run side by side.
    """
    train = {}
    for fold in folds:
        rows = training_window(origins, fold.train_end, window_days, horizon_days)
        train[fold.fold] = labelled(rows if keep_training is None else rows.filter(keep_training), mode)
    targets = {"raw_gap_days": "target_gap_days", "raw_quantity": "target_quantity"}
    jobs = [(fold.fold, name) for fold in folds for name in targets]
    trees = dict(zip(jobs, side_by_side(origins.sparkSession, lambda job: fit_fixed(train[job[0]], targets[job[1]], cfg, rounds), jobs)))
    parts = []
    for fold in folds:
        valid = origins.filter(F.col("origin_on").between(F.lit(fold.origin_start), F.lit(fold.origin_end)))
        valid = predict_values(valid, {name: (trees[fold.fold, name], False) for name in targets}, mode)
        parts.append(valid.withColumn("fold", F.lit(fold.fold)))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return (rows.withColumn("candidate", F.lit(candidate)).withColumn("predicted_gap_days", half_up_min1(F.col("raw_gap_days")))
            .withColumn("cart_quantity", half_up_min1(F.col("raw_quantity"))))


def fit_aft(train: DataFrame, censor_event: str = "event", duration: str = "duration") -> PipelineModel:
    """Weibull survival regression on imputed, scaled numeric features with missing flags."""
    imputed = [f"im_{c}" for c in NUMERIC_FEATURES]
    stages = [Imputer(inputCols=[f"nu_{c}" for c in NUMERIC_FEATURES], outputCols=imputed, strategy="mean"),
              VectorAssembler(inputCols=[*imputed, *[f"no_{c}" for c in ("gap_last_days", "gap_mean_days", "gap_median_days")]], outputCol="raw"),
              StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
              AFTSurvivalRegression(featuresCol="features", labelCol="label", censorCol="censor", maxIter=50)]
    rows = aft_inputs(train).withColumn("label", F.col(duration).cast("double")).withColumn("censor", F.col(censor_event).cast("double"))
    return Pipeline(stages=stages).fit(rows)


def aft_inputs(rows: DataFrame) -> DataFrame:
    flags = {f"no_{c}": F.col(c).isNull().cast("double") for c in ("gap_last_days", "gap_mean_days", "gap_median_days")}
    return rows.withColumns({f"nu_{c}": F.col(c).cast("double") for c in NUMERIC_FEATURES}).withColumns(flags)


def predict_aft(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Log-time location `margin` and the model's scale, as `aft_log_survival` expects them."""
    keep = rows.columns
    out = model.transform(aft_inputs(rows))
    return out.select(*keep, F.log("prediction").alias("margin"), F.lit(float(model.stages[-1].scale)).alias("aft_scale"))
