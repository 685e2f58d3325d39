"""Accelerated-failure-time regression by Newton steps: log T = intercept + x b + scale * error, right-censored.

Models of several groups (folds, training windows) and distributions are fitted together. A round is one aggregate over
all rows: each task adds up log-likelihood, gradient and Hessian of its rows per model, the tasks' sums are added up in
the cluster, and the driver gets one array per model, about p^2 / 2 numbers for p coefficients. The driver solves for the
steps; a step that lowers the likelihood is halved.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebuyflow.operators.features import NUMERIC_FEATURES
from rebuyflow.plans.stages import stage

DISTRIBUTIONS = ("normal", "logistic", "weibull")
FLAGGED = ("gap_last_days", "gap_mean_days", "gap_median_days")


@dataclass(frozen=True)
class AftModel:
    """Coefficients on standardised inputs; `margin` gives the location of log time."""
    distribution: str
    inputs: tuple[str, ...]
    flags: tuple[str, ...]
    means: tuple[float, ...]
    spreads: tuple[float, ...]
    ranges: tuple[tuple[float, float], ...]
    intercept: float
    coefficients: tuple[float, ...]
    scale: float
    log_likelihood: float
    rounds: int

    def margin(self) -> Column:
        x = F.array(*standardised(self.inputs, self.flags, self.means, self.spreads, self.ranges))
        weighted = F.zip_with(x, F.array(*[F.lit(c) for c in self.coefficients]), lambda a, b: a * b)
        return F.aggregate(weighted, F.lit(self.intercept), lambda total, term: total + term)


def _raw(inputs, flags) -> list[Column]:
    return [*[F.col(c).cast("double") for c in inputs], *[F.col(c).isNull().cast("double") for c in flags]]


def standardised(inputs, flags, means, spreads, ranges) -> list[Column]:
    """Inputs and missing flags at mean 0 and spread 1; a missing value is the mean, a constant is left out as 0.

    Values beyond the range of the training rows are moved to its ends: a linear model must not run on where counters grow.
    """
    def one(x, mean, spread, low, high):
        return F.coalesce((F.least(F.greatest(x, F.lit(low)), F.lit(high)) - F.lit(mean)) / F.lit(spread), F.lit(0.0))
    return [F.when(x.isNotNull(), one(x, m, s, lo, hi)).otherwise(F.lit(0.0)) if s > 0 else F.lit(0.0) for x, m, s, (lo, hi) in zip(_raw(inputs, flags), means, spreads, ranges)]


def log_normal_hazard(z: np.ndarray) -> np.ndarray:
    """Density over tail of a standard normal, by its continued fraction where the tail is small."""
    near = np.minimum(z, 5.0)
    tail = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in near.tolist()])
    out = np.exp(-0.5 * near * near) / math.sqrt(2 * math.pi) / tail
    far = z > 5.0
    if far.any():
        value = z[far].copy()
        for k in range(60, 0, -1):
            value = z[far] + k / value
        out[far] = value
    return out


def terms(distribution: str, z: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of standardised residuals (without the log scale) and its first two derivatives in z."""
    if distribution == "normal":
        density = -0.5 * z * z - 0.5 * math.log(2 * math.pi)
        value, first, second = density, -z, np.full(len(z), -1.0)
        hazard = log_normal_hazard(z[~event])  # only a censored row has a tail
        value[~event] -= np.log(hazard)
        first[~event] = -hazard
        second[~event] = -hazard * (hazard - z[~event])
        return value, first, second
    if distribution == "logistic":
        p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
        tail = -(np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))))
        return np.where(event, z + 2 * tail, tail), np.where(event, 1 - 2 * p, -p), np.where(event, -2, -1) * p * (1 - p)
    if distribution == "weibull":
        e = np.exp(np.minimum(z, 700))
        return np.where(event, z - e, -e), np.where(event, 1 - e, -e), -e
    raise ValueError(f"No distribution {distribution}: {DISTRIBUTIONS}")


def sums(distribution: str, theta: np.ndarray, x: np.ndarray, log_time: np.ndarray, event: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient and Hessian in (intercept, coefficients, log scale), flat."""
    scale = math.exp(theta[-1])
    design = np.column_stack([np.ones(len(x)), x])
    z = (log_time - design @ theta[:-1]) / scale
    value, first, second = terms(distribution, z, event)
    gradient = np.append(-(first / scale) @ design, -(first * z).sum() - event.sum())
    inner = (design * (second / scale ** 2)[:, None]).T @ design
    cross = ((second * z + first) / scale) @ design
    hessian = np.block([[inner, cross[:, None]], [cross[None, :], np.array([[(second * z * z + first * z).sum()]])]])
    return np.concatenate([[value.sum() - event.sum() * theta[-1]], gradient, hessian[np.triu_indices(len(theta))]])


def _round(rows: DataFrame, asked: dict[tuple[str, str], np.ndarray]) -> dict[tuple[str, str], tuple[float, np.ndarray, np.ndarray]]:
    """One aggregate over the rows (key, x, log_time, event): value, gradient and Hessian of each (key, distribution)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            time, event = batch.column("log_time").to_numpy(), batch.column("event").to_numpy(zero_copy_only=False).astype(bool)
            for (key, kind), theta in asked.items():
                mine = keys == key
                if mine.any():
                    total[key, kind] = total.get((key, kind), 0) + sums(kind, theta, x[mine], time[mine], event[mine])
        for (key, kind), own in total.items():
            yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(own)), "kind": pa.array([kind] * len(own)), "entry": pa.array(range(len(own)), pa.int32()), "value": pa.array(own)})

    added = rows.mapInArrow(add, "key string, kind string, entry int, value double").groupBy("key", "kind", "entry").agg(F.sum("value").alias("value"))
    out = {}
    for r in added.groupBy("key", "kind").agg(F.sort_array(F.collect_list(F.struct("entry", "value")))["value"].alias("flat")).collect():
        flat, p = np.array(r["flat"]), len(asked[r["key"], r["kind"]])
        hessian = np.zeros((p, p))
        hessian[np.triu_indices(p)] = flat[1 + p:]
        out[r["key"], r["kind"]] = flat[0], flat[1:1 + p], hessian + np.triu(hessian, 1).T
    return out


def _step(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Newton step uphill; a Hessian that is not negative definite, or nearly singular, gets a ridge."""
    ridge, size = 0.0, max(1.0, float(np.abs(np.diag(hessian)).max()))
    while True:
        try:
            lower = np.linalg.cholesky(-hessian + ridge * np.eye(len(gradient)))
            return np.linalg.solve(lower.T, np.linalg.solve(lower, gradient))
        except np.linalg.LinAlgError:
            ridge = max(1e-10 * size, 10 * ridge)


def fit_many(train: DataFrame, key_col: str, kinds=DISTRIBUTIONS, inputs=tuple(NUMERIC_FEATURES), flags=FLAGGED, duration: str = "duration", event: str = "event",
             most_rounds: int = 80, tolerance: float = 1e-9) -> dict[tuple[str, str], AftModel]:
    """Maximum-likelihood fits per group (a few, such as folds) and distribution.

    Rows with a null group, duration or event, or no positive duration, are not used; a group needs an event.
    """
    usable = train.filter((F.col(duration) > 0) & F.col(event).isNotNull() & F.col(key_col).isNotNull()).withColumn("key", F.col(key_col).cast("string"))
    raw, log_time = _raw(inputs, flags), F.log(F.col(duration).cast("double"))
    stats = usable.groupBy("key").agg(F.sum(F.col(event).cast("int")).alias("events"), F.avg(log_time).alias("m"), F.stddev_pop(log_time).alias("s"), F.array(*[F.avg(x) for x in raw]).alias("means"),
                                      F.array(*[F.coalesce(F.stddev_pop(x), F.lit(0.0)) for x in raw]).alias("spreads"),
                                      F.array(*[F.struct(F.coalesce(F.min(x), F.lit(0.0)).alias("low"), F.coalesce(F.max(x), F.lit(0.0)).alias("high")) for x in raw]).alias("ranges")).collect()
    if not stats or not all(r["events"] for r in stats):
        raise ValueError("A survival regression needs at least one event")
    means = {r["key"]: tuple(m or 0.0 for m in r["means"]) for r in stats}
    spreads = {r["key"]: tuple(s if s > 1e-12 else 0.0 for s in r["spreads"]) for r in stats}
    ranges = {r["key"]: tuple((b["low"], b["high"]) for b in r["ranges"]) for r in stats}

    # One pass over the rows: a row is standardised by its own group's figures.
    own = F.coalesce(*[F.when(F.col("key") == key, F.array(*standardised(inputs, flags, means[key], spreads[key], ranges[key]))) for key in means])
    rows = stage(usable.select("key", own.alias("x"), log_time.alias("log_time"), F.col(event).cast("boolean").alias("event")), "aft-design")
    theta = {(r["key"], kind): np.array([r["m"], *[0.0] * len(raw), math.log(max(r["s"] or 0.0, 0.1))]) for r in stats for kind in kinds}
    at = _round(rows, theta)
    steps, open_, rounds = {m: _step(*at[m][1:]) for m in theta}, set(theta), 1
    while open_ and rounds < most_rounds:
        tried = _round(rows, {m: theta[m] + steps[m] for m in open_})
        rounds += 1
        for m in list(open_):
            uphill = np.isfinite(tried[m][0]) and tried[m][0] >= at[m][0] - 1e-9 * abs(at[m][0])
            if uphill:
                theta[m], at[m] = theta[m] + steps[m], tried[m]
            if np.abs(steps[m]).max() < tolerance:
                open_.discard(m)
            steps[m] = _step(*at[m][1:]) if uphill else steps[m] / 2
    return {(key, kind): AftModel(kind, tuple(inputs), tuple(flags), means[key], spreads[key], ranges[key], float(t[0]), tuple(t[1:-1].tolist()), float(math.exp(t[-1])), float(at[key, kind][0]), rounds)
            for (key, kind), t in theta.items()}


def fit_newton(train: DataFrame, distribution: str, inputs=tuple(NUMERIC_FEATURES), flags=FLAGGED, **options) -> AftModel:
    """One fit over all rows."""
    return next(iter(fit_many(train.withColumn("all_rows", F.lit("all")), "all_rows", (distribution,), inputs, flags, **options).values()))
