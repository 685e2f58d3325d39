"""Classes of a short list of recent purchase gaps (at most six numbers, oldest first)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rebuyflow.config import CadenceConfig
from rebuyflow.functions.scalars import median_of, variation_of

# Cadence classes in display order.
GROUPS = ("insufficient", "irregular", "rebound", "speeding_up", "slowing_down", "stable")


def _steps(gaps: Column) -> Column:
    n = F.size(gaps)
    later = F.slice(gaps, F.lit(2), F.greatest(n - 1, F.lit(0)))
    earlier = F.slice(gaps, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(later, earlier, lambda b, a: b - a)


def _share(steps: Column, keep) -> Column:
    return F.when(F.size(steps) > 0, F.size(F.filter(steps, keep)) / F.size(steps)).otherwise(F.lit(0.0))


def _is_rebound(gaps: Column, steps: Column, typical: Column, threshold: float) -> Column:
    """A dip: falls to an inner trough, then rises, both sides by the threshold of the median."""
    n = F.size(gaps)
    low = F.array_min(gaps)
    trough = (F.array_position(gaps, low) - 1).cast("int")
    first, last = F.element_at(gaps, 1), F.element_at(gaps, -1)
    shaped = F.forall(
        F.transform(steps, lambda d, i: F.when(i < trough, d <= 0).otherwise(d >= 0)), lambda ok: ok)
    return ((n >= 5) & (trough > 1) & (trough < n - 2)
            & ((first - low) / typical >= threshold) & ((last - low) / typical >= threshold) & shaped)


def profile(gaps: Column, cfg: CadenceConfig = CadenceConfig()) -> dict[str, Column]:
    """Count, last, median, variation, relative change, direction shares and class of recent gaps."""
    n = F.size(gaps)
    some = n > 0
    typical = median_of(gaps)
    steps = _steps(gaps)
    last = F.when(some, F.element_at(gaps, -1))
    relative = F.when(some, (F.element_at(gaps, -1) - F.element_at(gaps, 1)) / typical)
    cv = variation_of(gaps)
    down = _share(steps, lambda d: d < 0)
    up = _share(steps, lambda d: d > 0)
    group = (F.when(n < cfg.minimum_gaps, "insufficient")
             .when(_is_rebound(gaps, steps, typical, cfg.trend_change_min), "rebound")
             .when((relative <= -cfg.trend_change_min) & (down >= cfg.trend_direction_min), "speeding_up")
             .when((relative >= cfg.trend_change_min) & (up >= cfg.trend_direction_min), "slowing_down")
             .when(cv <= cfg.stable_cv_max, "stable").otherwise("irregular"))
    return {"group": group, "count": n, "last": last, "median": typical, "cv": cv,
            "relative_change": relative, "down_fraction": down, "up_fraction": up}


def two_type(gaps: Column, minimum: int = 4, tolerance_days: int = 7, share: float = 0.75) -> Column:
    """Regular when at least `share` of the recent gaps lie within the tolerance of their median."""
    typical = median_of(gaps)
    near = F.size(F.filter(gaps, lambda g: F.abs(g - typical) <= tolerance_days))
    return (F.when(F.size(gaps) < minimum, "insufficient")
            .when(near / F.size(gaps) >= share, "regular").otherwise("irregular"))
