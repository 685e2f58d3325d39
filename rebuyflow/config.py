"""Parameters of the jobs. Defaults are fixed values of the forecasting contract."""
from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta


@dataclass(frozen=True)
class SplitConfig:
    """Calendar split anchored on the origin purchase day."""

    start: date = date(2026, 4, 9)
    train_core_end: date = date(2026, 6, 23)
    train_end: date = date(2026, 7, 13)
    validation_end: date = date(2026, 8, 14)
    test_end: date = date(2026, 9, 15)

    def __post_init__(self):
        if not self.start <= self.train_core_end < self.train_end < self.validation_end < self.test_end:
            raise ValueError("Calendar boundaries must ascend: start, train core, train, validation, test")


@dataclass(frozen=True)
class CadenceConfig:
    """Thresholds of the recent-gap classes and of item speed."""

    minimum_gaps: int = 4
    recent_gaps: int = 6
    stable_cv_max: float = 0.25
    trend_change_min: float = 0.3
    trend_direction_min: float = 0.75
    product_recent_intervals: int = 100
    minimum_product_intervals: int = 20
    minimum_product_customers: int = 5


@dataclass(frozen=True)
class VisitConfig:
    """Customer visit rhythm: last gaps, irregularity limit, upper day bounds."""

    minimum_gaps: int = 3
    recent_gaps: int = 5
    irregular_cv_above: float = 0.75
    upper_bounds_days: tuple[int, ...] = (14, 30, 60)


@dataclass(frozen=True)
class RegularityConfig:
    """Pair regularity from the coefficient of variation of its last gaps."""

    minimum_gaps: int = 3
    recent_gaps: int = 5
    maximum_cv: float = 0.5


@dataclass(frozen=True)
class RouterConfig:
    route_unit: str = "pair"
    switch_window: int = 3
    switch_min_votes: int = 2
    max_relative_iqr: float = 1.0
    late_guard: bool = False
    skip_first_purchase: bool = True
    second_purchase_last_gap: bool = False
    weekly_release_hour: int = 22
    weekly_buyer_max_gap_days: int = 7
    monitoring_days: int = 45
    minimum_group_rows: int = 100
    minimum_group_customers: int = 20

    def __post_init__(self):
        if self.route_unit not in ("pair", "customer"):
            raise ValueError("Route unit is pair or customer")
        if not 0 <= self.weekly_release_hour <= 23:
            raise ValueError("Release hour is 0..23")


@dataclass(frozen=True)
class ScheduleConfig:
    """Production profile of the daily schedule."""

    first_purchase: str = "item_median"
    second_purchase: str = "last_gap"
    schedule: str = "days_before"
    lead_policy: str = "proportional"
    adjustment_mode: str = "ratchet"
    adjustment_cap_days: int = 21
    notify_hour: int = 9
    base_lead_days: int = 7
    max_pull_days: int = 7
    model_version: str = "baseline-v1"
    router: RouterConfig = field(default_factory=RouterConfig)

    def __post_init__(self):
        if self.first_purchase not in ("skip", "item_median") or self.second_purchase not in ("model", "last_gap"):
            raise ValueError("Unknown short-history rule")
        if self.schedule not in ("weekly_monday", "days_before"):
            raise ValueError("Unknown schedule")
        if self.lead_policy not in ("fixed", "proportional"):
            raise ValueError("Unknown lead policy")
        if self.adjustment_mode not in ("median", "ratchet") or self.adjustment_cap_days < 0:
            raise ValueError("Unknown adjustment mode or negative cap")


@dataclass(frozen=True)
class Fold:
    """One walk-forward fold."""

    fold: str
    train_end: date
    origin_start: date
    origin_end: date


def monthly_folds(first_month: date, months: int) -> tuple[Fold, ...]:
    """Consecutive monthly folds, each trained up to the day before its first origin."""
    folds, start = [], first_month.replace(day=1)
    for _ in range(months):
        following = (start + timedelta(days=32)).replace(day=1)
        folds.append(Fold(start.strftime("%Y-%m"), start - timedelta(days=1), start, following - timedelta(days=1)))
        start = following
    return tuple(folds)
