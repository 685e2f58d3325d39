"""Release and notification dates. Local wall-clock times are TIMESTAMP_NTZ; instants convert at the edges."""
from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Seoul"


def local_date(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    """Local calendar day of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def within_local_days(instant: Column, start: date, end: date, zone: str = LOCAL_ZONE) -> Column:
    """The instants of local days start..end inclusive, as a range that a scan can prune by."""
    def midnight(day):
        return F.lit(datetime.combine(day, time(), ZoneInfo(zone)).astimezone(timezone.utc))
    return (instant >= midnight(start)) & (instant < midnight(end + timedelta(days=1)))


def at_hour(day: Column, hour: int) -> Column:
    """Wall-clock time on a day."""
    return day.cast("timestamp_ntz") + F.expr(f"INTERVAL {int(hour)} HOURS")


def next_midnight(day: Column) -> Column:
    """When a purchase day's features are complete: the following local midnight."""
    return F.date_add(day, 1).cast("timestamp_ntz")


def to_utc(wall_clock: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall clock of a local wall clock."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall_clock)


def monday_of(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def coming_sunday(day: Column) -> Column:
    """The same day when it is a Sunday, otherwise the next one."""
    return F.date_add(day, F.pmod(F.lit(6) - F.weekday(day), F.lit(7)).cast("int"))


def clipped_lead(predicted: Column, available: Column, lead_days: Column) -> Column:
    """Cart day `lead_days` before the prediction, never before features are available."""
    return F.greatest(F.date_sub(predicted, lead_days), available)


def planned_release(predicted: Column, hour: int) -> Column:
    """Sunday night before the Monday of the week preceding the predicted week."""
    return at_hour(F.date_sub(monday_of(predicted), 8), hour)


def weekly_release(predicted: Column, available: Column, hour: int) -> Column:
    """Feasible release: the planned Sunday, else the next ordering window before the prediction, else at once."""
    planned = planned_release(predicted, hour)
    day = available.cast("date")
    sunday_night = at_hour(coming_sunday(day), hour)
    return (F.when(available <= planned, planned)
            .when(F.weekday(day) == 0, available)
            .when((sunday_night >= available) & (sunday_night < predicted.cast("timestamp_ntz")), sunday_night)
            .otherwise(available))


def order_day(release: Column) -> Column:
    """Ordering day of a release: Monday for a Sunday-night release, otherwise its own day."""
    day = release.cast("date")
    return F.when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def weekly_cart(origin_on: Column, gap: Column, hour: int, weekly_buyer_max_gap: int) -> Column:
    """Release time; weekly buyers wait for the next Sunday night unless Monday has begun."""
    available = next_midnight(origin_on)
    first_day = F.date_add(origin_on, 1)
    weekly = F.when(F.weekday(first_day) == 0, available).otherwise(at_hour(coming_sunday(first_day), hour))
    predicted = F.date_add(origin_on, gap.cast("int"))
    return F.when(gap <= weekly_buyer_max_gap, weekly).otherwise(weekly_release(predicted, available, hour))


def days_before(origin_on: Column, gap: Column, base_lead_days: int = 7) -> Column:
    """Notification day a fixed lead before the prediction, not before the day after purchase."""
    return F.greatest(F.date_add(origin_on, 1), F.date_add(origin_on, (gap - base_lead_days).cast("int")))


def extra_lead(gap: Column, policy: str = "proportional", base: int = 7, share: float = 0.3, most: int = 14) -> Column:
    """Days of lead beyond the base lead: zero, or 30 % of the gap kept within 7..14 days."""
    if policy not in ("fixed", "proportional"):
        raise ValueError(f"Unknown lead policy {policy!r}")
    if policy == "fixed":
        return F.lit(0).cast("bigint")
    wanted = F.bround(gap.cast("double") * F.lit(share), 0).cast("bigint")
    return F.least(F.lit(most), F.greatest(F.lit(base), wanted)).cast("bigint") - F.lit(base)


# The cart lead policies compared in evaluation.
CART_POLICIES = ("none", "lead7", "lead10", "relative25_cap7")


def policy_gap(gap: Column, policy: Column) -> Column:
    """Days from origin to cart under a named lead policy, at earliest the next day."""
    share = F.least(F.lit(7), F.greatest(F.lit(1), F.ceil(gap * F.lit(0.25)))).cast("bigint")
    lead = (F.when(policy == "none", F.lit(0)).when(policy == "lead7", F.lit(7)).when(policy == "lead10", F.lit(10))
            .when(policy == "relative25_cap7", share))
    return F.greatest(F.lit(1), gap - lead).cast("bigint")


def pull_forward(planned_day: Column, cart_at: Column, rhythm_on: Column, available: Column, hour: int,
                 max_days: int = 7) -> Column:
    """Earlier release when an external rhythm forecast is earlier; struct(cart_on, cart_at, pulled).

    The target is at most `max_days` before plan; release is the Sunday strictly before the target, not before
    features are available, and only if it moves the cart earlier.
    """
    target = F.greatest(rhythm_on, F.date_sub(planned_day, max_days))
    back = F.pmod(F.weekday(target) + 1, F.lit(7))
    sunday = F.date_sub(target, F.when(back == 0, 7).otherwise(back).cast("int"))
    release = F.greatest(at_hour(sunday, hour), available)
    pulled = F.coalesce((rhythm_on < planned_day) & (release < cart_at), F.lit(False))
    return F.struct(F.when(pulled, order_day(release)).otherwise(planned_day).alias("cart_on"),
                    F.when(pulled, release).otherwise(cart_at).alias("cart_at"),
                    pulled.alias("pulled"))
