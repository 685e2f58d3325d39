"""Rounding, array statistics and keys as Column expressions (all JVM-side)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_min1(value: Column) -> Column:
    """Model output to a usable integer: round half up, never below 1."""
    return F.greatest(F.lit(1), F.floor(value + F.lit(0.5))).cast("bigint")


def half_even(value: Column) -> Column:
    """Banker's rounding, as the lead and item-median rules use."""
    return F.bround(value.cast("double"), 0).cast("bigint")


def median_of(values: Column) -> Column:
    """Median of a short array: mean of the middle two; NULL when empty."""
    ordered = F.sort_array(values)
    n = F.size(values)
    low, high = ((n + 1) / 2).cast("int") - 1, (n / 2).cast("int")
    return (F.get(ordered, low) + F.get(ordered, high)).cast("double") / 2


def quantile_of(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of a short array; NULL when empty."""
    ordered = F.sort_array(values)
    n = F.size(values)
    position = (n - 1) * F.lit(q)
    base = F.floor(position).cast("int")
    low = F.get(ordered, base).cast("double")
    high = F.get(ordered, F.least(base + 1, n - 1)).cast("double")
    return low + (high - low) * (position - base)


def total_of(values: Column) -> Column:
    """Sum of a short array of whole numbers."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def squares_of(values: Column) -> Column:
    """Sum of squares of a short array of whole numbers."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint") * x)


def _spread(n: Column, total: Column, squares: Column) -> Column:
    """sqrt(n * sum of squares - square of sum): exact before the root for whole numbers."""
    return F.sqrt((n * squares - total * total).cast("double"))


def pstdev_of(values: Column) -> Column:
    """Population standard deviation of a short array of whole numbers; NULL when empty."""
    n = F.size(values)
    return F.when(n > 0, _spread(n, total_of(values), squares_of(values)) / n)


def variation(n: Column, total: Column, squares: Column) -> Column:
    """Coefficient of variation from whole-number sums; exact at class boundaries, NULL when empty."""
    return F.when(n > 0, _spread(n, total, squares) / total)


def variation_of(values: Column) -> Column:
    """Coefficient of variation of a short array of whole numbers."""
    return variation(F.size(values), total_of(values), squares_of(values))


def json_list(*parts: Column) -> Column:
    """JSON text of a list of strings with ", " between elements (Spark's own writer puts no blank).

    Inside a JSON string every quote is escaped, so `","` occurs only between elements.
    """
    packed = F.to_json(F.array(*[p.cast("string") for p in parts]))
    return F.replace(packed, F.lit('","'), F.lit('", "'))


def list_key(*parts: Column) -> Column:
    """Stable identifier: sha-256 hex of the JSON list of the parts."""
    return F.sha2(json_list(*parts), 256)


def packed_id(identifier: Column) -> Column:
    """An identifier as bytes, equal where the texts are: half the length where it is the hex of an md5 or a sha-256.

    Any other text keeps its bytes and gets 33 more, so that it is never as short as a packed digest.
    """
    return (F.when(identifier.rlike("^([0-9a-f]{32}){1,2}$"), F.unhex(identifier))
            .otherwise(F.concat(F.encode(identifier, "UTF-8"), F.lit(bytearray(33)))))


def unpacked_id(packed: Column) -> Column:
    """The identifier of `packed_id`."""
    plain = F.decode(F.substring(packed, F.lit(1), F.length(packed) - 33), "UTF-8")
    return F.when(F.length(packed) <= 32, F.lower(F.hex(packed))).otherwise(plain)


# Upper bucket bound of each assignment group.
AB_GROUPS = (("holdout", 5), ("control", 50), ("treatment", 100))


def ab_bucket(customer_id: Column) -> Column:
    """sha-256 of the id as one 256-bit number, modulo 100.

    Eight 32-bit words, each weighted by its power of 2^32 modulo 100, keep the arithmetic in BIGINT.
    """
    digest = F.sha2(customer_id.cast("string"), 256)
    total = F.lit(0).cast("bigint")
    for word in range(8):
        value = F.conv(F.substring(digest, word * 8 + 1, 8), 16, 10).cast("bigint")
        total = total + value * F.lit(pow(2, 32 * (7 - word), 100))
    return F.pmod(total, F.lit(100)).cast("int")


def ab_group(customer_id: Column) -> Column:
    bucket = ab_bucket(customer_id)
    (first, upper), *rest = AB_GROUPS
    chain = F.when(bucket < upper, first)
    for name, bound in rest:
        chain = chain.when(bucket < bound, name)
    return chain


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio, NULL when the denominator is zero."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def improvement(baseline: Column, candidate: Column) -> Column:
    """Relative reduction against the baseline; NULL when the baseline is zero."""
    return safe_ratio(baseline - candidate, baseline)


def rate(condition: Column) -> Column:
    """Share of rows meeting a condition (aggregate)."""
    return F.avg(condition.cast("double"))


def count_if(condition: Column) -> Column:
    """Number of rows meeting a condition, zero when there are none (aggregate)."""
    return F.count(F.when(condition, F.lit(1)))


def recency_weight(age_days: Column, half_life_days: float) -> Column:
    """Training weight halving every `half_life_days`."""
    if not half_life_days > 0:
        raise ValueError("Half-life must be positive")
    return F.pow(F.lit(2.0), -age_days / F.lit(float(half_life_days)))


def history_bucket(purchases: Column) -> Column:
    """Purchase-count bucket: 1, 2, 3-5, 6+."""
    return (F.when(purchases <= 2, purchases.cast("int").cast("string"))
            .when(purchases <= 5, "3-5").otherwise("6+"))


def exact_bucket(purchases: Column) -> Column:
    """Purchase-count bucket: 1, 2, 3, 4, 5, 6+."""
    return F.when(purchases < 6, purchases.cast("int").cast("string")).otherwise("6+")
