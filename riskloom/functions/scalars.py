"""Column functions. All are built-in expressions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_SECONDS = 3600
DAY_SECONDS = 86400


def hour_of_day(seconds: Column) -> Column:
    """Fractional hour in [0, 24)."""
    return F.pmod(seconds / F.lit(HOUR_SECONDS), F.lit(24.0))


def day_of_week(seconds: Column) -> Column:
    """Fractional day in [0, 7)."""
    return F.pmod(seconds / F.lit(DAY_SECONDS), F.lit(7.0))


def is_night(hour: Column) -> Column:
    return ((hour >= 22) | (hour <= 6)).cast("int")


def is_rush_hour(hour: Column) -> Column:
    """Inclusive on the fractional hour: 9.0 is in, 9.2 is out."""
    return (hour.between(7, 9) | hour.between(17, 19)).cast("int")


def log_amount(amount: Column) -> Column:
    """``log1p``; NULL (not -inf) at -1 and below."""
    return F.log1p(F.when(amount > -1, amount))


def fraction_of(amount: Column) -> Column:
    """Fractional part with the sign of the divisor: -1.5 gives 0.5."""
    return F.pmod(amount.cast("double"), F.lit(1.0))


def is_round(amount: Column) -> Column:
    return (fraction_of(amount) == 0).cast("int")


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def ratio(value: Column, divisor: Column) -> Column:
    """``value / divisor``, NULL for a zero or missing divisor."""
    return F.try_divide(value.cast("double"), divisor.cast("double"))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """Distance from the mean in deviations; a zero deviation counts as one."""
    return (value - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def domain_parts(domain: Column, missing: str = "missing") -> list[Column]:
    """Three dot-separated parts; the third keeps whatever is left over."""
    parts = F.split(domain, "\\.", 3)
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit(missing)) for i in range(3)]


def domain_parts_strict(domain: Column, missing: str = "missing", on_error: str = "raise") -> list[Column]:
    """Exactly three parts at most; absent parts are ``missing``.

    A domain with more than three parts stops the job, or with
    ``on_error="null"`` gives three NULLs in its own row only.
    """
    parts = F.split(domain, "\\.")
    too_wide = F.size(parts) > 3
    filled = [F.coalesce(F.get(parts, F.lit(i)), F.lit(missing)) for i in range(3)]
    if on_error == "null":
        return [F.when(~F.coalesce(too_wide, F.lit(False)), p) for p in filled]
    message = F.concat(F.lit("more than three parts in domain "), domain)
    return [F.when(too_wide, F.raise_error(message)).otherwise(p) for p in filled]


def decide(probability: Column, threshold: float = 0.5, strict: bool = False) -> Column:
    """Label from a probability: ``>=`` the threshold, or ``>`` when strict."""
    limit = F.lit(float(threshold))
    return ((probability > limit) if strict else (probability >= limit)).cast("int")


def risk_band(probability: Column, high: float = 0.7, medium: float = 0.3) -> Column:
    return (
        F.when(probability > F.lit(high), "High")
        .when(probability > F.lit(medium), "Medium")
        .otherwise("Low")
    )


def percent_text(probability: Column) -> Column:
    return F.format_string("%.2f%%", probability * 100)


def soft_vote(probabilities: list[Column], weights: list[float]) -> Column:
    """Weighted sum; weights are used as given (0.5/0.5, 0.25/0.75, ...)."""
    total = F.lit(0.0)
    for probability, weight in zip(probabilities, weights, strict=True):
        total = total + probability * F.lit(float(weight))
    return total


def ordering_hash(key: Column, seed: int = 42) -> Column:
    """A reproducible shuffle order: md5 of the key and the seed, as hex."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
