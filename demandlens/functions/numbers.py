"""Numeric expressions with the rounding rules that all reports share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean2(total: Column, count: Column) -> Column:
    """Average of integers rounded half up to two places, computed exactly; 0 without rows."""
    exact = F.floor((total.cast("long") * 200 + count) / F.when(count > 0, 2 * count)) / F.lit(100.0)
    return F.coalesce(exact, F.lit(0.0))


def percentage(part: Column, total: Column, places: int = 1) -> Column:
    """part / total in percent, half up; 0 for an empty total."""
    scale = 10**places
    exact = F.floor((part.cast("long") * (200 * scale) + total) / F.when(total > 0, 2 * total)) / F.lit(float(scale))
    return F.coalesce(exact, F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def growth_ratio(r30: Column, r90: Column) -> Column:
    """Daily rate of the last 30 days over that of the 60 before; without those, over the 90-day rate."""
    prior = F.greatest(r90 - r30, F.lit(0))
    base = F.when(prior > 0, prior / 60.0).otherwise(r90 / 90.0)
    return F.when(r90 <= 0, F.when(r30 <= 0, 1.0).otherwise(2.0)).when(base <= 0, F.when(r30 > 0, 2.0).otherwise(1.0)).otherwise((r30 / 30.0) / base)


def trend_type(r30: Column, r90: Column, ratio: Column) -> Column:
    rising = ((r30 > 0) & (r90 <= r30)) | (ratio >= 1.25)
    return F.when(rising, "rising").when(ratio <= 0.75, "declining").otherwise("stable")


def demand_score(unique_jobs: Column, r30: Column, ratio: Column) -> Column:
    return F.round(unique_jobs + 2 * r30 + 10 * ratio, 2)
