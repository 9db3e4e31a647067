"""Scalar expressions shared by the feature operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.fixed_values import AGE_BANDS, ELIGIBILITY_HIGH, ELIGIBILITY_LOW, RATIO_EPSILON


def finite_or_null(value: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def ratio(top: Column, bottom: Column, shift: float = RATIO_EPSILON) -> Column:
    """top / (bottom + shift), null where that is undefined."""
    denominator = bottom if shift == 0 else bottom + F.lit(float(shift))
    return finite_or_null(F.try_divide(top, denominator))


def age_bin(age: Column) -> Column:
    """Left-closed age band; ages below 0 have none."""
    band = F.lit(None).cast("string")
    for low, high, label in reversed(AGE_BANDS):
        inside = age >= low
        if high is not None:
            inside = inside & (age < high)
        band = F.when(inside, F.lit(label)).otherwise(band)
    return band


def minmax(value: Column, low: float, high: float) -> Column:
    """Scale to 0-1; a constant column scales to 0."""
    width = float(high) - float(low)
    return (value - F.lit(float(low))) / F.lit(width if width else 1.0)


def minmax_inverse(scaled: Column, low: float, high: float) -> Column:
    width = float(high) - float(low)
    return scaled * F.lit(width if width else 1.0) + F.lit(float(low))


def eligibility_band(score: Column) -> Column:
    return (
        F.when(score > ELIGIBILITY_HIGH, F.lit("above_limit"))
        .when(score >= ELIGIBILITY_LOW, F.lit("up_to_limit"))
        .when(score.isNotNull(), F.lit("improve_profile"))
    )


def hash_fraction_bucket(key: Column, buckets: int = 100, seed: int | None = None) -> Column:
    """Stable bucket 0..buckets-1 of a key, the same under any partitioning."""
    return (hash_number(key, seed, digits=8) % buckets).cast("int")


def hash_number(key: Column, seed: int | None = None, digits: int = 13) -> Column:
    """The first hex digits of the key's md5 as an integer (13 digits = 52 bits)."""
    text = key.cast("string")
    if seed is not None:
        text = F.concat(text, F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")
