"""Turning model output into scores, bands and summaries for all applicants at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.fixed_values import DEFAULT_THRESHOLD
from ledgerloom.functions.scalars import eligibility_band
from ledgerloom.operators.features import MinMax


def _mean(columns: Sequence[Column]) -> Column:
    return reduce(add, columns) / F.lit(float(len(columns)))


def ensemble_confidence(members: Sequence[Column]) -> Column:
    """1 - population std / mean of the member predictions, kept within 0-1."""
    mean = _mean(members)
    spread = F.sqrt(_mean([(m - mean) * (m - mean) for m in members]))
    share = F.when(mean == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.try_divide(spread, mean))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def apply_threshold(
    df: DataFrame, probability: str, threshold: float | str = DEFAULT_THRESHOLD
) -> DataFrame:
    """Add prediction 0/1, status Good/Bad and the threshold used.

    ``threshold`` is a number, or the name of a column whose nulls mean 0.5.
    A number outside 0-1 is an error; rows whose own threshold is outside, or whose
    probability is missing, get neither prediction nor status.
    """
    if isinstance(threshold, str):
        limit = F.coalesce(F.col(threshold), F.lit(DEFAULT_THRESHOLD))
    else:
        if not 0 <= threshold <= 1:
            raise ValueError("threshold must be between 0 and 1")
        limit = F.lit(float(threshold))
    good = F.col(probability) >= limit
    return df.withColumns({
        "prediction": F.when(limit.between(0, 1), good.cast("int")),
        "status": F.when(limit.between(0, 1), F.when(good, "Good").when(~good, "Bad")),
        "threshold": limit,
    })


def income_summary(df: DataFrame, annual: str, members: Sequence[str] = ()) -> DataFrame:
    """Add annual and monthly income and, with member incomes, the confidence."""
    new = {
        "predicted_annual_income": F.col(annual),
        "predicted_monthly_income": F.col(annual) / F.lit(12.0),
    }
    if members:
        new["confidence_score"] = ensemble_confidence([F.col(m) for m in members])
    return df.withColumns(new)


def add_eligibility(df: DataFrame, score: str, name: str = "eligibility") -> DataFrame:
    return df.withColumn(name, eligibility_band(F.col(score)))


def capability(df: DataFrame, scaled: str, bounds: MinMax, as_income: bool = False) -> DataFrame:
    """The 0-1 capability score, or the income it stands for."""
    value = bounds.inverse(F.col(scaled)) if as_income else F.col(scaled)
    return df.withColumn("predicted_income" if as_income else "capability_score", value)


def importance_confidence(importances: Sequence[float]) -> float:
    """Mean importance, a constant per model (kept for parity; prefer ensemble_confidence)."""
    return float(sum(importances) / len(importances)) if len(importances) else 0.0
