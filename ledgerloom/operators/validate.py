"""Row filters and request checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.fixed_values import REQUEST_ENUMS, REQUEST_RANGES, REQUIRED_FIELDS, SPARSE_FRACTION
from ledgerloom.operators.profile import missing_fractions
from ledgerloom.sources.applicants import CORRUPT


def drop_null_target(df: DataFrame, columns: Sequence[str] = ("target",)) -> DataFrame:
    return df.dropna(subset=list(columns))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(columns))


def drop_sparse_columns(
    df: DataFrame, limit: float = SPARSE_FRACTION, keep: Sequence[str] = ()
) -> DataFrame:
    """Drop columns whose missing share is strictly above the limit."""
    shares = missing_fractions(df)
    return df.drop(*[c for c, s in shares.items() if s > limit and c not in keep])


def with_reasons(
    df: DataFrame,
    ranges: Mapping[str, tuple] = REQUEST_RANGES,
    enums: Mapping[str, Sequence[str]] = REQUEST_ENUMS,
    required: Sequence[str] = tuple(REQUIRED_FIELDS),
) -> DataFrame:
    """Upper-case the enumerated columns and list what is wrong with each row."""
    present = set(df.columns)
    normalised = df.withColumns({c: F.upper(F.col(c)) for c in enums if c in present})
    problems = []
    if CORRUPT in present:
        problems.append(F.when(F.col(CORRUPT).isNotNull(), F.concat(F.lit("malformed record: "), F.col(CORRUPT))))
    for name in required:
        text = f"missing {name}"
        problems.append(F.when(F.col(name).isNull(), text) if name in present else F.lit(text))
    for name, (low, high) in ranges.items():
        if name in present:
            outside = F.lit(False)
            if low is not None:
                outside = outside | (F.col(name) < low)
            if high is not None:
                outside = outside | (F.col(name) > high)
            problems.append(F.when(outside, f"{name} out of range"))
    for name, allowed in enums.items():
        if name in present:
            problems.append(F.when(~F.col(name).isin(list(allowed)), f"{name} not allowed"))
    reasons = F.array_compact(F.array(*problems)) if problems else F.array().cast("array<string>")
    return normalised.withColumn("reasons", reasons)


def validate_requests(df: DataFrame, **checks) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reasons``)."""
    checked = with_reasons(df, **checks)
    good = F.size("reasons") == 0
    return checked.where(good).drop("reasons"), checked.where(~good)
