"""Horizontal aggregates over a family of columns (one row at a time, no shuffle).

Nulls are skipped: the sum of nothing is 0, its mean, maximum and standard
deviation are null, its count is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import as_double, quoted

FLAG_SUFFIX = "_is_missing"


def select_family(
    columns: Iterable[str],
    mode: str,
    pattern: str | tuple[str, ...],
    exclude_flags: bool = True,
) -> list[str]:
    """Column names of one family.

    ``mode`` is "regex" (match anywhere in the name), "prefix" (one prefix or
    several) or "substring". Missing-value flags are left out unless
    ``exclude_flags`` is False.
    """
    if mode == "regex":
        matches = re.compile(pattern).search
    elif mode == "prefix":
        matches = lambda name: name.startswith(pattern)
    elif mode == "substring":
        matches = lambda name: pattern in name
    else:
        raise ValueError(f"unknown family mode: {mode}")
    return [
        name for name in columns
        if matches(name) and not (exclude_flags and name.endswith(FLAG_SUFFIX))
    ]


def _sum_text(columns: list[str]) -> str:
    return "(" + (" + ".join(f"coalesce({as_double(c)}, 0D)" for c in columns) or "0D") + ")"


def _count_text(columns: list[str]) -> str:
    return "(" + (" + ".join(f"cast({quoted(c)} is not null as int)" for c in columns) or "0") + ")"


def _mean_text(columns: list[str]) -> str:
    return f"try_divide({_sum_text(columns)}, cast({_count_text(columns)} as double))"


def row_sum(columns: list[str]) -> Column:
    return F.expr(_sum_text(columns))


def row_count(columns: list[str]) -> Column:
    return F.expr(_count_text(columns))


def row_mean(columns: list[str]) -> Column:
    return F.expr(_mean_text(columns))


def row_max(columns: list[str]) -> Column:
    values = [as_double(c) for c in columns]
    if not values:
        return F.expr("cast(null as double)")
    return F.expr(values[0] if len(values) == 1 else f"greatest({', '.join(values)})")


def row_std(columns: list[str]) -> Column:
    """Sample standard deviation, from squared distances to the mean; null below two values."""
    if len(columns) < 2:
        return F.expr("cast(null as double)")
    mean, count = _mean_text(columns), _count_text(columns)
    squares = (f"aggregate(array({', '.join(as_double(c) for c in columns)}), 0D, "
               f"(total, x) -> total + coalesce((x - {mean}) * (x - {mean}), 0D))")
    return F.expr(f"case when {count} > 1 then sqrt({squares} / ({count} - 1)) end")
