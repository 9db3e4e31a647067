"""Aggregates of many columns at once, one group per column.

A table with hundreds of columns would need hundreds of aggregate expressions in
one operator, which costs seconds of code generation in every task and ends in a
single reducer. Instead each row becomes an array of its cells, the array is
exploded, and Spark groups by position: a few expressions, combined before the
shuffle, with the columns spread over the reducers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import as_double, literal, quoted


def by_column(
    df: DataFrame,
    columns: Sequence[str],
    aggregates: Mapping[str, str],
    cell: Callable[[str], str] = as_double,
    beside: Mapping[str, str] | None = None,
) -> DataFrame:
    """(feature, *aggregates), one row per column.

    ``aggregates`` are SQL texts over ``value`` (the text ``cell`` of the column)
    and the row-level texts named in ``beside``. A table without rows gives none.
    """
    beside = dict(beside or {})
    cells = ", ".join(cell(c) for c in columns)
    rows = df.selectExpr(*[f"{text} as {name}" for name, text in beside.items()],
                         f"array({cells}) as cells")
    long = rows.selectExpr(*beside, "posexplode(cells) as (position, value)")
    grouped = long.groupBy("position").agg(*[F.expr(t).alias(n) for n, t in aggregates.items()])
    names = f"array({', '.join(literal(c) for c in columns)})"
    return grouped.selectExpr(f"{names}[position] as feature", *[quoted(n) for n in aggregates])


def collected(df: DataFrame, columns: Sequence[str], aggregates: Mapping[str, str], **more) -> dict:
    """The same as {column: row}; one row per column reaches the driver."""
    if not columns:
        return {}
    return {r["feature"]: r for r in by_column(df, columns, aggregates, **more).collect()}
