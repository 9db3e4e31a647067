"""Exact order statistics of many columns without sorting or collecting them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import as_double, literal, named, quoted
from ledgerloom.plans.cells import collected

# Values strictly inside a bracket are put in order only when at most this many are left.
CANDIDATES = 10_000
SKETCH_STEPS = 128
SKETCH_ACCURACY = 10_000


@dataclass
class _Search:
    """The ranks around one quantile of one column and what is known of them.

    ``below`` counts the values under ``low``; the ranks lie within [low, high].
    """

    column: str
    position: int
    share: float
    first: int
    last: int
    weight: float
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    at_low: int = 0
    open: int = 0
    values: tuple[float | None, float | None] = (None, None)

    def known(self, rank: int) -> float | None:
        """The value at a rank, if it is an end of the bracket."""
        if rank < self.below + self.at_low:
            return self.low
        return self.high if rank >= self.below + self.at_low + self.open else None

    def result(self) -> float:
        low, high = self.values
        return low if self.weight == 0 else low + (high - low) * self.weight


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], candidate_rows: int = CANDIDATES
) -> dict[tuple[str, float], float | None]:
    """Linearly interpolated quantiles, as {(column, share): value}.

    A sketch of every column brackets the ranks around each quantile, one counting
    pass places the brackets, and both repeat inside the brackets until few values
    are left, which are put in order. Each of these steps is one job for all columns
    and shares together; a round narrows a bracket to about a thirtieth of its rows.
    ``df`` should be cheap to scan repeatedly (stored or cached).
    """
    columns = list(wanted)
    if not columns:
        return {}
    found = collected(df, columns, {"n": "count(value)"})
    counts = {c: found[c]["n"] if c in found else 0 for c in columns}
    searches = []
    for position, c in enumerate(columns):
        for share in wanted[c] if counts[c] else []:
            rank = share * (counts[c] - 1)
            first, last = math.floor(rank), math.ceil(rank)
            searches.append(_Search(c, position, share, first, last, rank - first, counts[c]))
    open_searches = searches
    while open_searches:
        _bracket(df, columns, open_searches)
        _count(df, columns, open_searches)
        open_searches = [s for s in open_searches if s.open > candidate_rows and None in s.values]
    _order_rest(df, columns, [s for s in searches if None in s.values])
    result: dict[tuple[str, float], float | None] = {
        (c, share): None for c in columns for share in wanted[c]}
    return result | {(s.column, s.share): s.result() for s in searches}


def _cells_in(df: DataFrame, columns: Sequence[str], brackets: Sequence[tuple[int, float | None, float | None]]) -> DataFrame:
    """(bracket, value, low, high): the cells of each bracket's column up to its upper end.

    An open end is NaN above, which Spark orders after every number, and -infinity below.
    """
    per_column: list[list[str]] = [[] for _ in columns]
    for number, (position, low, high) in enumerate(brackets):
        ends = [literal(low) if low is not None else "double('-infinity')", literal(high) if high is not None else "double('NaN')"]
        per_column[position].append(f"named_struct('bracket', {number}, 'low', {ends[0]}, 'high', {ends[1]})")
    none = "array<struct<bracket:int,low:double,high:double>>"
    lists = ", ".join(f"cast(array({', '.join(some)}) as {none})" for some in per_column)
    cells = ", ".join(as_double(c) for c in columns)
    long = df.selectExpr(f"posexplode(array({cells})) as (position, value)").where("value is not null")
    return long.selectExpr("value", f"inline(array({lists})[position])").where("value <= high")


def _bracket(df: DataFrame, columns: Sequence[str], searches: Sequence[_Search]) -> None:
    """Narrower ends for every search, from sketches of what its bracket holds."""
    brackets = list(dict.fromkeys((s.position, s.low, s.high) for s in searches))
    grid = ", ".join(literal(k / SKETCH_STEPS) for k in range(SKETCH_STEPS + 1))
    sketched = _cells_in(df, columns, brackets).where("value >= low").groupBy("bracket").agg(
        F.expr(f"percentile_approx(value, array({grid}), {SKETCH_ACCURACY})").alias("steps"))
    steps = {brackets[r["bracket"]]: r["steps"] for r in sketched.collect()}
    for s in searches:
        found, spread = steps[(s.position, s.low, s.high)], max(s.inside - 1, 1)
        low = math.floor((s.first - s.below) / spread * SKETCH_STEPS) - 1
        high = math.ceil((s.last - s.below) / spread * SKETCH_STEPS) + 1
        # The ends of the sketch are the least and greatest value, so they are safe ends.
        s.low, s.high = found[max(low, 0)], found[min(high, SKETCH_STEPS)]


def _count(df: DataFrame, columns: Sequence[str], searches: Sequence[_Search]) -> None:
    """Place the brackets: values below, at the lower end, strictly inside, at the upper end."""
    brackets = list(dict.fromkeys((s.position, s.low, s.high) for s in searches))
    counted = _cells_in(df, columns, brackets).groupBy("bracket").agg(
        F.count_if(F.col("value") < F.col("low")).alias("below"),
        F.count_if(F.col("value") == F.col("low")).alias("at_low"),
        F.count_if((F.col("value") > F.col("low")) & (F.col("value") < F.col("high"))).alias("open"),
        F.count("*").alias("upto"))
    rows = {brackets[r["bracket"]]: r for r in counted.collect()}
    for s in searches:
        row = rows[(s.position, s.low, s.high)]
        s.below, s.at_low, s.open = row["below"], row["at_low"], row["open"]
        s.inside = row["upto"] - row["below"]
        if s.below > s.first or row["upto"] <= s.last:
            raise RuntimeError(f"sketch bracket missed a quantile of {s.column}")
        s.values = (s.known(s.first), s.known(s.last))


def _order_rest(df: DataFrame, columns: Sequence[str], searches: Sequence[_Search]) -> None:
    """The values at the ranks that lie strictly inside a bracket of few values."""
    if not searches:
        return
    brackets = [(s.position, s.low, s.high) for s in searches]
    places = [(r - s.below - s.at_low) for s in searches for r in (s.first, s.last)]
    inside = _cells_in(df, columns, brackets).where("value > low and value < high")
    at = f"array({', '.join(map(str, places))})"
    ordered = inside.groupBy("bracket").agg(F.sort_array(F.collect_list("value")).alias("v")).selectExpr(
        "bracket", f"get(v, {at}[2 * bracket]) as a", f"get(v, {at}[2 * bracket + 1]) as b")
    for r in ordered.collect():
        s = searches[r["bracket"]]
        s.values = tuple(k if k is not None else v for k, v in zip(s.values, (r["a"], r["b"])))


def exact_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent present value of each text column, the smallest on ties.

    Values are counted as distributed groups, so a column may have any number of
    distinct values; only one row per column reaches the driver.
    """
    if not columns:
        return {}
    long = df.selectExpr(*[named(f"cast({quoted(c)} as string)", c) for c in columns]).unpivot(
        [], list(columns), "feature", "value"
    ).where("value is not null")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    winners = counts.groupBy("feature").agg(
        F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("value"))).alias("best")
    )
    modes = {r["feature"]: r["best"]["value"] for r in winners.collect()}
    return {c: modes.get(c) for c in columns}
