"""Global row numbers and running totals without a single-partition sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.shared import Stored, materialize

PART = "_part"
PLACE = "_place"


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partitioned and sorted copy, stored with each row's partition and place.

    The copy is written first: range bounds come from sampling, so a second
    evaluation could cut the rows elsewhere.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits of the generated id are the row's place in its partition.
    return materialize(
        ranged.select(
            "*",
            F.spark_partition_id().alias(PART),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(PLACE),
        ),
        "ranged",
    )


def _offsets(totals: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sum over the earlier partitions; one row per partition, so one small task.

    Stored, so that the planner sees how small it is and does not shuffle the rows
    it is joined to.
    """
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return materialize(totals.select(
        PART, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names]
    ), "offsets")


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Add the 1-based position of each row in the order of ``order``.

    ``order`` must identify a row; a repeated key would otherwise fill one partition.
    """
    stored = _ranged(df, order)
    totals = stored.groupBy(PART).agg(F.count("*").alias("n"))
    numbered = stored.join(_offsets(totals, ["n"]), PART)
    return numbered.withColumn(
        name, F.col("_before_n") + F.col(PLACE) + 1
    ).drop(PART, PLACE, "_before_n")


def running_totals(
    df: DataFrame, order: Sequence[str], totals: Mapping[str, Column]
) -> DataFrame:
    """Add inclusive running sums in the order of ``order`` (which must be unique)."""
    stored = _ranged(df.select("*", *[c.alias(f"_v_{n}") for n, c in totals.items()]), order)
    names = [f"_v_{n}" for n in totals]
    sums = stored.groupBy(PART).agg(*[F.sum(n).alias(n) for n in names])
    inside = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    joined = stored.join(_offsets(sums, names), PART)
    return joined.select(
        "*",
        *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_before__v_{n}")).alias(n) for n in totals],
    ).drop(PART, PLACE, *names, *[f"_before_{n}" for n in names])


def running_within(
    df: DataFrame, group: Sequence[str], order: Sequence[str], totals: Mapping[str, str] | None = None,
    name: str = "position",
) -> tuple[DataFrame, Stored]:
    """Add each row's 0-based place in its group, and inclusive running sums of columns.

    ``order`` must identify a row of its group; ``totals`` names the sums, {new name: column}.
    Groups are cut where range partitions are, so a group may hold any part of the rows: a window runs
    inside one partition, and only groups that lie in several of them take the sums of the
    partitions before. The second result is the stored copy that the first one reads; the
    caller drops it when done.
    """
    totals = totals or {}
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = Stored(ranged.select(
        "*", F.spark_partition_id().alias(PART),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(PLACE)), "ranged")
    counted = {name: F.count("*"), **{n: F.sum(c) for n, c in totals.items()}}
    pieces = stored.frame.groupBy(PART, *group).agg(*[c.alias(n) for n, c in counted.items()])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # All pieces but the first of a group: at most one per partition and edge.
    offsets = pieces.select(
        F.col(PART).alias("_in"), *[F.col(g).alias(f"_of_{g}") for g in group],
        *[F.sum(n).over(earlier).alias(f"_before_{n}") for n in counted]).where(f"_before_{name} is not null")
    inside = Window.partitionBy(PART, *group).orderBy(PLACE)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = stored.frame.select(
        "*", (F.row_number().over(inside) - 1).cast("long").alias(name),
        *[F.sum(c).over(upto).alias(n) for n, c in totals.items()])
    same = F.col(PART) == F.col("_in")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    joined = placed.join(offsets, same, "left").withColumns(
        {n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in counted})
    return joined.select(*df.columns, *counted), stored
