"""Profiles that merge: new files update a stored profile without reading the old ones.

Per column the state holds counts, mean and squared deviations, extremes, co-moments with a target, a
quantile sketch, a distinct-count sketch and a sketch of frequent values. All of it adds up: the
states of two parts give the state of both. Moments are exact up to rounding; quantiles and
distinct counts are estimates of the sketches (ranks within about 1 %, counts within about 2 %), frequent
values are exact while a column has fewer distinct values than the sketch tracks. The exact reports of
`profile` stay the default; this is for tables that grow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import as_double, quoted
from ledgerloom.plans.cells import by_column

#: Distinct values that a sketch of frequent values tracks.
TRACKED = 1_000

_BOTH = "case when y is not null then value end"
_MOMENTS = {
    "rows": "count(*)", "present": "count(value)", "mean": "avg(value)",
    "squares": "coalesce(var_pop(value) * count(value), 0D)", "least": "min(value)", "greatest": "max(value)",
    "quantiles": "kll_sketch_agg_double(value)", "distinct": "hll_sketch_agg(cast(value as string))",
    # Pairs of a present value and a present target.
    "pairs": f"count({_BOTH})", "pair_mean": f"avg({_BOTH})", "pair_squares": f"coalesce(var_pop({_BOTH}) * count({_BOTH}), 0D)",
    "target_mean": "avg(case when value is not null then y end)",
    "target_squares": "coalesce(var_pop(case when value is not null then y end) * count(case when value is not null then y end), 0D)",
    "products": f"coalesce(covar_pop({_BOTH}, y) * count({_BOTH}), 0D)",
}


def number_state(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """The state of numeric columns, one row per column, from one pass combined before the shuffle."""
    y = as_double(target) if target else "cast(null as double)"
    return by_column(df, columns, _MOMENTS, beside={"y": y})


def text_state(df: DataFrame, columns: Sequence[str], tracked: int = TRACKED) -> DataFrame:
    """The state of text columns: counts, distinct values and frequent values."""
    return by_column(df, columns, {
        "rows": "count(*)", "present": "count(value)", "distinct": "hll_sketch_agg(value)",
        "frequent": f"approx_top_k_accumulate(value, {tracked}) filter (where value is not null)",
    }, cell=lambda c: f"cast({quoted(c)} as string)")


def _merged_moments(states: DataFrame, n: str, means: Sequence[str], squares: Sequence[tuple[str, str, str]]) -> tuple[DataFrame, list]:
    """Means and sums of squares of the union, by the parts' distances from the common mean."""
    whole = Window.partitionBy("feature")
    out = states
    for m in means:
        out = out.withColumn(f"_{m}", F.try_divide(F.sum(F.col(n) * F.col(m)).over(whole), F.sum(n).over(whole)))
    sums = [F.max(f"_{m}").alias(m) for m in means]
    for name, a, b in squares:
        apart = F.coalesce(F.col(n) * (F.col(a) - F.col(f"_{a}")) * (F.col(b) - F.col(f"_{b}")), F.lit(0.0))
        sums.append(F.sum(F.col(name) + apart).alias(name))
    return out, sums


def merge_number_states(states: DataFrame) -> DataFrame:
    """One row per column from the states of any parts; a column that a part lacks simply has fewer rows there."""
    out, own = _merged_moments(states, "present", ["mean"], [("squares", "mean", "mean")])
    out, pairs = _merged_moments(out, "pairs", ["pair_mean", "target_mean"], [
        ("pair_squares", "pair_mean", "pair_mean"), ("target_squares", "target_mean", "target_mean"), ("products", "pair_mean", "target_mean")])
    return out.groupBy("feature").agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"), *own, F.min("least").alias("least"),
        F.max("greatest").alias("greatest"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"), F.sum("pairs").alias("pairs"), *pairs)


def merge_text_states(states: DataFrame, tracked: int = TRACKED) -> DataFrame:
    return states.groupBy("feature").agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.hll_union_agg("distinct").alias("distinct"),
        F.expr(f"approx_top_k_combine(frequent, {tracked})").alias("frequent"))


def number_report(state: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(feature, present, missing_fraction, mean, stddev, min, max, quantiles, n_distinct, corr) of a state."""
    at = [F.when(F.col("present") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(s)))) for s in shares]
    return state.select(
        "feature", "present", (1 - F.col("present") / F.col("rows")).alias("missing_fraction"), "mean",
        F.sqrt(F.try_divide(F.col("squares"), F.when(F.col("present") > 1, F.col("present") - 1))).alias("stddev"),
        F.col("least").alias("min"), F.col("greatest").alias("max"), F.array(*at).alias("quantiles"),
        F.hll_sketch_estimate("distinct").alias("n_distinct"),
        F.try_divide("products", F.nullif(F.sqrt("pair_squares") * F.sqrt("target_squares"), F.lit(0.0))).alias("corr"))


def text_report(state: DataFrame, top: int = 10) -> DataFrame:
    """(feature, present, missing_fraction, n_distinct, top: array of item and count) of a state."""
    return state.select(
        "feature", "present", (1 - F.col("present") / F.col("rows")).alias("missing_fraction"),
        F.hll_sketch_estimate("distinct").alias("n_distinct"), F.expr(f"approx_top_k_estimate(frequent, {top})").alias("top"))


def store_state(state: DataFrame, folder: str, part: str) -> None:
    """Write the state of a part under its name; a part that comes again replaces itself."""
    state.write.mode("overwrite").parquet(f"{folder}/part={part}")


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    """The states of all parts, ready to merge; they are small whatever the size of the files."""
    return spark.read.parquet(folder).drop("part")
