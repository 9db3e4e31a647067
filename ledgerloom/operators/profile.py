"""Profiles of whole tables and screening of features.

Each report reads the table once and groups its cells by column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.fixed_values import SCREEN_CORRELATION, SCREEN_MISSING
from ledgerloom.functions.rowwise import row_count
from ledgerloom.functions.text import as_double, literal, quoted
from ledgerloom.operators.columns import numeric_columns
from ledgerloom.plans.cells import by_column, collected
from ledgerloom.plans.order_stats import exact_quantiles
from ledgerloom.plans.shared import Stored


# Tasks that add up the matrices of all others.
ADDERS = 16

_NULL_SHARE = {"missing_fraction": "avg(cast(value as double))"}


def _is_null(column: str) -> str:
    return f"{quoted(column)} is null"


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, missing_fraction)."""
    return by_column(df, columns or df.columns, _NULL_SHARE, cell=_is_null)


def missing_fractions(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    return {r["feature"]: r["missing_fraction"] or 0.0 for r in missing_profile(df, columns).collect()}


def missing_top_n(df: DataFrame, n: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    profile = missing_profile(df, columns)
    return profile.orderBy(F.desc("missing_fraction"), "feature").limit(n)


def missing_above(df: DataFrame, limit: float = 0.5, columns: Sequence[str] | None = None) -> DataFrame:
    return missing_profile(df, columns).where(F.col("missing_fraction") > limit)


def residual_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, nulls)."""
    return by_column(df, columns, {"nulls": "count_if(value)"}, cell=_is_null)


def missing_reduction(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, stage, missing_percent) for features that had gaps before."""
    first = missing_profile(before, columns).where("missing_fraction > 0")
    last = missing_profile(after, columns).withColumnRenamed("missing_fraction", "after_fraction")
    both = first.join(last, "feature").select(
        "feature",
        (F.col("missing_fraction") * 100).alias("Before (%)"),
        (F.col("after_fraction") * 100).alias("After (%)"),
    )
    return both.unpivot("feature", ["Before (%)", "After (%)"], "stage", "missing_percent")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max of numeric columns."""
    columns = list(columns or numeric_columns(df))
    with Stored(df.select(*[F.col(f"`{c}`") for c in columns]), "describe") as stored:
        moments = collected(stored, columns, {
            "count": "count(value)", "mean": "avg(value)", "std": "stddev_samp(value)",
            "min": "min(value)", "max": "max(value)"})
        quartiles = exact_quantiles(stored, {c: [0.25, 0.5, 0.75] for c in columns})
    rows = []
    for c in columns:
        m = moments[c].asDict() if c in moments else {"count": 0}  # a table without rows has no groups
        ends = [m.get("min"), *[quartiles[(c, s)] for s in (0.25, 0.5, 0.75)], m.get("max")]
        rows.append((c, m["count"], m.get("mean"), m.get("std"), *ends))
    return df.sparkSession.createDataFrame(
        rows, "feature string, count long, mean double, std double, min double, q25 double, q50 double,"
        " q75 double, max double")


def type_counts(df: DataFrame) -> DataFrame:
    """(dtype, columns, present_values): columns and present values per type."""
    kinds = dict(df.dtypes)
    present = by_column(df, df.columns, {"present": "count_if(not value)"}, cell=_is_null)
    pairs = ", ".join(f"{literal(c)}, {literal(kind)}" for c, kind in kinds.items())
    dtype = F.expr(f"map({pairs})[feature]")
    return present.groupBy(dtype.alias("dtype")).agg(
        F.count("*").alias("columns"), F.sum("present").alias("present_values"))


# Absolute Pearson correlation over the rows where both are present, 0 when undefined.
_ABS_CORR = """coalesce(abs(try_divide(covar_pop(value, y),
    sqrt(var_pop(case when y is not null then value end)
         * var_pop(case when value is not null then y end)))), 0D)"""


def corr_with_target(df: DataFrame, columns: Sequence[str], target: str = "target") -> DataFrame:
    """(feature, correlation): absolute, 0 where undefined."""
    return by_column(df, columns, {"correlation": _ABS_CORR}, beside={"y": as_double(target)})


def corr_extremes(
    df: DataFrame, columns: Sequence[str], target: str = "target", top: int = 15, bottom: int = 10
) -> DataFrame:
    """The most and least correlated features, labelled by ``side``.

    Correlations are compared to six digits, then by name: columns that repeat one
    another differ in the last digits only.
    """
    table = corr_with_target(df, columns, target).withColumn("correlation", F.round("correlation", 6))
    most = table.orderBy(F.desc("correlation"), "feature").limit(top)
    least = table.orderBy("correlation", F.desc("feature")).limit(bottom)
    return most.withColumn("side", F.lit("top")).union(least.withColumn("side", F.lit("bottom")))


def feature_screen(
    df: DataFrame, columns: Sequence[str], target: str = "target",
    missing_limit: float = SCREEN_MISSING, correlation_limit: float = SCREEN_CORRELATION,
) -> DataFrame:
    """(feature, missing_fraction, correlation, dropped), from one scan."""
    table = by_column(
        df, columns,
        {"missing_fraction": "avg(cast(value is null as double))", "correlation": _ABS_CORR},
        beside={"y": as_double(target)})
    dropped = (F.col("missing_fraction") > missing_limit) & (F.col("correlation") < correlation_limit)
    return table.withColumn("dropped", dropped)


def screen_features(df: DataFrame, columns: Sequence[str], target: str = "target", **limits) -> list[str]:
    """Names of the features to keep."""
    kept = feature_screen(df, columns, target, **limits).where("not dropped")
    names = {r["feature"] for r in kept.select("feature").collect()}
    return [c for c in columns if c in names]


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_x, feature_y, correlation) for all ordered pairs, null when undefined.

    Sums of products of every pair come from one matrix product per Arrow batch. A task
    passes its matrices on as one row of bytes; a few tasks add these up, and only then
    are there rows per pair. Values are shifted by the column means first, so the sums
    stay accurate.
    """
    columns = list(columns)
    size = len(columns)
    values = df.selectExpr(*[f"{as_double(c)} as c{i}" for i, c in enumerate(columns)])
    means = collected(df, columns, {"mean": "avg(value)"})
    shift = np.array([(means[c]["mean"] if c in means else None) or 0.0 for c in columns])

    def task_sums(batches):
        total = np.zeros((4, size, size))
        for batch in batches:
            x = batch.to_numpy(dtype="float64") - shift
            seen = (~np.isnan(x)).astype("float64")
            x = np.nan_to_num(x)
            total += np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
        yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "matrices": [total.tobytes()]})

    def add(rows):
        return pd.DataFrame({"matrices": [sum(np.frombuffer(m) for m in rows["matrices"]).tobytes()]})

    def pairs_of(batches):
        for batch in batches:
            for m in batch["matrices"]:
                total = np.frombuffer(m).reshape(4, size, size)
                i, j = np.triu_indices(size)
                yield pd.DataFrame({
                    "i": i, "j": j, "n": total[0][i, j],
                    "sx": total[1][i, j], "sy": total[1].T[i, j],
                    "sxx": total[2][i, j], "syy": total[2].T[i, j], "sxy": total[3][i, j],
                })

    parts = values.mapInPandas(task_sums, "task int, matrices binary")
    added = parts.groupBy(F.col("task") % ADDERS).applyInPandas(add, "matrices binary")
    sums = added.mapInPandas(
        pairs_of,
        "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double",
    ).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    covariance = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    spread_x = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    spread_y = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    # A constant column leaves only rounding noise in its centred square sum.
    noise = 1e-12
    defined = (spread_x > noise * F.col("sxx")) & (spread_y > noise * F.col("syy"))
    pairs = sums.select("i", "j", F.when(
        defined, F.try_divide(covariance, F.sqrt(spread_x * spread_y))).alias("correlation"))
    mirrored = pairs.union(pairs.where("i < j").select("j", "i", "correlation"))
    names = F.expr(f"array({', '.join(literal(c) for c in columns)})")
    return mirrored.select(
        names[F.col("i").cast("int")].alias("feature_x"),
        names[F.col("j").cast("int")].alias("feature_y"),
        "correlation",
    )


def feature_completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add available_features, total_features and their share in percent."""
    available = row_count(list(columns))
    return df.withColumns({
        "available_features": available,
        "total_features": F.lit(len(columns)),
        "feature_completeness": available / F.lit(float(len(columns))) * 100,
    })


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count), nulls left out."""
    value = F.col(f"`{column}`").alias("value")
    return df.select(value).where("value is not null").groupBy("value").agg(F.count("*").alias("count"))
