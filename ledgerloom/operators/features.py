"""Feature families, ratios, bands, frequencies and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.rowwise import (
    row_count, row_max, row_mean, row_std, row_sum, select_family,
)
from ledgerloom.functions.scalars import age_bin, minmax, minmax_inverse, ratio
from ledgerloom.operators.columns import numeric_columns, one_row_per_key
from ledgerloom.plans.order_stats import exact_quantiles
from ledgerloom.plans.shared import Stored, materialize

_PATTERNS = {
    "regex": fv.FAMILY_REGEX, "prefix": fv.FAMILY_PREFIX, "substring": fv.FAMILY_SUBSTRING}


def families(df: DataFrame, mode: str = "regex", exclude_flags: bool = True) -> dict[str, list[str]]:
    """Numeric columns of every family."""
    names = numeric_columns(df)
    return {
        family: select_family(names, mode, pattern, exclude_flags)
        for family, pattern in _PATTERNS[mode].items()
    }


def add_overall_families(
    df: DataFrame, mode: str = "regex", exclude_flags: bool = True
) -> DataFrame:
    """total_/avg_..._overall for credit limits, balances, EMIs, inquiries and loans.

    A row without any slot of a family keeps the total it was supplied with, which
    ``set_aside_totals`` has put out of the way.
    """
    new = {}
    for family, columns in families(df, mode, exclude_flags).items():
        if columns and family in fv.OVERALL_NAMES:
            total, average = fv.OVERALL_NAMES[family]
            new[total], new[average] = row_sum(columns), row_mean(columns)
            if _supplied(total) in df.columns:
                given = F.col(_supplied(total))
                bare = (row_count(columns) == 0) & given.isNotNull()
                new[total] = F.when(bare, given).otherwise(new[total])
    return df.withColumns(new).drop(*[_supplied(total) for total, _ in fv.OVERALL_NAMES.values()])


def _supplied(total: str) -> str:
    return f"_supplied_{total}"


def set_aside_totals(df: DataFrame) -> DataFrame:
    """Totals that come with the rows, under names that ``add_overall_families`` knows."""
    given = [total for total, _ in fv.OVERALL_NAMES.values() if total in df.columns]
    return df.withColumns({_supplied(t): F.col(t).cast("double") for t in given}).drop(*given)


def add_repayment_behaviour(df: DataFrame, mode: str = "regex", exclude_flags: bool = True) -> DataFrame:
    """avg_repayment and repayment_consistency_score = 1 / (std or 0, + 1e-6)."""
    columns = families(df, mode, exclude_flags)["repayment"]
    if not columns:
        return df
    return df.withColumns({
        "avg_repayment": row_mean(columns),
        "repayment_consistency_score":
            F.lit(1.0) / (F.coalesce(row_std(columns), F.lit(0.0)) + F.lit(fv.RATIO_EPSILON)),
    })


def add_profile_features(df: DataFrame) -> DataFrame:
    """Substring-family features of the two single-model trainers, target not used.

    A total supplied with the row is kept when the family behind it is absent.
    """
    family = families(df, "substring")
    present = set(df.columns)

    def supplied(name: str, columns: Sequence[str], value: Column) -> Column:
        if columns:
            return value
        return F.col(name) if name in present else F.lit(0.0)

    balance, loans = family["balance"], family["loan_amt"]
    limits, emis = family["credit_limit"], family["total_emi"]
    repayments, inquiries = family["repayment"], family["inquiries"]
    first = df.withColumns({
        "avg_credit_utilization": supplied("avg_credit_utilization", balance, row_mean(balance)),
        "max_credit_utilization": supplied("max_credit_utilization", balance, row_max(balance)),
        "total_loan_amount": supplied("total_loan_amount", loans, row_sum(loans)),
        "avg_loan_amount": supplied("avg_loan_amount", loans, row_mean(loans)),
        "loan_frequency": supplied("loan_frequency", loans, row_count(loans).cast("double")),
        "total_credit_limit": supplied("total_credit_limit", limits, row_sum(limits)),
        "avg_credit_limit": supplied("avg_credit_limit", limits, row_mean(limits)),
        "total_emi": supplied("total_emi", emis, row_sum(emis)),
        "avg_emi": supplied("avg_emi", emis, row_mean(emis)),
        "avg_repayment": supplied("avg_repayment", repayments, row_mean(repayments)),
        "repayment_consistency": supplied("repayment_consistency", repayments, row_std(repayments)),
        "total_inquiries": supplied("total_inquiries", inquiries, row_sum(inquiries)),
        "recent_inquiries": recent_inquiries(df),
        "credit_risk_score": F.col("credit_score") if "credit_score" in present else F.lit(0.0),
    })
    second = {
        "credit_utilization_ratio": ratio(
            F.col("avg_credit_utilization"), F.col("total_credit_limit"), 0),
        "avg_loan_size": F.col("total_loan_amount")
        / F.when(F.col("loan_frequency") == 0, 1.0).otherwise(F.col("loan_frequency")),
        "payment_consistency_score": ratio(F.lit(1.0), F.col("repayment_consistency"), 1),
    }
    if "age" in present:
        second["age_squared"] = F.pow(F.col("age"), 2)
    return first.withColumns(second)


def recent_inquiries(df: DataFrame) -> Column:
    """The recent inquiry count under its real column name, 0 when absent."""
    name = "total_inquiries_recent"
    return F.col(name) if name in df.columns else F.lit(0.0)


def add_target_ratios(df: DataFrame, target: str = "target") -> DataFrame:
    """Ratios of the single-model trainers that use the income itself.

    They leak the target, so no model of this package takes them as input.
    """
    income = F.col(target)
    return df.withColumns({
        "debt_to_income": ratio(F.col("total_emi"), income, 0),
        "income_to_loan_ratio": ratio(income, F.col("total_loan_amount"), 1),
        "income_to_emi_ratio": ratio(income, F.col("total_emi"), 1),
        "credit_utilization_ratio": ratio(
            F.col("avg_credit_utilization"), F.col("total_credit_limit"), 1),
        "payment_to_income_ratio": ratio(F.col("avg_repayment"), income, 1),
    })


def add_ratios(df: DataFrame, specs: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """name -> (numerator, denominator, shift); specs with an absent column are skipped."""
    present = set(df.columns)
    return df.withColumns({
        name: ratio(F.col(top).cast("double"), F.col(bottom).cast("double"), shift)
        for name, (top, bottom, shift) in specs.items() if {top, bottom} <= present
    })


UTILIZATION = {
    "overall_credit_util_ratio": (
        "total_balance_overall", "total_credit_limit_overall", fv.RATIO_EPSILON),
    **{f"credit_util_ratio_{i}": (f"balance_{i}", f"credit_limit_{i}", fv.RATIO_EPSILON)
       for i in range(1, 4)},
}
PER_INQUIRY = {
    "emi_per_inquiry_ratio": ("total_emi_overall", "total_inquiries_overall", fv.RATIO_EPSILON),
    "loan_amount_per_inquiry_ratio": (
        "total_loan_amount_overall", "total_inquiries_overall", fv.RATIO_EPSILON),
}


def income_ratios(target: str = "target") -> dict[str, tuple[str, str, float]]:
    """Ratios against the income on its original scale (target leakage, as above)."""
    return {
        "debt_to_income_ratio": ("total_emi_overall", target, fv.RATIO_EPSILON),
        "income_to_emi_ratio": (target, "total_emi_overall", fv.RATIO_EPSILON),
        "income_to_loan_ratio": (target, "total_loan_amount_overall", fv.RATIO_EPSILON),
        "payment_to_income_ratio": ("avg_repayment", target, fv.RATIO_EPSILON),
    }


def add_interactions(df: DataFrame) -> DataFrame:
    products = {
        "age_x_total_inquiries_overall": ("age", "total_inquiries_overall"),
        "total_emi_overall_x_credit_score": ("total_emi_overall", "credit_score"),
    }
    present = set(df.columns)
    return df.withColumns({
        name: F.col(a) * F.col(b) for name, (a, b) in products.items() if {a, b} <= present})


def add_age_bin(df: DataFrame, age: str = "age") -> DataFrame:
    return df.withColumn("age_bin", age_bin(F.col(age)))


def derived_features(df: DataFrame) -> DataFrame:
    """The features computed for a scoring request (prefix families, no target)."""
    out = add_overall_families(df, "prefix")
    out = add_interactions(add_ratios(out, UTILIZATION))
    return add_age_bin(out) if "age" in df.columns else out


def engineer_features(df: DataFrame) -> DataFrame:
    """All target-free features of the ensemble trainer."""
    out = add_repayment_behaviour(add_overall_families(df))
    out = add_interactions(add_ratios(out, {**UTILIZATION, **PER_INQUIRY}))
    return add_age_bin(out) if "age" in df.columns else out


def frequency(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the number of rows sharing the column's value; a missing value counts as 'nan'.

    Values are counted first (combined before the shuffle) and stored, so the join
    is a broadcast when the table of values is small and an adaptive shuffle join,
    which splits hot values, when it is not.
    """
    key = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("nan"))
    counts = materialize(
        df.groupBy(key.alias("_key")).agg(F.count("*").alias(name)), "frequency")
    return df.join(counts, key == F.col("_key"), "left").drop("_key")


@dataclass(frozen=True)
class Frequency:
    """How many training rows share each value of a column, in a stored table (value, n)."""

    column: str
    name: str
    table: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the count, 0 for a value not seen in training; a count that the row brings along stays.

        An absent column is a missing value, whose count is missing too if training rows had none.
        """
        if self.column not in df.columns:
            df = df.withColumn(self.column, F.lit(None).cast("string"))
        key = F.coalesce(F.col(f"`{self.column}`").cast("string"), F.lit("nan"))
        counts = self.table.select(F.col("value").alias("_value"), F.col("n").alias("_n"))
        joined = df.join(counts, key == F.col("_value"), "left")
        found = F.coalesce("_n", F.when(F.col(f"`{self.column}`").isNotNull(), 0)).cast("double")
        if self.name in df.columns:
            found = F.coalesce(F.col(self.name).cast("double"), found)
        return joined.withColumn(self.name, found).drop("_value", "_n")


def fit_frequency(df: DataFrame, column: str, name: str) -> Frequency:
    key = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("nan"))
    counts = df.groupBy(key.alias("value")).agg(F.count("*").alias("n"))
    return Frequency(column, name, materialize(counts, "frequency"))


def log1p_columns(df: DataFrame, columns: Sequence[str], suffix: str = "_log") -> DataFrame:
    """Add log(1 + x) copies, null where undefined."""
    return df.withColumns({
        f"{c}{suffix}": F.log1p(F.col(c).cast("double")) for c in columns if c in df.columns})


def expm1_column(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.expm1(F.col(column)))


@dataclass(frozen=True)
class MinMax:
    """Bounds of a column, kept with the model that predicts it."""

    low: float
    high: float

    def scale(self, value: Column) -> Column:
        return minmax(value, self.low, self.high)

    def inverse(self, scaled: Column) -> Column:
        return minmax_inverse(scaled, self.low, self.high)


def fit_minmax(df: DataFrame, column: str) -> MinMax:
    row = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    if row["low"] is None:
        raise ValueError(f"no value present in {column}")
    return MinMax(float(row["low"]), float(row["high"]))


def minmax_scale(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, fit_minmax(df, column).scale(F.col(column)))


def fit_income_cut(df: DataFrame, target: str = "target") -> float | None:
    """The median income that separates the two repayment classes."""
    with Stored(df.select(target), "income") as stored:
        return exact_quantiles(stored, {target: [0.5]})[(target, 0.5)]


def label_repayment_status(
    df: DataFrame, cut: float | None = None, target: str = "target", name: str = "repayment_status"
) -> DataFrame:
    """1 where the income reaches the cut (fitted on ``df`` when not given), else 0."""
    cut = fit_income_cut(df, target) if cut is None else cut
    above = F.col(target) >= F.lit(cut)
    return df.withColumn(name, F.when(above, 1).otherwise(0))


def label_repayment_ok(df: DataFrame, target: str = "target", name: str = "repayment_ok") -> DataFrame:
    return df.withColumn(name, F.when(F.col(target) > fv.REPAYMENT_OK_INCOME, 1).otherwise(0))


def enrich_external(
    df: DataFrame, table: DataFrame, key: str, columns: Sequence[str] = tuple(fv.EXTERNAL_COLUMNS)
) -> DataFrame:
    """Left-join real area or behaviour columns that the row lacks, the smallest row of each ``key``."""
    added = [c for c in columns if c in table.columns and c not in df.columns]
    right = one_row_per_key(table.select(F.col(key).alias("_external_key"), *added), "_external_key")
    return df.join(right, F.col(f"`{key}`") == F.col("_external_key"), "left").drop("_external_key")
