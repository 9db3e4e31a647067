"""Feature families, ratios, bands, labels and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.applicants import applicants, table
from ledgerloom.catalog.registry import (
    FAMILY_COLUMNS, numbered, register, sql_count, sql_mean, sql_ratio, sql_std, sql_sum,
)
from ledgerloom.functions import rowwise
from ledgerloom.operators import features
from ledgerloom.operators.columns import numeric_columns
from ledgerloom.operators.impute import missing_indicators

_LOANS = FAMILY_COLUMNS["loan_amt"]
_REPAYMENTS = FAMILY_COLUMNS["repayment"]
_LIMITS = numbered("credit_limit_", range(1, 14))
_BALANCES, _EMIS = FAMILY_COLUMNS["balance"], FAMILY_COLUMNS["total_emi"]
_INQUIRIES = FAMILY_COLUMNS["inquiries"]

# What the regular expression of credit limits finds in the full table.
_LIMITS_REGEX = [*_LIMITS, "active_credit_limit_1"]
# What the substring and prefix forms find.
_LIMITS_SUBSTRING = [*_LIMITS, "active_credit_limit_1", "credit_limit_recent_1"]
_LIMITS_PREFIX = [*_LIMITS, "credit_limit_recent_1"]


@register("select_family", f"""
select unique_id, round({sql_sum(_LIMITS_REGEX)}, 4) as by_regex,
  round({sql_sum(_LIMITS_REGEX)} + case when credit_limit_13 is null then 1 else 0 end, 4)
    as by_regex_with_flags,
  round({sql_sum(_LIMITS_PREFIX)}, 4) as by_prefix,
  round({sql_sum(_LIMITS_SUBSTRING)}, 4) as by_substring from app""")
def select_family(spark, sf_dir):
    df = missing_indicators(applicants(spark, sf_dir), ["credit_limit_13"])
    names = numeric_columns(df)
    pick = rowwise.select_family
    totals = {
        "by_regex": pick(names, "regex", r"credit_limit_\d+"),
        "by_regex_with_flags": pick(names, "regex", r"credit_limit_\d+", exclude_flags=False),
        "by_prefix": pick(names, "prefix", "credit_limit_"),
        "by_substring": pick(names, "substring", "credit_limit"),
    }
    return df.select("unique_id", *[
        F.round(rowwise.row_sum(c), 4).alias(n) for n, c in totals.items()])


def _loan_reducer(name: str, sql: str, make):
    def build(spark, sf_dir):
        return applicants(spark, sf_dir).select("unique_id", make(_LOANS).alias("value"))
    register(name, f"select unique_id, {sql} as value from app")(build)


_loan_reducer("row_sum", sql_sum(_LOANS), rowwise.row_sum)
_loan_reducer("row_mean", sql_mean(_LOANS), rowwise.row_mean)
_loan_reducer("row_max", f"greatest({', '.join(_LOANS)})", rowwise.row_max)
_loan_reducer("row_count", sql_count(_LOANS), rowwise.row_count)
_loan_reducer("row_std", f"round({sql_std(_LOANS)}, 4)", lambda c: F.round(rowwise.row_std(c), 4))

_OVERALL_FAMILIES = {
    "credit_limit": _LIMITS_REGEX, "balance": _BALANCES, "total_emi": _EMIS,
    "inquiries": _INQUIRIES, "loan_amt": _LOANS,
}
_OVERALL = {
    "credit_limit": ("total_credit_limit_overall", "avg_credit_limit_overall"),
    "balance": ("total_balance_overall", "avg_balance_overall"),
    "total_emi": ("total_emi_overall", "avg_emi_overall"),
    "inquiries": ("total_inquiries_overall", "avg_inquiries_overall"),
    "loan_amt": ("total_loan_amount_overall", "avg_loan_amount_overall"),
}
_OVERALL_SQL = ", ".join(
    f"{sql_sum(columns)} as {_OVERALL[f][0]}, {sql_mean(columns)} as {_OVERALL[f][1]}"
    for f, columns in _OVERALL_FAMILIES.items())
_OVERALL_NAMES = [n for pair in _OVERALL.values() for n in pair]
# The twins build on this clause.
_FEATURED = f""", f as (select *, {_OVERALL_SQL}, {sql_mean(_REPAYMENTS)} as avg_repayment from app)"""


def _rounded_sql(columns, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)


def _round(df, columns, digits: int = 4):
    return df.select("unique_id", *[F.round(c, digits).alias(c) for c in columns])


@register("credit_families", _FEATURED + f" select unique_id, {', '.join(_OVERALL_NAMES)} from f")
def credit_families(spark, sf_dir):
    return features.add_overall_families(applicants(spark, sf_dir)).select(
        "unique_id", *_OVERALL_NAMES)


@register("repayment_consistency", f"""
select unique_id, round({sql_mean(_REPAYMENTS)}, 4) as avg_repayment,
  round(1 / (coalesce({sql_std(_REPAYMENTS)}, 0) + cast(1e-6 as double)), 4)
    as repayment_consistency_score from app""")
def repayment_consistency(spark, sf_dir):
    out = features.add_repayment_behaviour(applicants(spark, sf_dir))
    return _round(out, ["avg_repayment", "repayment_consistency_score"])


_SUB_BALANCES = [*_BALANCES, "business_balance"]
_SUB_LOANS = [*_LOANS, "loan_amt_large_tenure", "primary_loan_amt", "loan_amt_recent"]
_SUB_INQUIRIES = ["total_inquiries_1", "total_inquiries_2", "total_inquiries_recent"]
_PROFILE_SQL = f""", p as (select *, {sql_mean(_SUB_BALANCES)} as avg_credit_utilization,
  greatest({', '.join(_SUB_BALANCES)}) as max_credit_utilization,
  {sql_sum(_SUB_LOANS)} as total_loan_amount, {sql_mean(_SUB_LOANS)} as avg_loan_amount,
  cast({sql_count(_SUB_LOANS)} as double) as loan_frequency,
  {sql_sum(_LIMITS_SUBSTRING)} as total_credit_limit, {sql_mean(_LIMITS_SUBSTRING)} as avg_credit_limit,
  {sql_sum(_EMIS)} as total_emi, {sql_mean(_EMIS)} as avg_emi,
  {sql_mean(_REPAYMENTS)} as avg_repayment, {sql_std(_REPAYMENTS)} as repayment_consistency,
  {sql_sum(_SUB_INQUIRIES)} as total_inquiries from app)"""
_PROFILE_NAMES = [
    "avg_credit_utilization", "max_credit_utilization", "total_loan_amount", "avg_loan_amount",
    "loan_frequency", "total_credit_limit", "avg_credit_limit", "total_emi", "avg_emi",
    "avg_repayment", "repayment_consistency", "total_inquiries"]

_PROFILE_EXACT = [c for c in _PROFILE_NAMES if c != "repayment_consistency"]


@register("profile_features", _PROFILE_SQL + f"""
select unique_id, {', '.join(_PROFILE_EXACT)},
  round(repayment_consistency, 4) as repayment_consistency, total_inquiries_recent as recent_inquiries,
  credit_score as credit_risk_score,
  round(avg_credit_utilization / nullif(total_credit_limit, 0), 6) as credit_utilization_ratio,
  total_loan_amount / case when loan_frequency = 0 then 1 else loan_frequency end as avg_loan_size,
  round(1 / (repayment_consistency + 1), 6) as payment_consistency_score,
  age * age as age_squared from p""")
def profile_features(spark, sf_dir):
    out = features.add_profile_features(applicants(spark, sf_dir))
    return out.select(
        "unique_id", *_PROFILE_EXACT,
        F.round("repayment_consistency", 4).alias("repayment_consistency"), "recent_inquiries",
        "credit_risk_score", F.round("credit_utilization_ratio", 6).alias("credit_utilization_ratio"),
        "avg_loan_size",
        F.round("payment_consistency_score", 6).alias("payment_consistency_score"), "age_squared")


_PROFILE_RATIO_NAMES = ["debt_to_income", "income_to_loan_ratio", "income_to_emi_ratio",
                        "credit_utilization_ratio", "payment_to_income_ratio"]


@register("target_ratios", _PROFILE_SQL + f"""
select unique_id, round(total_emi / nullif(target, 0), 6) as debt_to_income,
  round({sql_ratio('target', 'total_loan_amount', '1')}, 6) as income_to_loan_ratio,
  round({sql_ratio('target', 'total_emi', '1')}, 6) as income_to_emi_ratio,
  round({sql_ratio('avg_credit_utilization', 'total_credit_limit', '1')}, 6)
    as credit_utilization_ratio,
  round({sql_ratio('avg_repayment', 'target', '1')}, 6) as payment_to_income_ratio from p""")
def target_ratios(spark, sf_dir):
    out = features.add_target_ratios(features.add_profile_features(applicants(spark, sf_dir)))
    return _round(out, _PROFILE_RATIO_NAMES, 6)


_UTILIZATION_SQL = ", ".join(
    f"round({sql_ratio(top, bottom)}, 6) as {name}"
    for name, (top, bottom, _) in features.UTILIZATION.items())


@register("utilization_ratios", _FEATURED + f" select unique_id, {_UTILIZATION_SQL} from f")
def utilization_ratios(spark, sf_dir):
    out = features.add_overall_families(applicants(spark, sf_dir))
    return _round(features.add_ratios(out, features.UTILIZATION), list(features.UTILIZATION), 6)


@register("income_ratios", _FEATURED + f"""
select unique_id, round({sql_ratio('total_emi_overall', 'target')}, 6) as debt_to_income_ratio,
  {sql_ratio('target', 'total_emi_overall')} as income_to_emi_ratio,
  round({sql_ratio('target', 'total_loan_amount_overall')}, 6) as income_to_loan_ratio,
  round({sql_ratio('avg_repayment', 'target')}, 6) as payment_to_income_ratio
from f""")
def income_ratios(spark, sf_dir):
    out = features.add_repayment_behaviour(features.add_overall_families(applicants(spark, sf_dir)))
    specs = features.income_ratios()
    # A row without any instalment divides by 1e-6: too large a value to round.
    return features.add_ratios(out, specs).select("unique_id", "income_to_emi_ratio", *[
        F.round(c, 6).alias(c) for c in specs if c != "income_to_emi_ratio"])


@register("inquiry_ratios", _FEATURED + f"""
select unique_id, round({sql_ratio('total_emi_overall', 'total_inquiries_overall')}, 2)
    as emi_per_inquiry_ratio,
  round({sql_ratio('total_loan_amount_overall', 'total_inquiries_overall')}, 2)
    as loan_amount_per_inquiry_ratio from f""")
def inquiry_ratios(spark, sf_dir):
    out = features.add_overall_families(applicants(spark, sf_dir))
    return _round(features.add_ratios(out, features.PER_INQUIRY), list(features.PER_INQUIRY), 2)


@register("interactions", _FEATURED + """
select unique_id, age * total_inquiries_overall as age_x_total_inquiries_overall,
  total_emi_overall * credit_score as total_emi_overall_x_credit_score from f""")
def interactions(spark, sf_dir):
    out = features.add_interactions(features.add_overall_families(applicants(spark, sf_dir)))
    return out.select(
        "unique_id", "age_x_total_inquiries_overall", "total_emi_overall_x_credit_score")


_AGE_SQL = """case when {a} < 0 then null when {a} < 25 then '<25' when {a} < 35 then '25-34'
  when {a} < 45 then '35-44' when {a} < 55 then '45-54' when {a} is not null then '55+' end"""


@register("age_bin", f"select unique_id, age, {_AGE_SQL.format(a='age')} as age_bin from app")
def age_bin(spark, sf_dir):
    return features.add_age_bin(applicants(spark, sf_dir).select("unique_id", "age"))


_PREFIX = {
    "credit_limit": _LIMITS_PREFIX, "balance": _BALANCES, "total_emi": _EMIS,
    "inquiries": [*_INQUIRIES, "total_inquiries_recent"], "loan_amt": [
        *_LOANS, "loan_amt_large_tenure", "loan_amt_recent"],
}
DERIVED_SQL = ", d as (select *, " + ", ".join(
    f"{sql_sum(columns)} as {_OVERALL[f][0]}, {sql_mean(columns)} as {_OVERALL[f][1]}"
    for f, columns in _PREFIX.items()) + " from app)"
DERIVED_NAMES = [*_OVERALL_NAMES, *features.UTILIZATION, "age_x_total_inquiries_overall",
                 "total_emi_overall_x_credit_score"]


@register("derived_features", DERIVED_SQL + f"""
select unique_id, {', '.join(_OVERALL_NAMES)}, {_UTILIZATION_SQL},
  age * total_inquiries_overall as age_x_total_inquiries_overall,
  total_emi_overall * credit_score as total_emi_overall_x_credit_score,
  {_AGE_SQL.format(a='age')} as age_bin from d""")
def derived_features(spark, sf_dir):
    out = features.derived_features(applicants(spark, sf_dir))
    return out.select("unique_id", *[
        F.round(c, 6).alias(c) if c in features.UTILIZATION else F.col(c) for c in DERIVED_NAMES
    ], "age_bin")


@register("pin_code_frequency", """, counts as (
  select "pin code" as pin, count(*) as n from app group by 1)
select unique_id, n as pin_code_frequency from app join counts on "pin code" = pin""")
def pin_code_frequency(spark, sf_dir):
    df = applicants(spark, sf_dir).select("unique_id", "pin code")
    return features.frequency(df, "pin code", "pin_code_frequency").drop("pin code")


@register("city_frequency", """, counts as (
  select coalesce(city, 'nan') as place, count(*) as n from app group by 1)
select unique_id, city, n as city_frequency from app join counts on coalesce(city, 'nan') = place""")
def city_frequency(spark, sf_dir):
    return features.frequency(
        applicants(spark, sf_dir).select("unique_id", "city"), "city", "city_frequency")


@register("log1p_columns", _PROFILE_SQL + """
select unique_id, round(ln(1 + target), 6) as target_log,
  round(ln(1 + total_loan_amount), 6) as total_loan_amount_log,
  round(ln(1 + total_emi), 6) as total_emi_log from p""")
def log1p_columns(spark, sf_dir):
    out = features.add_profile_features(applicants(spark, sf_dir))
    return _round(features.log1p_columns(out, ["target", "total_loan_amount", "total_emi", "income"]),
                  ["target_log", "total_loan_amount_log", "total_emi_log"], 6)


@register("expm1_column", """
select unique_id, round(exp(credit_score / 100) - 1, 4) as income from app""")
def expm1_column(spark, sf_dir):
    df = applicants(spark, sf_dir).select("unique_id", (F.col("credit_score") / 100).alias("log_income"))
    return _round(features.expm1_column(df, "log_income", "income"), ["income"])


@register("minmax_scale", """, b as (select min(target) as low, max(target) as high from app)
select unique_id, round((target - low) / (high - low), 6) as scaled,
  round((target - low) / (high - low) * (high - low) + low, 2) as restored from app, b""")
def minmax_scale(spark, sf_dir):
    df = applicants(spark, sf_dir).select("unique_id", "target")
    bounds = features.fit_minmax(df, "target")
    scaled = bounds.scale(F.col("target"))
    return df.select("unique_id", F.round(scaled, 6).alias("scaled"),
                     F.round(bounds.inverse(scaled), 2).alias("restored"))


@register("label_repayment_status", """
select unique_id, case when target >= (select quantile_cont(target, 0.5) from app) then 1 else 0 end
  as repayment_status from app""")
def label_repayment_status(spark, sf_dir):
    df = applicants(spark, sf_dir).select("unique_id", "target")
    return features.label_repayment_status(df).drop("target")


@register("label_repayment_ok", """
select unique_id, case when target > 50000 then 1 else 0 end as repayment_ok from app""")
def label_repayment_ok(spark, sf_dir):
    df = applicants(spark, sf_dir).select("unique_id", "target")
    return features.label_repayment_ok(df).drop("target")


@register("enrich_external", """, area as (
  select cast(s_nationkey as varchar) as area_pin, count(*) as market_density_score,
    round(avg(s_acctbal), 4) as local_literacy_rate from supplier group by 1),
behaviour as (
  select user_id, count(*) as upi_transaction_frequency,
    count(distinct event_type) as app_diversity_count from events group by 1)
select unique_id, market_density_score, local_literacy_rate, upi_transaction_frequency,
  app_diversity_count
from app left join area on "pin code" = area_pin left join behaviour on unique_id = user_id""")
def enrich_external(spark, sf_dir):
    area = table(spark, sf_dir, "supplier").groupBy(
        F.col("s_nationkey").cast("string").alias("area")
    ).agg(F.count("*").alias("market_density_score"),
          F.round(F.avg("s_acctbal"), 4).alias("local_literacy_rate"))
    behaviour = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("upi_transaction_frequency"),
        F.count_distinct("event_type").alias("app_diversity_count"),
    ).withColumnRenamed("user_id", "unique_id")
    df = applicants(spark, sf_dir).select("unique_id", F.col("pin code").alias("area"))
    with_area = features.enrich_external(df, area, "area")
    return features.enrich_external(with_area, behaviour, "unique_id").drop("area")
