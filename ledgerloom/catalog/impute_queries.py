"""Imputation: the whole rule set, each kind of rule, lookups, dates and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.catalog.applicants import applicants, raw_applicants, raw_names, table
from ledgerloom.catalog.registry import register
from ledgerloom.operators import impute


def _rules(*columns: str) -> impute.ImputeRules:
    return impute.ImputeRules([r for r in impute.rules_by_id() if r.column in columns])


# The twins of the rule sets are written out here and share nothing with the rules' code:
# first, in order, what each column's gap becomes; a fill sees the columns filled before it.

_MODE = "(select {c} from {t} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
_MEDIAN = "(select quantile_cont({c}, 0.5) from {t})"


def _zeros(*names: str) -> list[tuple[str, str]]:
    return [(name, "0") for name in names]


def _copies(source: str, *names: str) -> list[tuple[str, str]]:
    return [(name, source) for name in names]


_AMOUNTS_BY_ID = ["var_6", "var_7", "var_20", "var_24", "var_31", "var_41", "var_50", "var_61", "var_72"]


def _positive(columns) -> str:
    return " + ".join(f"case when {c} > 0 then 1 else 0 end" for c in columns)


_FILLS_BY_ID = [
    ("age", "case when target_income > 50000 then (select avg(age) from raw) else 30 end"),
    ("var_0", "target_income / 8"), ("var_1", "var_0 * 0.4"),
    ("var_2", "4 * target_income"), ("var_3", "var_2 / 2"),
    ("var_4", "case when target_income > (select quantile_cont(target_income, 0.75) from raw)"
              " then (select quantile_cont(var_4, 0.5) from raw) else 0 end"),
    *_zeros("var_5"), ("var_6", "target_income * 30"), ("var_7", "var_6 * 0.4"),
    ("var_8", "case when target_income > 60000 then target_income * 2.5 else 0 end"),
    ("var_9", "var_6 * 0.008"), *_zeros("var_10", "var_14"),
    ("var_15", "case when age < 35 then 3 else 1 end"),
    *_zeros("var_16", "var_17", "var_18", "var_19", "var_20", "var_21", "var_22", "var_24", "var_25", "var_26",
            "var_27", "var_30", "var_31"),
    ("var_32", "case when target_income > 50000 and age > 30 then 750 else 675 end"),
    *_zeros("var_35", "var_36"), ("var_37", "case when var_32 > 700 then 1 else 0 end"), *_zeros("var_38"),
    ("var_40", "case when age > 40 then var_53 / 2 else 0 end"),
    *_zeros("var_41", "var_42", "var_43"), *_copies("var_37", "var_44"), *_zeros("var_47"),
    *_copies("var_37", "var_48"), *_zeros("var_49", "var_50", "var_51"), *_copies("var_37", "var_52"),
    ("var_53", _positive(_AMOUNTS_BY_ID)), *_zeros("var_54", "var_55", "var_56"),
    *_copies("var_53", "var_57"), *_copies("var_37", "var_58", "var_59"), *_zeros("var_60", "var_61", "var_62"),
    *_copies("var_37", "var_63", "var_64"), *_copies("var_53", "var_65", "var_66"), *_zeros("var_68"),
    *_copies("var_37", "var_69"), *_copies("var_53", "var_70"), *_zeros("var_71", "var_72"),
    *_copies("var_37", "var_73"),
    ("gender", "case when target_income > 40000 then 'Male' else " + _MODE.format(c="gender", t="raw") + " end"),
    ("city", _MODE.format(c="city", t="raw")), ("state", _MODE.format(c="state", t="raw")),
    ("residence_ownership", "case when target_income > 60000 and age > 35 then 'SELF-OWNED' else 'RENTED' end"),
    ("device_model", "case when target_income > 50000 then 'iPhone' else 'Generic Android' end"),
    ("device_category", "case when regexp_matches(device_model, '(?i)iphone|samsung') then 'SMART PHONE'"
                        " else 'FEATURE PHONE' end"),
    ("platform", "case when regexp_matches(device_model, '(?i)iphone') then 'IOS' else 'Android' end"),
    ("device_manufacturer", "case when regexp_matches(device_model, '(?i)iphone') then 'Apple' else 'Samsung' end"),
    ("marital_status", "case when age > 28 then 'Married' else 'Single' end"),
    ("var_74", "case when var_32 > 700 then 'Low Risk' else 'Medium Risk' end"), ("var_75", "'Primary Score'"),
]

_LOANS = [f"loan_amt_{i}" for i in range(1, 10)]
_FILLS_BY_MEANING = [
    ("age", "case when target > 50000 then (select avg(age) from app) else 30 end"),
    ("balance_1", "target / 8"), ("balance_2", "balance_1 * 0.4"),
    ("credit_limit_1", "4 * target"), ("credit_limit_2", "credit_limit_1 / 2"),
    ("balance_3", "case when target > (select quantile_cont(target, 0.75) from app)"
                  " then (select quantile_cont(balance_3, 0.5) from app) else 0 end"),
    ("loan_amt_1", "target * 30"), ("loan_amt_2", "loan_amt_1 * 0.4"),
    ("business_balance", "case when target > 60000 then target * 2.5 else 0 end"),
    ("total_emi_1", "loan_amt_1 * 0.008"), ("total_inquiries_1", "case when age < 35 then 3 else 1 end"),
    ("credit_score", "case when target > 50000 and age > 30 then 750 else 675 end"),
    ("repayment_1", "case when credit_score > 700 then 1 else 0 end"),
    *_zeros(*[f"balance_{i}" for i in range(4, 13)], *[f"credit_limit_{i}" for i in range(3, 14)], *_LOANS[2:],
            *[f"total_emi_{i}" for i in range(2, 8)], "total_inquiries_2", *[f"total_inquires_{i}" for i in range(3, 7)]),
    *_copies("repayment_1", *[f"repayment_{i}" for i in range(2, 11)]),
    ("total_loans_1", _positive(_LOANS)),
    *_copies("total_loans_1", "total_loans_2", "total_loans_2_dup1", "total_loans_3", "total_loans_4", "total_loans_5"),
    ("closed_loan", "case when age > 40 then total_loans_1 / 2 else 0 end"),
    ("gender", "case when target > 40000 then 'Male' else " + _MODE.format(c="gender", t="app") + " end"),
    ("residence_ownership", "case when target > 60000 and age > 35 then 'SELF-OWNED' else 'RENTED' end"),
    ("device_model", "case when target > 50000 then 'iPhone' else 'Generic Android' end"),
    ("platform", "case when regexp_matches(device_model, '(?i)iphone') then 'IOS' else 'Android' end"),
    ("score_comments", "case when credit_score > 700 then 'Low Risk' else 'Medium Risk' end"),
]


def _chain(fills, source: str) -> tuple[str, str]:
    """One WITH clause per fill, in order; the name of the last one."""
    clauses, last = [], source
    for number, (column, fill) in enumerate(fills):
        clauses.append(f"{source}_step{number} as materialized (select * replace "
                       f"(coalesce({column}, {fill}) as {column}) from {last})")
        last = f"{source}_step{number}"
    return ", " + ",\n".join(clauses), last


RAW_FILLED, RAW_LAST = _chain(_FILLS_BY_ID, "raw")
_ID_CHAIN, _ID_LAST = RAW_FILLED, RAW_LAST
_MEANING_NAMES = list(raw_names().values())
_MEANING_CHAIN, _MEANING_LAST = _chain(_FILLS_BY_MEANING, "app")


def _rounded_sql(columns, text=()) -> str:
    return ", ".join(c if c in text else f"round({c}, 8) as {c}" for c in columns)


def _rounded(df, columns):
    return df.select("*") if not columns else df.withColumns({c: F.round(c, 8) for c in columns})


@register("impute_rules_numeric", _ID_CHAIN + f"""
select id, {_rounded_sql(fv.IMPUTED_NUMERIC)} from {_ID_LAST}""")
def impute_rules_numeric(spark, sf_dir):
    raw = raw_applicants(spark, sf_dir)
    filled = impute.ImputeRules(impute.rules_by_id()).fit(raw).transform(raw)
    return _rounded(filled.select("id", *fv.IMPUTED_NUMERIC), fv.IMPUTED_NUMERIC)


@register("impute_rules_text", _ID_CHAIN + f"""
select id, {', '.join(fv.IMPUTED_TEXT)} from {_ID_LAST}""")
def impute_rules_text(spark, sf_dir):
    raw = raw_applicants(spark, sf_dir)
    filled = impute.ImputeRules(impute.rules_by_id()).fit(raw).transform(raw)
    return filled.select("id", *fv.IMPUTED_TEXT)


_MEANING_NUMERIC = [r.column for r in impute.rules_by_meaning()
                    if r.numeric and r.column in _MEANING_NAMES]


@register("impute_rules_by_meaning", _MEANING_CHAIN + f"""
select unique_id, {_rounded_sql(_MEANING_NUMERIC)}, gender, residence_ownership, platform,
  score_comments from {_MEANING_LAST}""")
def impute_rules_by_meaning(spark, sf_dir):
    df = applicants(spark, sf_dir)
    filled = impute.ImputeRules(impute.rules_by_meaning()).fit(df).transform(df)
    return _rounded(filled.select("unique_id", *_MEANING_NUMERIC, "gender", "residence_ownership",
                                  "platform", "score_comments"), _MEANING_NUMERIC)


@register("constant_fill", """
select id, coalesce(var_18, 0) as var_18, coalesce(var_5, 0) as var_5, coalesce(var_72, 0) as var_72,
  coalesce(var_56, 0) as var_56, coalesce(var_71, 0) as var_71 from raw""")
def constant_fill(spark, sf_dir):
    columns = ["var_18", "var_5", "var_72", "var_56", "var_71"]
    raw = raw_applicants(spark, sf_dir).select("id", *columns)
    return _rules(*columns).fit(raw).transform(raw)


@register("scaled_source_fill", """
select id, var_0, round(coalesce(var_1, var_0 * 0.4), 8) as var_1,
  round(coalesce(var_3, var_2 * 0.5), 8) as var_3, round(coalesce(var_7, var_6 * 0.4), 8) as var_7,
  round(coalesce(var_9, var_6 * 0.008), 8) as var_9 from raw""")
def scaled_source_fill(spark, sf_dir):
    raw = raw_applicants(spark, sf_dir)
    filled = _rules("var_1", "var_3", "var_7", "var_9").fit(raw).transform(raw)
    return _rounded(filled.select("id", "var_0", "var_1", "var_3", "var_7", "var_9"),
                    ["var_1", "var_3", "var_7", "var_9"])


@register("target_scaled_fill", """
select id, round(coalesce(var_0, target_income * 0.125), 8) as var_0,
  round(coalesce(var_2, target_income * 4), 8) as var_2,
  round(coalesce(var_6, target_income * 30), 8) as var_6 from raw""")
def target_scaled_fill(spark, sf_dir):
    raw = raw_applicants(spark, sf_dir).select("id", "var_0", "var_2", "var_6", "target_income")
    filled = _rules("var_0", "var_2", "var_6").fit(raw).transform(raw)
    return _rounded(filled.drop("target_income"), ["var_0", "var_2", "var_6"])


@register("target_scaled_fill_without_target", """
select id, round(coalesce(var_0, (select quantile_cont(var_0, 0.5) from raw)), 8) as var_0,
  round(coalesce(var_2, (select quantile_cont(var_2, 0.5) from raw)), 8) as var_2,
  round(coalesce(var_6, 0), 8) as var_6 from raw""")
def target_scaled_fill_without_target(spark, sf_dir):
    raw = raw_applicants(spark, sf_dir).select("id", "var_0", "var_2", "var_6")
    filled = _rules("var_0", "var_2", "var_6").fit(raw).transform(raw)
    return _rounded(filled, ["var_0", "var_2", "var_6"])


@register("threshold_fill", """, a as (
  select *, coalesce(age, case when target_income > 50000 then (select avg(age) from raw) else 30 end)
    as age_filled from raw),
s as (
  select *, coalesce(var_32, case when target_income > 50000 and age_filled > 30 then 750 else 675 end)
    as score_filled from a)
select id, round(age_filled, 8) as age,
  coalesce(var_8, case when target_income > 60000 then target_income * 2.5 else 0 end) as var_8,
  coalesce(var_15, case when age_filled < 35 then 3 else 1 end) as var_15,
  score_filled as var_32,
  coalesce(var_37, case when score_filled > 700 then 1 else 0 end) as var_37,
  round(coalesce(var_40, case when age_filled > 40 then var_53 * 0.5 else 0 end), 8) as var_40
from s""")
def threshold_fill(spark, sf_dir):
    columns = ["age", "var_8", "var_15", "var_32", "var_37", "var_40"]
    raw = raw_applicants(spark, sf_dir)
    filled = _rules(*columns).fit(raw).transform(raw)
    return _rounded(filled.select("id", *columns), ["age", "var_40"])


@register("quantile_gated_median", """
select id, round(coalesce(var_4, case
  when target_income > (select quantile_cont(target_income, 0.75) from raw)
  then (select quantile_cont(var_4, 0.5) from raw) else 0 end), 8) as var_4 from raw""")
def quantile_gated_median(spark, sf_dir):
    raw = raw_applicants(spark, sf_dir).select("id", "var_4", "target_income")
    return _rounded(_rules("var_4").fit(raw).transform(raw).drop("target_income"), ["var_4"])


@register("copy_fill", """
select id, coalesce(var_44, var_37) as var_44, coalesce(var_73, var_37) as var_73,
  coalesce(var_57, var_53) as var_57, coalesce(var_66, var_53) as var_66 from raw""")
def copy_fill(spark, sf_dir):
    raw = raw_applicants(spark, sf_dir)
    filled = _rules("var_44", "var_73", "var_57", "var_66").fit(raw).transform(raw)
    return filled.select("id", "var_44", "var_73", "var_57", "var_66")


@register("count_positive_fill", """
select id, coalesce(var_53, """ + " + ".join(
    f"case when {c} > 0 then 1 else 0 end" for c in fv.LOAN_AMOUNT_IDS) + """) as var_53 from raw""")
def count_positive_fill(spark, sf_dir):
    raw = raw_applicants(spark, sf_dir).select("id", "var_53", *fv.LOAN_AMOUNT_IDS)
    return _rules("var_53").fit(raw).transform(raw).select("id", "var_53")


_MEDIANS = [c for c in _MEANING_NAMES if c not in fv.TEXT_COLUMNS and c != "unique_id"]


@register("median_fill", "select unique_id, " + ", ".join(
    f"round(coalesce({c}, (select quantile_cont({c}, 0.5) from app)), 8) as {c}" for c in _MEDIANS)
    + " from app")
def median_fill(spark, sf_dir):
    df = applicants(spark, sf_dir).select("unique_id", *_MEDIANS)
    return _rounded(impute.fit_medians(df, _MEDIANS).transform(df), _MEDIANS)


@register("mean_fill", "select unique_id, " + ", ".join(
    f"round(coalesce({c}, (select avg({c}) from app)), 5) as {c}" for c in _MEDIANS) + " from app")
def mean_fill(spark, sf_dir):
    df = applicants(spark, sf_dir).select("unique_id", *_MEDIANS)
    means = impute.fit_means(df, _MEDIANS).transform(df)
    return means.withColumns({c: F.round(c, 5) for c in _MEDIANS})  # sums of large amounts differ by order beyond


_MODES = [c for c in _MEANING_NAMES if c in fv.TEXT_COLUMNS]


@register("mode_fill", "select unique_id, " + ", ".join(
    f'coalesce("{c}", ' + _MODE.format(c=f'"{c}"', t="app") + f') as "{c}"' for c in _MODES) + " from app")
def mode_fill(spark, sf_dir):
    df = applicants(spark, sf_dir).select("unique_id", *[F.col(f"`{c}`") for c in _MODES])
    return impute.fit_modes(df, _MODES).transform(df)


@register("constant_category", """
select unique_id, coalesce(device_model, 'Missing') as device_model,
  coalesce(gender, 'Unknown') as gender from app""")
def constant_category(spark, sf_dir):
    df = applicants(spark, sf_dir).select("unique_id", "device_model", "gender")
    return impute.fill_constants(df, {"device_model": "Missing", "gender": "Unknown"})


@register("text_threshold_rules", """
select id,
  coalesce(marital_status, case when age > 28 then 'Married' else 'Single' end) as marital_status,
  coalesce(gender, case when target_income > 40000 then 'Male' else (
    select gender from raw where gender is not null group by gender order by count(*) desc, gender
    limit 1) end) as gender,
  coalesce(residence_ownership, case when target_income > 60000 and age > 35 then 'SELF-OWNED'
    else 'RENTED' end) as residence_ownership,
  coalesce(device_model, case when target_income > 50000 then 'iPhone' else 'Generic Android' end)
    as device_model,
  coalesce(var_74, case when var_32 > 700 then 'Low Risk' else 'Medium Risk' end) as var_74,
  coalesce(var_75, 'Primary Score') as var_75
from raw""")
def text_threshold_rules(spark, sf_dir):
    columns = ["marital_status", "gender", "residence_ownership", "device_model", "var_74", "var_75"]
    raw = raw_applicants(spark, sf_dir)
    return _rules(*columns).fit(raw).transform(raw).select("id", *columns)


@register("text_pattern_rules", """
select id, device_model,
  coalesce(device_category, case when regexp_matches(device_model, '(?i)iphone|samsung')
    then 'SMART PHONE' else 'FEATURE PHONE' end) as device_category,
  coalesce(platform, case when regexp_matches(device_model, '(?i)iphone') then 'IOS'
    else 'Android' end) as platform,
  coalesce(device_manufacturer, case when regexp_matches(device_model, '(?i)iphone') then 'Apple'
    else 'Samsung' end) as device_manufacturer
from raw""")
def text_pattern_rules(spark, sf_dir):
    columns = ["device_model", "device_category", "platform", "device_manufacturer"]
    raw = raw_applicants(spark, sf_dir).select("id", *columns)
    return _rules(*columns[1:]).fit(raw).transform(raw)


def _places(spark, sf_dir):
    """A pin lookup from the nation and region tables."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.where(F.col("n_nationkey") % 4 != 0).join(
        region, nation.n_regionkey == region.r_regionkey
    ).select(F.col("n_nationkey").alias("pin"), F.col("n_name").alias("city"), F.col("r_name").alias("state"))


_MODE_PLACE = ("(select {c} from app where {c} is not null group by {c} "
               "order by count(*) desc, {c} limit 1)")


@register("impute_from_lookup", f""", places as (
  select n_nationkey as pin, n_name as place_city, r_name as place_state
  from nation join region on n_regionkey = r_regionkey where n_nationkey % 4 <> 0)
select unique_id, coalesce(city, place_city, {_MODE_PLACE.format(c='city')}) as city,
  coalesce(state, place_state, {_MODE_PLACE.format(c='state')}) as state
from app left join places on "pin code" = cast(pin as varchar)""")
def impute_from_lookup(spark, sf_dir):
    df = applicants(spark, sf_dir).select(
        "unique_id", F.col("pin code").alias("pin"), "city", "state")
    return impute.impute_from_lookup(
        df, _places(spark, sf_dir), "pin", ["city", "state"]).drop("pin")


@register("date_fill", f"""
select unique_id, coalesce(last_updated, timestamp '{fv.IMPUTATION_TIMESTAMP_UTC}') as last_updated,
  coalesce(transaction_date, timestamp '{fv.IMPUTATION_TIMESTAMP_UTC}') as transaction_date
from app""")
def date_fill(spark, sf_dir):
    return impute.fill_dates(
        applicants(spark, sf_dir).select("unique_id", "last_updated", "transaction_date"))


@register("stamp_imputation", f"""
select unique_id, timestamp '{fv.IMPUTATION_TIMESTAMP_UTC}' as imputation_timestamp from app""")
def stamp_imputation(spark, sf_dir):
    return impute.stamp_imputation(applicants(spark, sf_dir).select("unique_id"))


@register("anonymize", """
select id, sha256(pin) as pin_anonymized, sha256(concat('pepper', pin)) as pin_salted from raw""")
def anonymize(spark, sf_dir):
    raw = raw_applicants(spark, sf_dir).select("id", "pin")
    return impute.anonymize(impute.anonymize(raw, "pin"), "pin", "pin_salted", "pepper").drop("pin")


_ALL_FILLED = [c for c in fv.IMPUTED_NUMERIC if c != "age"]


@register("impute_applicants", _ID_CHAIN + f"""
select id, pin, round(age, 8) as age, {_rounded_sql(_ALL_FILLED)}, {', '.join(fv.IMPUTED_TEXT)},
  target_income,
  coalesce(last_updated, timestamp '{fv.IMPUTATION_TIMESTAMP_UTC}') as last_updated,
  coalesce(transaction_date, timestamp '{fv.IMPUTATION_TIMESTAMP_UTC}') as transaction_date,
  timestamp '{fv.IMPUTATION_TIMESTAMP_UTC}' as imputation_timestamp, sha256(pin) as pin_anonymized
from {_ID_LAST}""")
def impute_applicants(spark, sf_dir):
    """No pin of these tables is in the fixed five-row lookup, so places get their modes."""
    filled = impute.impute_applicants(raw_applicants(spark, sf_dir, dates=True))
    columns = ["id", "pin", "age", *_ALL_FILLED, *fv.IMPUTED_TEXT, "target_income", "last_updated",
               "transaction_date", "imputation_timestamp", "pin_anonymized"]
    return _rounded(filled.select(*columns), ["age", *_ALL_FILLED])
