"""Sources, sinks, column layout, filters and request checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.applicants import applicants, raw_applicants, raw_names
from ledgerloom.catalog.registry import register
from ledgerloom.fixed_values import DEFAULT_MAPPING, TEXT_COLUMNS
from ledgerloom.operators import columns as cols
from ledgerloom.operators import validate
from ledgerloom.operators.impute import missing_indicators
from ledgerloom.operators.profile import missing_profile
from ledgerloom.operators.split import assign_batches
from ledgerloom.plans.shared import fresh_path
from ledgerloom.sources import applicants as source

_RAW = list(raw_names())
_DESCRIPTIVE = list(raw_names().values())


@register("read_applicants", f"""
select {', '.join('case when id % 50 <> 0 then var_8 end as var_8' if c == 'var_8' else c for c in _RAW)}
from raw""")
def read_applicants(spark, sf_dir):
    path = fresh_path(spark, "applicants-csv")
    raw = raw_applicants(spark, sf_dir)
    infinite = F.when(F.col("id") % 50 == 0, F.lit(float("inf"))).otherwise(F.col("var_8"))
    source.write_table(raw.withColumn("var_8", infinite), path, "csv")
    return source.read_applicants(spark, path)


@register("read_requests", """
select unique_id, age, gender, marital_status, city, state, residence_ownership, credit_score,
  loan_amt_1, cast(null as double) as threshold from app""")
def read_requests(spark, sf_dir):
    path = fresh_path(spark, "requests")
    rows = applicants(spark, sf_dir).select(
        "unique_id", "age", "gender", "marital_status", "city", "state", "residence_ownership",
        "credit_score", "loan_amt_1", F.lit("dropped").alias("unknown_key"))
    source.write_table(rows, path, "json")
    return source.read_requests(spark, path).select(
        "unique_id", "age", "gender", "marital_status", "city", "state", "residence_ownership",
        "credit_score", "loan_amt_1", "threshold")


@register("rename_by_mapping", "select " + ", ".join(
    '"pin code" as pin_code' if c == "pin code" else c for c in _DESCRIPTIVE) + " from app")
def rename_by_mapping(spark, sf_dir):
    mapping = source.read_mapping(spark)
    renamed = cols.rename_by_mapping(raw_applicants(spark, sf_dir), mapping)
    return cols.dedupe_column_names(renamed).withColumnRenamed("pin code", "pin_code")


@register("rename_by_mapping_reverse", """
select unique_id as id, age, balance_1 as var_0, total_loans_2 as var_60, loan_amt_9 as var_72,
  target as target_income, cast(unique_id + 1 as bigint) as other from app""")
def rename_by_mapping_reverse(spark, sf_dir):
    df = applicants(spark, sf_dir).select(
        "unique_id", "age", "balance_1", "total_loans_2", "loan_amt_9", "target",
        (F.col("unique_id") + 1).alias("other"))
    return cols.rename_by_mapping(df, source.read_mapping(spark), reverse=True)


@register("default_mapping", """
select var_0 as balance_1, var_1 as balance_2, var_2 as credit_limit_1, var_3, age, gender,
  marital_status, city, state, residence_ownership from raw""")
def default_mapping(spark, sf_dir):
    mapping = source.read_mapping(spark, f"{sf_dir}/no_such_mapping.csv")
    return cols.rename_by_mapping(
        raw_applicants(spark, sf_dir).select(*list(DEFAULT_MAPPING)[:3], "var_3", *list(DEFAULT_MAPPING)[3:]),
        mapping)


@register("dedupe_column_names", """
select unique_id, total_loans_2, total_loans_2_dup1, total_loans_3 as total_loans_2_dup2 from app""")
def dedupe_column_names(spark, sf_dir):
    df = applicants(spark, sf_dir).select(
        "unique_id", "total_loans_2", "total_loans_2_dup1", "total_loans_3")
    return cols.dedupe_column_names(
        df.toDF("unique_id", "total_loans_2", "total_loans_2", "total_loans_2"))


_DROPPED = {"unique_id", "pin code", "score_comments", "score_type", "device_model",
            "device_category", "platform", "device_manufacturer"}


@register("drop_identifiers", "select " + ", ".join(
    c for c in _DESCRIPTIVE if c not in _DROPPED) + " from app")
def drop_identifiers(spark, sf_dir):
    return cols.drop_identifiers(applicants(spark, sf_dir).select(
        *[F.col(f"`{c}`") for c in _DESCRIPTIVE]))


@register("require_columns", "select unique_id, target from app")
def require_columns(spark, sf_dir):
    df = cols.require_columns(applicants(spark, sf_dir), ["unique_id", "target"])
    return df.select("unique_id", "target")


_SCORE_TEXT = """case when unique_id % 10 = 3 then 'n/a'
    when unique_id % 10 = 4 then concat(cast(credit_score as varchar), ' ')
    else cast(credit_score as varchar) end"""


def _score_text():
    text = F.col("credit_score").cast("string")
    return (F.when(F.col("unique_id") % 10 == 3, "n/a")
            .when(F.col("unique_id") % 10 == 4, F.concat(text, F.lit(" "))).otherwise(text))


_TYPED_TEXT = [c for c in _DESCRIPTIVE if c in TEXT_COLUMNS]
_TYPED_SQL = {**{c: f'"{c}"' for c in _TYPED_TEXT}, "score_text": _SCORE_TEXT}
_TYPED_NUMBERS = [c for c in _DESCRIPTIVE if c not in TEXT_COLUMNS]


@register("classify_columns", ", t as (select " + ", ".join(
    f"{text} as c{i}" for i, text in enumerate(_TYPED_SQL.values())) + """ from app),
parsed as (select """ + ", ".join(
    f"count(c{i}) as n{i}, count(try_cast(trim(c{i}) as double)) as p{i}" for i in range(len(_TYPED_SQL))) + """ from t),
kinds as (""" + " union all ".join(
    f"select '{c}' as column_name, p{i} = n{i} as all_numeric, p{i} > 0 as any_numeric from parsed"
    for i, c in enumerate(_TYPED_SQL)) + """)
select column_name, 'categorical' as by_dtype,
  case when all_numeric then 'numeric' else 'categorical' end as by_all_parse,
  case when any_numeric then 'numeric' else 'categorical' end as by_any_parse from kinds
""" + " ".join(f"union all select '{c}', 'numeric', 'numeric', 'numeric'" for c in _TYPED_NUMBERS))
def classify_columns(spark, sf_dir):
    """All columns, and the score as text with some values that are no numbers."""
    df = applicants(spark, sf_dir).withColumn("score_text", _score_text()).select(
        *[F.col(f"`{c}`") for c in [*_DESCRIPTIVE, "score_text"]])
    kinds = [cols.classify_columns(df, rule) for rule in ("dtype", "all_parse", "any_parse")]
    return spark.createDataFrame(
        [(c, *[k[c] for k in kinds]) for c in df.columns],
        "column_name string, by_dtype string, by_all_parse string, by_any_parse string")


@register("coerce_numeric", f"""
select unique_id, try_cast(trim({_SCORE_TEXT}) as double) as score_text, age from app""")
def coerce_numeric(spark, sf_dir):
    df = applicants(spark, sf_dir).select("unique_id", _score_text().alias("score_text"), "age")
    return cols.coerce_numeric(df, ["score_text", "age"])


@register("align_to_features", """
select unique_id, credit_score, cast(0 as double) as digital_literacy_score, gender,
  'Unknown' as device_tier, age from app""")
def align_to_features(spark, sf_dir):
    wanted = [("credit_score", "double"), ("digital_literacy_score", "double"),
              ("gender", "string"), ("device_tier", "string"), ("age", "double")]
    return cols.align_to_features(
        applicants(spark, sf_dir), wanted, fill="by_type", keep=["unique_id"])


@register("write_table", "select unique_id, age, gender, loan_amt_1, balance_12, target from app")
def write_table(spark, sf_dir):
    path = fresh_path(spark, "written")
    rows = applicants(spark, sf_dir).select(
        "unique_id", "age", "gender", "loan_amt_1", "balance_12", "target")
    source.write_table(rows, path)
    return source.read_applicants(spark, path, "parquet")


@register("assign_batches", """
select unique_id, loan_amt_1,
  cast(floor((row_number() over (order by unique_id) - 1) / 100) as bigint) as batch_id from app""")
def assign_batches_query(spark, sf_dir):
    return assign_batches(applicants(spark, sf_dir).select("unique_id", "loan_amt_1"), "unique_id")


# ---- filters -----------------------------------------------------------------

@register("drop_null_target", "select unique_id, target from app where target is not null")
def drop_null_target(spark, sf_dir):
    return validate.drop_null_target(applicants(spark, sf_dir)).select("unique_id", "target")


# Few applicants have a value in every column, so the rows that do are counted as well.
_COMPLETE = {
    "every feature": list(_DESCRIPTIVE),
    "the first slots": [c for c in _DESCRIPTIVE if not c.split("_")[-1].isdigit() or c.endswith("_1")],
}


@register("complete_cases", " union all ".join(
    f"""select '{name}' as needed, count(*) as applicants, cast(sum(unique_id) as bigint) as ids from app
    where {' and '.join(f'"{c}" is not null' for c in columns)}""" for name, columns in _COMPLETE.items()))
def complete_cases(spark, sf_dir):
    df = applicants(spark, sf_dir)
    parts = [
        validate.complete_cases(df, [f"`{c}`" if " " in c else c for c in columns]).agg(
            F.lit(name).alias("needed"), F.count("*").alias("applicants"), F.sum("unique_id").alias("ids"))
        for name, columns in _COMPLETE.items()]
    return parts[0].unionByName(parts[1])


@register("drop_sparse_columns", ", shares as (" + " union all ".join(
    f"""select '{c}' as feature, avg(case when "{c}" is null then 1.0 else 0.0 end) as share from app"""
    for c in _DESCRIPTIVE) + """)
select feature, round(share, 6) as missing_fraction from shares where share <= 0.5""")
def drop_sparse_columns(spark, sf_dir):
    whole = applicants(spark, sf_dir).select(*[F.col(f"`{c}`") for c in _DESCRIPTIVE])
    kept = validate.drop_sparse_columns(whole)
    return missing_profile(kept).withColumn("missing_fraction", F.round("missing_fraction", 6))


_DOUBLES = [c for c in _DESCRIPTIVE if c not in TEXT_COLUMNS and c != "unique_id"]


@register("null_out_infinities", "select unique_id, " + ", ".join(
    f"case when (unique_id + {i}) % 4 = 0 then {c} end as {c}" for i, c in enumerate(_DOUBLES)) + " from app")
def null_out_infinities(spark, sf_dir):
    """NaN or an infinity in three of four rows of every numeric column."""
    def spoiled(i: int, c: str):
        remainder = (F.col("unique_id") + i) % 4
        return (F.when(remainder == 1, float("nan")).when(remainder == 2, float("inf"))
                .when(remainder == 3, float("-inf")).otherwise(F.col(c))).alias(c)

    return source.null_out_infinities(
        applicants(spark, sf_dir).select("unique_id", *[spoiled(i, c) for i, c in enumerate(_DOUBLES)]))


@register("head", """
select unique_id, loan_amt_1, target from app order by loan_amt_1 desc nulls last, unique_id limit 10""")
def head(spark, sf_dir):
    rows = applicants(spark, sf_dir).select("unique_id", "loan_amt_1", "target")
    return cols.head(rows, 10, [F.desc_nulls_last("loan_amt_1"), F.col("unique_id")])


@register("copy_columns", """
select unique_id, credit_score as credit_risk_score, target as target_original_scale,
  0 as bureau_rank from app""")
def copy_columns(spark, sf_dir):
    copied = cols.copy_columns(applicants(spark, sf_dir), {
        "credit_risk_score": "credit_score", "target_original_scale": "target",
        "bureau_rank": "no_such_column"})
    return copied.select("unique_id", "credit_risk_score", "target_original_scale", "bureau_rank")


# ---- request checks ----------------------------------------------------------

_REQUEST_SQL = """, req as (
  select unique_id, age * 1.5 as age, credit_score + 30 as credit_score,
    total_emi_1 - 200 as total_emi, (unique_id % 13) / 10.0::double as threshold,
    case when unique_id % 4 = 0 then lower(gender) when unique_id % 17 = 5 then 'unknown'
      else gender end as gender,
    case when unique_id % 23 = 1 then 'separated' else marital_status end as marital_status,
    city, state,
    case unique_id % 6 when 0 then 'rented' when 1 then 'Self-Owned' when 2 then 'PARENTAL'
      when 3 then 'company-provided' when 4 then 'FURNITURE' end as residence_ownership
  from app)"""


def request_rows(spark, sf_dir):
    """Requests with every kind of fault, derived from the applicants."""
    key = F.col("unique_id")
    homes = F.create_map(*[F.lit(x) for x in (
        0, "rented", 1, "Self-Owned", 2, "PARENTAL", 3, "company-provided", 4, "FURNITURE")])
    return applicants(spark, sf_dir).select(
        "unique_id", (F.col("age") * 1.5).alias("age"), (F.col("credit_score") + 30).alias("credit_score"),
        (F.col("total_emi_1") - 200).alias("total_emi"),
        ((key % 13).cast("double") / 10).alias("threshold"),
        F.when(key % 4 == 0, F.lower("gender")).when(key % 17 == 5, "unknown")
        .otherwise(F.col("gender")).alias("gender"),
        F.when(key % 23 == 1, "separated").otherwise(F.col("marital_status")).alias("marital_status"),
        "city", "state", F.try_element_at(homes, (key % 6).cast("int")).alias("residence_ownership"),
    )


def _sql_ranges(prefix: str = "") -> list[str]:
    ranges = [("age", 18, 100), ("credit_score", 300, 900), ("total_emi", 0, None), ("threshold", 0, 1)]
    out = []
    for name, low, high in ranges:
        test = f"{name} < {low}" + (f" or {name} > {high}" if high is not None else "")
        out.append(f"case when {test} then '{name} out of range' end")
    return out


def _sql_enums() -> list[str]:
    return [
        f"case when upper({c}) not in ({', '.join(repr(v) for v in allowed)}) "
        f"then '{c} not allowed' end"
        for c, allowed in [
            ("gender", ["MALE", "FEMALE", "OTHER"]),
            ("marital_status", ["SINGLE", "MARRIED", "DIVORCED", "WIDOWED"]),
            ("residence_ownership", ["SELF-OWNED", "RENTED", "PARENTAL", "COMPANY-PROVIDED"])]
    ]


def _sql_required() -> list[str]:
    return [f"case when {c} is null then 'missing {c}' end" for c in (
        "age", "gender", "marital_status", "city", "state", "residence_ownership")]


def _sql_reasons(parts) -> str:
    return f"concat_ws(';', {', '.join(parts)})"


ALL_REASONS_SQL = _sql_reasons([*_sql_required(), *_sql_ranges(), *_sql_enums()])


@register("validate_requests", _REQUEST_SQL + f"""
select unique_id, {_sql_reasons(_sql_ranges())} as reasons, {_sql_reasons(_sql_ranges())} = '' as is_valid
from req""")
def validate_requests(spark, sf_dir):
    valid, rejected = validate.validate_requests(request_rows(spark, sf_dir), enums={}, required=())
    return valid.select("unique_id", F.lit("").alias("reasons"), F.lit(True).alias("is_valid")).union(
        rejected.select("unique_id", F.concat_ws(";", "reasons"), F.lit(False)))


@register("validate_enums", _REQUEST_SQL + f"""
select unique_id, upper(gender) as gender, upper(marital_status) as marital_status,
  upper(residence_ownership) as residence_ownership, {_sql_reasons(_sql_enums())} as reasons from req""")
def validate_enums(spark, sf_dir):
    checked = validate.with_reasons(request_rows(spark, sf_dir), ranges={}, required=())
    return checked.select("unique_id", "gender", "marital_status", "residence_ownership",
                          F.concat_ws(";", "reasons").alias("reasons"))


@register("validate_required", _REQUEST_SQL + f"""
select unique_id, {_sql_reasons(_sql_required())} as reasons from req
where {_sql_reasons(_sql_required())} <> ''""")
def validate_required(spark, sf_dir):
    checked = validate.with_reasons(request_rows(spark, sf_dir), ranges={}, enums={})
    return checked.where(F.size("reasons") > 0).select(
        "unique_id", F.concat_ws(";", "reasons").alias("reasons"))


@register("missing_indicators", "select unique_id, " + ", ".join(
    f'case when "{c}" is null then 1 else 0 end as "{c}_is_missing"' for c in _DESCRIPTIVE if c != "unique_id") + " from app")
def missing_indicators_query(spark, sf_dir):
    columns = [c for c in _DESCRIPTIVE if c != "unique_id"]
    flagged = missing_indicators(applicants(spark, sf_dir), columns)
    return flagged.select("unique_id", *[F.col(f"`{c}_is_missing`") for c in columns])
