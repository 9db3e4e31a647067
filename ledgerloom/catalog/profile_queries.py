"""Profiles, correlations, screening, encodings and splits."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.catalog.applicants import applicants, raw_applicants, raw_names
from ledgerloom.catalog.impute_queries import RAW_FILLED, RAW_LAST
from ledgerloom.catalog.registry import register
from ledgerloom.operators import encode, impute, profile, profile_state, split
from ledgerloom.operators.features import add_age_bin, label_repayment_ok
from ledgerloom.plans.shared import fresh_path, materialize

_COLUMNS = [c for c in raw_names().values()]
_NUMERIC = [c for c in _COLUMNS if c not in fv.TEXT_COLUMNS and c not in ("unique_id", "target")]


def _quoted(c: str) -> str:
    return f'"{c}"'


def _shares_sql(columns, source="app", name="shares") -> str:
    """A WITH clause (feature, missing_fraction), from one scan."""
    parts = ", ".join(
        f"avg(case when {_quoted(c)} is null then 1.0 else 0.0 end) as m{i}"
        for i, c in enumerate(columns))
    rows = " union all ".join(f"select '{c}' as feature, m{i} as missing_fraction from {name}_one"
                              for i, c in enumerate(columns))
    return f", {name}_one as (select {parts} from {source}), {name} as ({rows})"


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_ALL = [c for c in _COLUMNS]


@register("missing_profile", _shares_sql(_ALL) + """
select feature, round(missing_fraction, 6) as missing_fraction from shares""")
def missing_profile(spark, sf_dir):
    return _round(profile.missing_profile(applicants(spark, sf_dir), _ALL), "missing_fraction")


@register("missing_top_n", _shares_sql(_ALL) + """
select feature, round(missing_fraction, 6) as missing_fraction from shares
order by missing_fraction desc, feature limit 10""")
def missing_top_n(spark, sf_dir):
    return _round(profile.missing_top_n(applicants(spark, sf_dir), 10, _ALL), "missing_fraction")


@register("missing_above", _shares_sql(_ALL) + """
select feature, round(missing_fraction, 6) as missing_fraction from shares
where missing_fraction > 0.5""")
def missing_above(spark, sf_dir):
    return _round(profile.missing_above(applicants(spark, sf_dir), 0.5, _ALL), "missing_fraction")


_RAW = list(raw_names())


@register("missing_reduction", RAW_FILLED + _shares_sql(_RAW, "raw", "before")
          + _shares_sql(_RAW, RAW_LAST, "after") + """
select b.feature, 'Before (%)' as stage, round(b.missing_fraction * 100, 6) as missing_percent
from before b where b.missing_fraction > 0
union all
select b.feature, 'After (%)', round(a.missing_fraction * 100, 6)
from before b join after a on a.feature = b.feature where b.missing_fraction > 0""")
def missing_reduction(spark, sf_dir):
    raw = materialize(raw_applicants(spark, sf_dir), "raw")
    filled = impute.ImputeRules(impute.rules_by_id()).fit(raw).transform(raw)
    return _round(profile.missing_reduction(raw, filled, _RAW), "missing_percent")


@register("residual_nulls", RAW_FILLED + " select * from (" + " union all ".join(
    f"select '{c}' as feature, count(*) - count({c}) as nulls from {RAW_LAST}" for c in _RAW) + ")")
def residual_nulls(spark, sf_dir):
    raw = materialize(raw_applicants(spark, sf_dir), "raw")
    filled = impute.ImputeRules(impute.rules_by_id()).fit(raw).transform(raw)
    return profile.residual_nulls(filled, _RAW)


_DESCRIBED = [*_NUMERIC, "target"]


@register("describe", ", described as (" + " union all ".join(
    f"""select '{c}' as feature, count({c}) as count, avg({c}) as mean, stddev_samp({c}) as std,
    min({c}) as min, quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50,
    quantile_cont({c}, 0.75) as q75, max({c}) as max from app""" for c in _DESCRIBED) + """)
select feature, count, round(mean, 4) as mean, round(std, 4) as std, min, round(q25, 7) as q25,
  round(q50, 7) as q50, round(q75, 7) as q75, max from described""")
def describe(spark, sf_dir):
    table = profile.describe(applicants(spark, sf_dir), _DESCRIBED)
    # Quartiles of amounts of four digits have up to six; a round to fewer would cut at ties.
    return table.withColumns({c: F.round(c, d) for c, d in (("mean", 4), ("std", 4), ("q25", 7), ("q50", 7), ("q75", 7))})


_TEXT = [c for c in _COLUMNS if c in fv.TEXT_COLUMNS]
_DOUBLES = [c for c in _COLUMNS if c not in fv.TEXT_COLUMNS and c != "unique_id"]


def _present_sql(columns) -> str:
    return " + ".join(f"count({_quoted(c)})" for c in columns)


@register("type_counts", f"""
select 'string' as dtype, cast({len(_TEXT)} as bigint) as columns,
  cast({_present_sql(_TEXT)} as bigint) as present_values from app
union all select 'double', cast({len(_DOUBLES)} as bigint), cast({_present_sql(_DOUBLES)} as bigint) from app
union all select 'bigint', cast(1 as bigint), count(unique_id) from app""")
def type_counts(spark, sf_dir):
    return profile.type_counts(
        applicants(spark, sf_dir).select(*[F.col(f"`{c}`") for c in _COLUMNS]))


def _abs_corr_sql(c: str, target: str = "target") -> str:
    """Moments over the rows where both values are present."""
    both = f"{c} is not null and {target} is not null"
    return (f"coalesce(abs(covar_pop({c}, {target}) / nullif(sqrt(var_pop({c}) filter ({both}) * "
            f"var_pop({target}) filter ({both})), 0)), 0)")


def _corr_sql(columns, name="corr_rows") -> str:
    parts = ", ".join(f"{_abs_corr_sql(c)} as k{i}" for i, c in enumerate(columns))
    rows = " union all ".join(
        f"select '{c}' as feature, k{i} as correlation from {name}_one" for i, c in enumerate(columns))
    return f", {name}_one as (select {parts} from app), {name} as ({rows})"


@register("corr_with_target", _corr_sql(_NUMERIC) + """
select feature, round(correlation, 6) as correlation from corr_rows""")
def corr_with_target(spark, sf_dir):
    return _round(profile.corr_with_target(applicants(spark, sf_dir), _NUMERIC), "correlation")


@register("corr_extremes", _corr_sql(_NUMERIC) + """, six as (
  select feature, round(correlation, 6) as correlation from corr_rows)
select * from (select *, 'top' as side from six order by correlation desc, feature limit 15)
union all
select * from (select *, 'bottom' as side from six order by correlation, feature desc limit 10)""")
def corr_extremes(spark, sf_dir):
    return profile.corr_extremes(applicants(spark, sf_dir), _NUMERIC)


_MATRIX = [*_NUMERIC, "target"]


@register("corr_matrix", ", cells as (" + " union all ".join(
    f"select unique_id, '{c}' as feature, {c} as v from app where {c} is not null" for c in _MATRIX) + """),
names as (select unnest([""" + ", ".join(f"'{c}'" for c in _MATRIX) + """]) as feature),
pairs as (
  select a.feature as x, b.feature as y, covar_pop(a.v, b.v) as c, var_pop(a.v) as p, var_pop(b.v) as q
  from cells a join cells b using (unique_id) group by a.feature, b.feature)
select m.feature as feature_x, n.feature as feature_y, round(c / nullif(sqrt(p * q), 0), 6) as correlation
from names m cross join names n left join pairs on m.feature = x and n.feature = y""")
def corr_matrix(spark, sf_dir):
    return _round(profile.corr_matrix(applicants(spark, sf_dir), _MATRIX), "correlation")


@register("screen_features", _corr_sql(_NUMERIC) + _shares_sql(_NUMERIC) + """
select s.feature, round(missing_fraction, 6) as missing_fraction,
  round(correlation, 6) as correlation,
  (missing_fraction > 0.60 and correlation < 0.005) as dropped
from shares s join corr_rows c on s.feature = c.feature""")
def screen_features(spark, sf_dir):
    table = profile.feature_screen(applicants(spark, sf_dir), _NUMERIC)
    return _round(table, "missing_fraction", "correlation")


@register("feature_completeness", f""", n as (
  select unique_id, {' + '.join(f'case when {_quoted(c)} is null then 0 else 1 end' for c in _COLUMNS)}
    as available_features from app)
select unique_id, available_features, {len(_COLUMNS)} as total_features,
  round(available_features / {float(len(_COLUMNS))} * 100, 4) as feature_completeness from n""")
def feature_completeness(spark, sf_dir):
    out = profile.feature_completeness(applicants(spark, sf_dir), _COLUMNS)
    return out.select("unique_id", "available_features", "total_features",
                      F.round("feature_completeness", 4).alias("feature_completeness"))


@register("value_counts", """
select city as value, count(*) as count from app where city is not null group by city""")
def value_counts(spark, sf_dir):
    return profile.value_counts(applicants(spark, sf_dir), "city")


# ---- encodings ---------------------------------------------------------------

_SCALED = [*_NUMERIC, "target"]


@register("standard_scale", "select unique_id, " + ", ".join(
    f"round(({c} - (select avg({c}) from app)) / (select coalesce(nullif(stddev_pop({c}), 0), 1) from app), 6) as {c}"
    for c in _SCALED) + " from app")
def standard_scale(spark, sf_dir):
    df = applicants(spark, sf_dir).select("unique_id", *_SCALED)
    return _round(encode.standard_scale(df, _SCALED), *_SCALED)


def _slots_sql(source: str, columns) -> str:
    """(unique_id, slot, value) of every category that a row has."""
    return " union all ".join(
        f"select unique_id, concat('{c}_', {_quoted(c)}) as slot, 1.0::double as value from {source}"
        f" where {_quoted(c)} is not null" for c in columns)


def _long(df, columns):
    """The nonzero cells of the columns as (unique_id, slot, value)."""
    cells = df.select("unique_id", *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return cells.unpivot("unique_id", [F.col(f"`{c}`") for c in columns], "slot", "value").where("value <> 0")


@register("one_hot", " select * from (" + _slots_sql("app", _TEXT) + ")")
def one_hot(spark, sf_dir):
    """Every text column; the ones of the wide result, in long form."""
    df = materialize(applicants(spark, sf_dir).select("unique_id", *[F.col(f"`{c}`") for c in _TEXT]), "texts")
    fitted = encode.fit_one_hot(df, _TEXT)
    return _long(fitted.transform(df), fitted.names())


_AGE_SQL = """case when age < 25 then '<25' when age < 35 then '25-34' when age < 45 then '35-44'
  when age < 55 then '45-54' when age is not null then '55+' end"""
_ENCODED = list(fv.TARGET_ENCODED)
_ENCODING_SQL = f""", known as (select *, {_AGE_SQL} as age_bin from app where target is not null),
prior as (select avg(target) as prior from known),
means as (""" + " union all ".join(
    f"select '{c}' as feature, {c} as category, count(*) as n, avg(target) as mean from known "
    f"where {c} is not null group by {c}" for c in _ENCODED) + """),
codes as (
  select feature, category, n,
    prior * (1 - w) + mean * w as encoded
  from (select *, case when (n - 20) / 0.2 < -700 then 0 else 1 / (1 + exp(-(n - 20) / 0.2)) end as w
    from means), prior)"""


@register("target_encode_table", _ENCODING_SQL + """
select feature, category, n, round(encoded, 4) as encoded from codes""")
def target_encode_table(spark, sf_dir):
    df = add_age_bin(applicants(spark, sf_dir).select("unique_id", "target", "age", *_ENCODED[:-1]))
    table, _ = encode.TargetEncode().encoded_table(df, "target")
    return table.withColumn("encoded", F.round("encoded", 4))


@register("target_encode", _ENCODING_SQL + "select a.unique_id, " + ", ".join(
    f"round(coalesce((select encoded from codes where feature = '{c}' and category = a.{c}), "
    f"(select prior from prior)), 4) as {c}" for c in _ENCODED)
    + f" from (select *, {_AGE_SQL} as age_bin from app) a")
def target_encode(spark, sf_dir):
    df = add_age_bin(applicants(spark, sf_dir).select("unique_id", "target", "age", *_ENCODED[:-1]))
    encoded = encode.TargetEncode().fit(df, "target").transform(df)
    return encoded.select("unique_id", *[F.round(c, 4).alias(c) for c in _ENCODED])


@register("column_transformer", ", filled as (select unique_id, " + ", ".join(
    f"coalesce({c}, (select quantile_cont({c}, 0.5) from app)) as {c}" for c in _NUMERIC) + ", " + ", ".join(
    f"coalesce({_quoted(c)}, 'Missing') as {_quoted(c)}" for c in _TEXT) + """ from app),
moments as (select """ + ", ".join(
    f"avg({c}) as m{i}, coalesce(nullif(stddev_pop({c}), 0), 1) as s{i}" for i, c in enumerate(_NUMERIC)) + """ from filled),
slots as (""" + _slots_sql("filled", _TEXT) + " union all " + " union all ".join(
    f"select unique_id, '{c}', ({c} - m{i}) / s{i} from filled, moments" for i, c in enumerate(_NUMERIC)) + """)
select unique_id, slot, round(value, 6) as value from slots where round(value, 6) <> 0""")
def column_transformer(spark, sf_dir):
    """Medians, scaling, one-hot and assembly of all columns; nonzero slots under their feature names."""
    df = materialize(applicants(spark, sf_dir).select(
        "unique_id", *[F.col(f"`{c}`") for c in [*_NUMERIC, *_TEXT]]), "columns")
    filled = impute.fill_constants(
        impute.fit_medians(df, _NUMERIC).transform(df), {c: "Missing" for c in _TEXT})
    scaled = encode.standard_scale(filled, _NUMERIC)
    vectors = Pipeline(stages=encode.assemble(_NUMERIC, _TEXT)).fit(scaled).transform(scaled)
    names = F.array(*[F.lit(n) for n in encode.feature_names(vectors)])
    cells = vectors.select("unique_id", F.posexplode(vector_to_array("features")).alias("i", "value"))
    found = cells.where("round(value, 6) <> 0")
    return found.select("unique_id", names[F.col("i")].alias("slot"), F.round("value", 6).alias("value"))


# ---- splits ------------------------------------------------------------------

def bucket_sql(seed: int, digits: int = 8, buckets: int | None = 100) -> str:
    number = f"cast('0x' || substr(md5(concat(unique_id, '#{seed}')), 1, {digits}) as bigint)"
    return number if buckets is None else f"({number} % {buckets})"


def held_out_sql(fraction: float = 0.2, seed: int = 42) -> str:
    return f"({bucket_sql(seed, 8, None)} < {fraction} * 4294967296)"


@register("split_holdout", f"""
select unique_id, case when {held_out_sql()} then 'test' else 'train' end as side from app""")
def split_holdout(spark, sf_dir):
    train, test = split.split_holdout(applicants(spark, sf_dir).select("unique_id"), "unique_id")
    return train.withColumn("side", F.lit("train")).union(test.withColumn("side", F.lit("test")))


@register("split_train_val_test", f"""
select unique_id, case when {bucket_sql(42)} < 20 then 'test' when {bucket_sql(42)} < 40 then 'val'
  else 'train' end as side from app""")
def split_train_val_test(spark, sf_dir):
    parts = split.split_train_val_test(applicants(spark, sf_dir).select("unique_id"), "unique_id")
    train, val, test = [
        p.withColumn("side", F.lit(n)) for p, n in zip(parts, ("train", "val", "test"))]
    return train.union(val).union(test)


@register("split_stratified", f""", h as (
  select unique_id, case when target > 50000 then 1 else 0 end as repayment_ok,
    {bucket_sql(42, 10, None)} as h from app),
r as (
  select *, row_number() over (partition by repayment_ok order by h) as r,
    count(*) over (partition by repayment_ok) as n from h)
select unique_id, repayment_ok, r <= floor(0.2 * n + 0.5) as is_test from r""")
def split_stratified(spark, sf_dir):
    df = label_repayment_ok(applicants(spark, sf_dir).select("unique_id", "target")).drop("target")
    train, test = split.split_stratified(df, "unique_id", "repayment_ok")
    return train.withColumn("is_test", F.lit(False)).union(test.withColumn("is_test", F.lit(True)))


def _ordered_sql(c: str) -> str:
    """The prior and the rows before, by the hash of the key; rows without a target see all rows."""
    before = f"over (partition by {c} order by h, unique_id rows between unbounded preceding and 1 preceding)"
    own = f"(coalesce(sum(target) {before}, 0) + prior) / (count(target) {before} + 1.0)"
    return f"round(case when {c} is null then prior else {own} end + 1e-7, 4) as {c}"


def _whole_sql(c: str) -> str:
    whole = f"from known k where k.{c} = a.{c}"
    return f"round(case when {c} is null then prior else ((select coalesce(sum(target), 0) {whole}) + prior) / ((select count(*) {whole}) + 1.0) end + 1e-7, 4)"


@register("ordered_target_encode", f""", known as (
  select *, {_AGE_SQL} as age_bin, {bucket_sql(42, 8, None)} as h from app where target is not null),
prior as (select avg(target) as prior from known)
select unique_id, {', '.join(_ordered_sql(c) for c in _ENCODED)} from known, prior
union all select unique_id, {', '.join(_whole_sql(c) for c in _ENCODED)}
from (select *, {_AGE_SQL} as age_bin from app where target is null) a, prior""")
def ordered_target_encode(spark, sf_dir):
    df = add_age_bin(applicants(spark, sf_dir).select("unique_id", "target", "age", *_ENCODED[:-1]))
    encoded, _ = encode.OrderedTargetEncode().fit_transform(materialize(df, "applicants"), "unique_id", "target")
    # Sums of cents over small counts end in an exact half, which the engines round apart.
    return encoded.select("unique_id", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in _ENCODED])


def _state_sql(c: str) -> str:
    return (
        f"select '{c}' as feature, count({_quoted(c)}) as present, round(1 - count({_quoted(c)}) / count(*), 6) as missing_fraction, "
        f"round(avg({_quoted(c)}), 4) as mean, round(stddev_samp({_quoted(c)}), 4) as stddev, min({_quoted(c)})::double as min, "
        f"max({_quoted(c)})::double as max, round(corr({_quoted(c)}, target), 6) as corr, true as quantiles_close from app")


@register("profile_state", " " + " union all ".join(_state_sql(c) for c in _NUMERIC))
def merged_profile(spark, sf_dir):
    """Profiles of four parts, stored and merged; medians of the sketch lie within 2 % of the ranks around it."""
    df = materialize(applicants(spark, sf_dir).select("unique_id", "target", *[F.col(f"`{c}`") for c in _NUMERIC]), "columns")
    folder = fresh_path(spark, "profile-states")
    for k in range(4):
        part = df.where(F.pmod(F.xxhash64("unique_id"), F.lit(4)) == k)
        profile_state.store_state(profile_state.number_state(part, _NUMERIC, "target"), folder, str(k))
    report = profile_state.number_report(profile_state.merge_number_states(profile_state.read_states(spark, folder)))
    around = profile.exact_quantiles(df, {c: [0.48, 0.52] for c in _NUMERIC})
    bounds = spark.createDataFrame(
        [(c, around[c, 0.48], around[c, 0.52]) for c in _NUMERIC], "feature string, low double, high double")
    median = F.col("quantiles")[1]
    close = F.coalesce(median.between(F.col("low"), F.col("high")), F.col("present") == 0)
    return report.join(bounds, "feature").select(
        "feature", "present", F.round("missing_fraction", 6).alias("missing_fraction"), F.round("mean", 4).alias("mean"),
        F.round("stddev", 4).alias("stddev"), "min", "max", F.round("corr", 6).alias("corr"), close.alias("quantiles_close"))
