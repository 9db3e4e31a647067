"""Metrics and scoring rules over a stand-in prediction that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.catalog.applicants import applicants
from ledgerloom.catalog.column_queries import ALL_REASONS_SQL, request_rows
from ledgerloom.catalog.column_queries import _REQUEST_SQL
from ledgerloom.catalog.registry import register
from ledgerloom.operators import evaluate, score
from ledgerloom.operators.features import fit_minmax, label_repayment_ok
from ledgerloom.operators.split import assign_batches
from ledgerloom.operators.validate import with_reasons
from ledgerloom.plans.shared import fresh_path
from ledgerloom.streaming.score_stream import read_scored, score_stream, stage_requests

# Stand-in predictions: income from the score and the first loan, a probability with ties.
_SCORED_SQL = """, s as (
  select unique_id, target, unique_id % 7 as batch,
    coalesce(credit_score, 600) * 60 + loan_amt_1 / 20 as predicted,
    coalesce(credit_score, 600) * 50 + loan_amt_1 / 10 as second_income,
    coalesce(credit_score, 600) * 70 + coalesce(age, 40) * 100 as third_income,
    case when target > 50000 then 1 else 0 end as repayment_ok,
    (unique_id * 37 % 101) / 100.0::double as probability
  from app)"""


def _scored(spark, sf_dir):
    points = F.coalesce("credit_score", F.lit(600.0))
    df = applicants(spark, sf_dir).select(
        "unique_id", "target", (F.col("unique_id") % 7).alias("batch"),
        (points * 60 + F.col("loan_amt_1") / 20).alias("predicted"),
        (points * 50 + F.col("loan_amt_1") / 10).alias("second_income"),
        (points * 70 + F.coalesce("age", F.lit(40.0)) * 100).alias("third_income"),
        ((F.col("unique_id") * 37 % 101) / F.lit(100.0)).alias("probability"))
    return label_repayment_ok(df)


_METRICS_SQL = """round(avg((y - p) * (y - p)), 2) as mse, round(sqrt(avg((y - p) * (y - p))), 4) as rmse,
  round(avg(abs(y - p)), 4) as mae,
  round(1 - sum((y - p) * (y - p)) / nullif(count(y) * var_pop(y), 0), 6) as r2"""
_PAIRS_SQL = _SCORED_SQL + """, yp as (
  select unique_id, batch, target as y, predicted as p from s
  where target is not null and predicted is not null)"""


def _rounded_metrics(df):
    return df.withColumns({
        "mse": F.round("mse", 2), "rmse": F.round("rmse", 4), "mae": F.round("mae", 4),
        "r2": F.round("r2", 6)})


@register("regression_metrics", _PAIRS_SQL + f"select {_METRICS_SQL} from yp")
def regression_metrics(spark, sf_dir):
    return _rounded_metrics(evaluate.regression_metrics(_scored(spark, sf_dir), "target", "predicted"))


@register("regression_metrics_log_scale", _SCORED_SQL + f""", yp as (
  select exp(ln(1 + target)) - 1 as y, exp(ln(1 + predicted)) - 1 as p from s
  where target is not null and predicted is not null) select {_METRICS_SQL} from yp""")
def regression_metrics_log_scale(spark, sf_dir):
    logs = _scored(spark, sf_dir).withColumns(
        {"target": F.log1p("target"), "predicted": F.log1p("predicted")})
    return _rounded_metrics(
        evaluate.regression_metrics(logs, "target", "predicted", log_scale=True))


_BATCHES_SQL = """, b as (select *, cast(floor((row_number() over (order by unique_id) - 1) / 100) as bigint)
  as batch_id from s), yp as (select batch_id, target as y, predicted as p from b
  where target is not null and predicted is not null)"""


@register("batch_metrics", _SCORED_SQL + _BATCHES_SQL + f"""
select batch_id, {_METRICS_SQL} from yp group by batch_id""")
def batch_metrics(spark, sf_dir):
    batches = assign_batches(_scored(spark, sf_dir), "unique_id", fv.BATCH_ROWS)
    return _rounded_metrics(evaluate.batch_metrics(batches, "batch_id", "target", "predicted"))


@register("mean_batch_metrics", _SCORED_SQL + _BATCHES_SQL + """, m as (
  select avg((y - p) * (y - p)) as mse, sqrt(avg((y - p) * (y - p))) as rmse, avg(abs(y - p)) as mae,
    1 - sum((y - p) * (y - p)) / nullif(count(y) * var_pop(y), 0) as r2 from yp group by batch_id)
select round(avg(mse), 2) as mse, round(avg(rmse), 4) as rmse, round(avg(mae), 4) as mae,
  round(avg(r2), 6) as r2 from m""")
def mean_batch_metrics(spark, sf_dir):
    batches = assign_batches(_scored(spark, sf_dir), "unique_id", fv.BATCH_ROWS)
    return _rounded_metrics(
        evaluate.mean_batch_metrics(batches, "batch_id", "target", "predicted"))


_CLASSES_SQL = _SCORED_SQL + """, c as (
  select repayment_ok as y, case when probability >= 0.5 then 1 else 0 end as p from s),
counts as (select sum(y * p) as tp, sum((1 - y) * p) as fp, sum(y * (1 - p)) as fn,
  sum((1 - y) * (1 - p)) as tn, count(*) as n from c)"""


def _classified(spark, sf_dir):
    return score.apply_threshold(_scored(spark, sf_dir), "probability")


@register("classification_metrics", _CLASSES_SQL + """
select round((tp + tn)::double / n, 6) as accuracy, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6)
    as precision, round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as recall,
  round(coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from counts""")
def classification_metrics(spark, sf_dir):
    table = evaluate.classification_metrics(_classified(spark, sf_dir), "repayment_ok", "prediction")
    return table.withColumns({c: F.round(c, 6) for c in table.columns})


@register("auc_roc", _SCORED_SQL + """, r as (
  select repayment_ok, rank() over (order by probability)
    + (count(*) over (partition by probability) - 1) / 2.0::double as mid_rank from s),
sums as (select sum(case when repayment_ok = 1 then mid_rank end) as ranks,
  sum(repayment_ok)::double as ones, sum(1 - repayment_ok)::double as zeros from r)
select round((ranks - ones * (ones + 1) / 2) / (ones * zeros), 6) as auc from sums""")
def auc_roc(spark, sf_dir):
    table = evaluate.auc_roc(_scored(spark, sf_dir), "repayment_ok", "probability")
    return table.withColumn("auc", F.round("auc", 6))


@register("confusion_matrix", _CLASSES_SQL + """
select 0 as label, 0 as predicted, cast(tn as bigint) as count from counts
union all select 0, 1, cast(fp as bigint) from counts
union all select 1, 0, cast(fn as bigint) from counts
union all select 1, 1, cast(tp as bigint) from counts""")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_classified(spark, sf_dir), "repayment_ok", "prediction")


@register("classification_report", _CLASSES_SQL + """, per as (
  select '0' as class, tn::double / nullif(tn + fn, 0) as precision,
    tn::double / nullif(tn + fp, 0) as recall, 2 * tn::double / nullif(2 * tn + fn + fp, 0) as f1,
    tn + fp as support from counts
  union all
  select '1', tp::double / nullif(tp + fp, 0), tp::double / nullif(tp + fn, 0),
    2 * tp::double / nullif(2 * tp + fp + fn, 0), tp + fn from counts),
rows_ as (
  select * from per
  union all select 'accuracy', (tp + tn)::double / n, (tp + tn)::double / n, (tp + tn)::double / n, n from counts
  union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per
  union all select 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from per)
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
  cast(support as bigint) as support from rows_""")
def classification_report(spark, sf_dir):
    table = evaluate.classification_report(_classified(spark, sf_dir), "repayment_ok", "prediction")
    return table.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@register("actual_vs_predicted", _SCORED_SQL + """
select unique_id, target as actual, predicted from s""")
def actual_vs_predicted(spark, sf_dir):
    return evaluate.actual_vs_predicted(_scored(spark, sf_dir), "unique_id", "target", "predicted")


# ---- scoring rules -----------------------------------------------------------

@register("apply_threshold", _SCORED_SQL + """, t as (
  select *, case when unique_id % 5 > 0 then unique_id % 13 / 10.0::double end as own from s)
select unique_id, probability, coalesce(own, 0.5) as threshold,
  case when coalesce(own, 0.5) <= 1 then case when probability >= coalesce(own, 0.5) then 1 else 0 end
    end as prediction,
  case when coalesce(own, 0.5) <= 1 then case when probability >= coalesce(own, 0.5) then 'Good'
    else 'Bad' end end as status from t""")
def apply_threshold(spark, sf_dir):
    key = F.col("unique_id")
    own = _scored(spark, sf_dir).withColumn("own", F.when(key % 5 > 0, key % 13 / F.lit(10.0)))
    return score.apply_threshold(own, "probability", "own").select(
        "unique_id", "probability", "threshold", "prediction", "status")


_MEMBERS = ["predicted", "second_income", "third_income"]
_MEAN = "((predicted + second_income + third_income) / 3)"
_CONFIDENCE_SQL = f"""greatest(0, least(1, 1 - sqrt(((predicted - {_MEAN}) * (predicted - {_MEAN})
  + (second_income - {_MEAN}) * (second_income - {_MEAN})
  + (third_income - {_MEAN}) * (third_income - {_MEAN})) / 3) / {_MEAN}))"""


@register("ensemble_confidence", _SCORED_SQL + f"""
select unique_id, round({_CONFIDENCE_SQL}, 6) as confidence_score from s where predicted is not null""")
def ensemble_confidence(spark, sf_dir):
    df = _scored(spark, sf_dir).where("predicted is not null")
    confidence = score.ensemble_confidence([F.col(m) for m in _MEMBERS])
    return df.select("unique_id", F.round(confidence, 6).alias("confidence_score"))


@register("income_summary", _SCORED_SQL + f"""
select unique_id, predicted as predicted_annual_income, predicted / 12 as predicted_monthly_income,
  round({_CONFIDENCE_SQL}, 6) as confidence_score from s where predicted is not null""")
def income_summary(spark, sf_dir):
    df = _scored(spark, sf_dir).where("predicted is not null")
    out = score.income_summary(df, "predicted", _MEMBERS)
    return out.select(
        "unique_id", "predicted_annual_income", "predicted_monthly_income",
        F.round("confidence_score", 6).alias("confidence_score"))


@register("eligibility_band", _SCORED_SQL + """
select unique_id, probability, case when probability > 0.8 then 'above_limit'
  when probability >= 0.6 then 'up_to_limit' else 'improve_profile' end as eligibility from s""")
def eligibility_band(spark, sf_dir):
    return score.add_eligibility(_scored(spark, sf_dir), "probability").select(
        "unique_id", "probability", "eligibility")


@register("capability_income", _SCORED_SQL + """, b as (select min(target) as low, max(target) as high from s)
select unique_id, probability as capability_score,
  round(probability * (high - low) + low, 4) as predicted_income from s, b""")
def capability_income(spark, sf_dir):
    df = _scored(spark, sf_dir)
    bounds = fit_minmax(df, "target")
    scored = score.capability(score.capability(df, "probability", bounds), "probability", bounds, True)
    return scored.select("unique_id", "capability_score",
                         F.round("predicted_income", 4).alias("predicted_income"))


# ---- the stream --------------------------------------------------------------

_STREAM_SQL = _REQUEST_SQL + f""", checked as (select *, {ALL_REASONS_SQL} as reasons from req)"""


def _run_stream(spark, sf_dir):
    """Requests written as files, scored by the stream; returns the sink folder."""
    folder = fresh_path(spark, "stream")
    stage_requests(request_rows(spark, sf_dir), f"{folder}/requests")

    def scored(batch):
        points = batch.withColumn("score", (F.col("credit_score") - 300) / F.lit(600.0))
        return score.apply_threshold(score.add_eligibility(points, "score"), "score", "threshold").select(
            "unique_id", "gender", F.round("score", 6).alias("score"), "eligibility", "status")

    query = score_stream(
        spark, f"{folder}/requests", f"{folder}/out", f"{folder}/checkpoint", scored, once=True)
    query.awaitTermination()
    return f"{folder}/out"


@register("score_stream", _STREAM_SQL + """
select unique_id, upper(gender) as gender, round((credit_score - 300) / 600, 6) as score,
  case when (credit_score - 300) / 600 > 0.8 then 'above_limit'
    when (credit_score - 300) / 600 >= 0.6 then 'up_to_limit'
    when credit_score is not null then 'improve_profile' end as eligibility,
  case when (credit_score - 300) / 600 >= threshold then 'Good'
    when (credit_score - 300) / 600 < threshold then 'Bad' end as status
from checked where reasons = ''""")
def score_stream_scored(spark, sf_dir):
    return read_scored(spark, _run_stream(spark, sf_dir))


@register("score_stream_rejected", _STREAM_SQL + """
select unique_id, reasons from checked where reasons <> ''""")
def score_stream_rejected(spark, sf_dir):
    rejected = read_scored(spark, _run_stream(spark, sf_dir), "rejected")
    return rejected.select("unique_id", F.concat_ws(";", "reasons").alias("reasons"))


@register("score_stream_matches_batch", _STREAM_SQL + """
select count(*) filter (reasons = '') as scored, count(*) filter (reasons <> '') as rejected,
  cast(0 as bigint) as different from checked""")
def score_stream_matches_batch(spark, sf_dir):
    """Rows of the stream against the same checks made on the table itself."""
    sink = _run_stream(spark, sf_dir)
    streamed = read_scored(spark, sink).select("unique_id", F.lit(True).alias("s")).union(
        read_scored(spark, sink, "rejected").select("unique_id", F.lit(False)))
    batch = with_reasons(request_rows(spark, sf_dir)).select(
        "unique_id", (F.size("reasons") == 0).alias("b"))
    return streamed.join(batch, "unique_id", "full").agg(
        F.count_if("s").alias("scored"), F.count_if(~F.col("s")).alias("rejected"),
        F.count_if(~F.col("s").eqNullSafe(F.col("b"))).alias("different"))
