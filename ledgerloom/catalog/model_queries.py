"""Trained models with the library's own settings.

Predictions have no SQL form, so the queries return what must hold of them: which rows are
scored, how outputs follow from one another, and flags that a broken model fails. Fits are shared
by the queries of a session as long as the tables stay the same files.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.catalog.applicants import applicants
from ledgerloom.catalog.profile_queries import held_out_sql
from ledgerloom.catalog.registry import register
from ledgerloom.catalog.score_queries import request_rows
from ledgerloom.operators import encode, evaluate, explain, train, tuning
from ledgerloom.operators.split import assign_batches, holdout_flag
from ledgerloom.operators.validate import with_reasons
from ledgerloom.plans import applicant_models as models
from ledgerloom.plans.shared import fresh_path, materialize
from ledgerloom.catalog.column_queries import _REQUEST_SQL, ALL_REASONS_SQL
from ledgerloom.streaming.score_stream import read_scored, score_stream, stage_requests
from ledgerloom.streaming.train_stream import train_incremental as train_by_batches

KEY = "unique_id"
TARGET = "target"
_TEST_ROWS = f" from app where target is not null and {held_out_sql()}"


def _files(spark, sf_dir: str) -> tuple:
    """What tells the session and the files of the tables apart."""
    states = []
    for name in ("customer", "orders", "lineitem", "nation", "region"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        states.append((status.getModificationTime(), status.getLen()))
    return spark.sparkContext.applicationId, sf_dir, tuple(states)


class _Session:
    """A session as part of a cache key: the files are the key, the session is not compared."""

    def __init__(self, spark, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.state = spark, sf_dir, _files(spark, sf_dir)

    def __hash__(self) -> int:
        return hash(self.state)

    def __eq__(self, other) -> bool:
        return self.state == other.state


@cache
def _applicants(at: _Session) -> DataFrame:
    """The applicants, derived once: fits and scores read them several times."""
    return materialize(applicants(at.spark, at.sf_dir), "applicants")


def _rows(at: _Session) -> DataFrame:
    return _applicants(at).drop("last_updated", "transaction_date")


@cache
def _vectors(at: _Session):
    """Prepared vectors of the known applicants: (train, test, preparation)."""
    known = materialize(
        _rows(at).where(F.col(TARGET).isNotNull())
        .withColumns({"income_log": F.log1p(TARGET),
                      "repayment_ok": (F.col(TARGET) > 50000).cast("double")}), "applicants")
    rest, test = known.where(~holdout_flag(KEY)), known.where(holdout_flag(KEY))
    drop = [*fv.ID_LIKE_TEXT_COLUMNS, "repayment_ok", "income_log"]
    preparation = models.fit_preparation(rest, KEY, TARGET, drop)
    keep = [TARGET, "income_log", "repayment_ok"]
    return (materialize(preparation.transform(rest, KEY, keep), "train-vectors"),
            materialize(preparation.transform(test, KEY, keep), "test-vectors"), preparation)


@cache
def _forest(at: _Session):
    return train.fit_forest_regressor(
        _vectors(at)[0], "income_log", {"feature_share": fv.FOREST_FEATURE_SHARE})


@cache
def _income(at: _Session):
    return models.fit_income_scorer(_rows(at), KEY, TARGET)


@cache
def _both(at: _Session):
    return models.fit_both_scorers(_rows(at), KEY, TARGET)


def _income_and_both(at: _Session):
    """The scorers of both kinds. They share only the applicants, so they are prepared and fitted side by side."""
    _applicants(at)
    found = train.fit_side_by_side({"income": lambda: _income(at)[0], "both": lambda: _both(at)[0]})
    return found["income"], found["both"]


def _better(actual: str, predicted: str) -> Column:
    """Whether predictions are closer to the truth than its mean is, over all rows."""
    return F.avg(F.pow(F.col(actual) - F.col(predicted), 2)) < F.var_pop(actual)


def _judged(scored: DataFrame, actual: str, predicted: str = "prediction") -> DataFrame:
    """Each test row with its target, whether it has a finite prediction, and the flag for all."""
    verdict = scored.agg(_better(actual, predicted).alias("better_than_mean")).first()[0]
    finite = F.abs(F.col(predicted)) < float("inf")
    return scored.select(KEY, TARGET, F.coalesce(finite, F.lit(False)).alias("predicted"),
                         F.lit(verdict).alias("better_than_mean"))


_JUDGED_SQL = "select unique_id, target, true as predicted, true as better_than_mean" + _TEST_ROWS


@register("fit_boosted_regressor", _JUDGED_SQL)
def fit_boosted_regressor(spark, sf_dir):
    rest, test, _ = _vectors(_Session(spark, sf_dir))
    return _judged(train.fit_boosted_regressor(rest, "income_log").transform(test), "income_log")


@register("fit_boosted_regressor_validated", _JUDGED_SQL)
def fit_boosted_regressor_validated(spark, sf_dir):
    rest, test, _ = _vectors(_Session(spark, sf_dir))
    validation = holdout_flag(KEY, 0.25, seed=43)
    model = train.fit_boosted_regressor(
        rest.where(~validation), "income_log", validation=rest.where(validation))
    return _judged(model.transform(test), "income_log")


@register("fit_boosted_classifier", """
select unique_id, cast(target > 50000 as int) as repayment_ok, true as consistent, true as better_than_chance"""
          + _TEST_ROWS)
def fit_boosted_classifier(spark, sf_dir):
    rest, test, _ = _vectors(_Session(spark, sf_dir))
    scored = train.probability_of_one(train.fit_boosted_classifier(rest, "repayment_ok").transform(test))
    auc = evaluate.auc_roc(scored, "repayment_ok", "probability_of_one").first()["auc"]
    same = (F.col("probability_of_one") > 0.5) == (F.col("prediction") == 1)
    return scored.select(KEY, F.col("repayment_ok").cast("int").alias("repayment_ok"),
                         same.alias("consistent"), F.lit(auc > 0.6).alias("better_than_chance"))


@register("fit_forest_regressor", _JUDGED_SQL)
def fit_forest_regressor(spark, sf_dir):
    at = _Session(spark, sf_dir)
    return _judged(_forest(at).transform(_vectors(at)[1]), "income_log")


@register("fit_voting", "select unique_id, true as is_weighted_mean, true as better_than_mean" + _TEST_ROWS)
def fit_voting(spark, sf_dir):
    _, scored = _income(_Session(spark, sf_dir))
    mean = (F.col("prediction_boosted") * 0.4 + F.col("prediction_boosted_validated") * 0.4
            + F.col("prediction_forest") * 0.2)
    verdict = scored.agg(_better(TARGET, "prediction").alias("b")).first()["b"]
    return scored.select(KEY, (F.abs(F.col("prediction") - mean) < 1e-9).alias("is_weighted_mean"),
                         F.lit(verdict).alias("better_than_mean"))


@register("fit_two_targets", f""", bounds as (
  select min(target) as low, max(target) as high from app where target is not null and not {held_out_sql()})
select unique_id, cast(target > 50000 as int) as repayment_ok, round((target - low) / (high - low), 6) as scaled_income,
  true as classified, true as better_than_mean from app, bounds where target is not null and {held_out_sql()}""")
def fit_two_targets(spark, sf_dir):
    scorer, test = _both(_Session(spark, sf_dir))
    classified = scorer.repayment.transform(test).withColumnRenamed("prediction", "repayment_prediction")
    scored = scorer.capability.transform(classified.drop("rawPrediction", "probability"))
    verdict = scored.agg(_better("scaled_income", "prediction").alias("b")).first()["b"]
    return scored.select(
        KEY, F.col("repayment_ok").cast("int").alias("repayment_ok"), F.round("scaled_income", 6).alias("scaled_income"),
        F.col("repayment_prediction").isin(0.0, 1.0).alias("classified"), F.lit(verdict).alias("better_than_mean"))


@register("feature_importance", "select 20 as listed, true as whole, true as ordered, true as named", applicants=False)
def feature_importance(spark, sf_dir):
    """The first 20 slots, and whether the importances of all slots add up to 1."""
    at = _Session(spark, sf_dir)
    names = encode.feature_names(_vectors(at)[0])
    every = evaluate.feature_importance(spark, _forest(at), names)
    top = [r["Importance"] for r in evaluate.feature_importance(spark, _forest(at), names, top_n=20).collect()]
    return every.agg(
        F.lit(len(top)).alias("listed"), (F.abs(F.sum("Importance") - 1) < 1e-9).alias("whole"),
        F.lit(top == sorted(top, reverse=True)).alias("ordered"),
        (F.count_distinct("Feature") == len(names)).alias("named"))


@register("permutation_importance", "select true as all_slots, true as helps, true as unused_are_zero", applicants=False)
def permutation_importance(spark, sf_dir):
    at = _Session(spark, sf_dir)
    rest, test, _ = _vectors(at)
    names = encode.feature_names(rest)
    found = evaluate.permutation_importance(_forest(at), test, KEY, "income_log", names=names)
    weights = evaluate.feature_importance(spark, _forest(at), names).withColumnRenamed("Feature", "feature")
    both = found.join(weights, "feature")
    return both.agg(
        (F.count("*") == len(names)).alias("all_slots"), (F.max("rmse_increase") > 0).alias("helps"),
        F.coalesce(F.bool_and(F.when(F.col("Importance") == 0, F.col("rmse_increase") == 0)), F.lit(True)).alias("unused_are_zero"))


def _walk(spark, vectors: DataFrame, model, name: str) -> DataFrame:
    """Add the margin that the model's exported node table gives, walked apart from the model itself."""
    return explain.from_mllib(spark, model).transform(vectors, name=name)


def _near(a, b) -> Column:
    return F.coalesce(F.abs(a - b) <= 1e-9 * (1 + F.abs(a)), F.lit(False))


def _walked_income(spark, rows: DataFrame, scorer) -> DataFrame:
    """The key and the income that the node tables of the voting members give."""
    walked = scorer.vectors(rows)
    for name, model in scorer.income.members.items():
        walked = _walk(spark, walked, model, f"prediction_{name}")
    return walked.select(KEY, F.expm1(train.vote(scorer.income.weights)).alias("walked"))


def _walked_repayment(spark, rows: DataFrame, scorer) -> DataFrame:
    margin = _walk(spark, scorer.vectors(rows), scorer.repayment, "margin")
    return margin.select(KEY, (1.0 / (1.0 + F.exp(-2.0 * F.col("margin")))).alias("walked"))


@register("score_income", "select unique_id, true as walked, true as monthly, true as complete, true as confident from app")
def score_income(spark, sf_dir):
    """Incomes against those that the exported trees give."""
    at = _Session(spark, sf_dir)
    scorer, rows = _income(at)[0], _applicants(at)
    scored = models.score_income(rows, scorer).join(_walked_income(spark, rows, scorer), KEY)
    annual, monthly = F.col("predicted_annual_income"), F.col("predicted_monthly_income")
    share = F.col("available_features") / F.col("total_features") * 100
    return scored.select(
        KEY, _near(annual, F.col("walked")).alias("walked"), _near(F.col("walked") / 12, monthly).alias("monthly"),
        (F.abs(share - F.col("feature_completeness")) < 1e-9).alias("complete"),
        F.col("confidence_score").between(0, 1).alias("confident"))


def _follows() -> Column:
    """Whether status and prediction follow from the walked probability and the threshold."""
    status = F.when(F.col("walked") >= F.col("threshold"), "Good").otherwise("Bad")
    same = (F.col("status") == status) & (F.col("prediction") == (status == "Good").cast("int"))
    return (same & _near(F.col("probability"), F.col("walked"))).alias("follows")


@register("score_repayment", "select unique_id, 0.6::double as threshold, true as follows from app")
def score_repayment(spark, sf_dir):
    """Probability, status and class against those that the exported trees give."""
    at = _Session(spark, sf_dir)
    scorer, rows = _both(at)[0], _applicants(at)
    scored = models.score_repayment(rows, scorer, 0.6)
    return scored.join(_walked_repayment(spark, rows, scorer), KEY).select(KEY, "threshold", _follows())


@register("score_capability", "select unique_id, true as walked, true as restored, true as confidence_of_importances from app")
def score_capability(spark, sf_dir):
    """The capability score is what the exported trees give, the income is that score put back on its scale."""
    at = _Session(spark, sf_dir)
    scorer, rows = _both(at)[0], _applicants(at)
    scores = models.score_capability(rows, scorer)
    incomes = models.score_capability(rows, scorer, as_income=True).drop("confidence_score")
    walked = _walk(spark, scorer.vectors(rows), scorer.capability, "margin").select(KEY, "margin")
    back = scorer.bounds.low + F.col("capability_score") * (scorer.bounds.high - scorer.bounds.low)
    weights = [float(v) for v in scorer.capability.featureImportances.toArray()]
    mean = sum(weights) / len(weights)
    return scores.join(incomes, KEY).join(walked, KEY).select(
        KEY, _near(F.col("margin"), F.col("capability_score")).alias("walked"),
        (F.abs(back - F.col("predicted_income")) < 1e-6).alias("restored"),
        _near(F.col("confidence_score"), F.lit(mean)).alias("confidence_of_importances"))


@register("score_combined", "select unique_id, 0.5::double as threshold, true as follows, true as same_income from app")
def score_combined(spark, sf_dir):
    """Combined scores against those that the exported trees of both scorers give."""
    at = _Session(spark, sf_dir)
    rows, (income, repayment) = _applicants(at), _income_and_both(at)
    both = models.score_combined(rows, income, repayment).join(_walked_repayment(spark, rows, repayment), KEY)
    alone = _walked_income(spark, rows, income).withColumnRenamed("walked", "alone")
    return both.join(alone, KEY).select(
        KEY, "threshold", _follows(), _near(F.col("alone"), F.col("predicted_annual_income")).alias("same_income"))


@register("save_and_load_scorer", "select unique_id, true as same from app")
def save_and_load_scorer(spark, sf_dir):
    """Scores by the scorer as loaded from its folder against the fitted one."""
    at = _Session(spark, sf_dir)
    scorer, path = _income(at)[0], fresh_path(spark, "scorer")
    models.save_scorer(scorer, path)
    rows = _applicants(at)
    loaded = models.score_income(rows, models.load_scorer(spark, path))
    fitted = models.score_income(rows, scorer).select(KEY, F.col("predicted_annual_income").alias("fitted"))
    return loaded.join(fitted, KEY).select(
        KEY, (F.abs(F.col("fitted") - F.col("predicted_annual_income")) < 1e-9).alias("same"))


_TOTALS = {
    "total_credit_limit_overall": 500_000.0, "total_balance_overall": 20_000.0, "total_emi_overall": 900.0,
    "total_inquiries_overall": 3.0, "total_loan_amount_overall": 250_000.0,
}


@register("score_aggregated_requests", f"""
select unique_id, {', '.join(f'{v}::double * (unique_id % 5 + 1) as {n}' for n, v in _TOTALS.items())},
  round(20000.0::double / (500000.0::double + 1e-6 / (unique_id % 5 + 1)), 8) as overall_credit_util_ratio, true as totals_matter from app""")
def score_aggregated_requests(spark, sf_dir):
    """Requests with totals in place of slots: the totals are kept, and the scores depend on them."""
    at = _Session(spark, sf_dir)
    scorer = _income(at)[0]
    factor = F.col(KEY) % 5 + 1
    asked = _applicants(at).select(
        KEY, "age", "credit_score", "gender", "marital_status", "city", "state", "residence_ownership",
        *[(F.lit(v) * factor).alias(n) for n, v in _TOTALS.items()])
    one = asked.limit(1)
    variants = [one.withColumns({n: F.lit(v * k) for n, v in _TOTALS.items()}) for k in (0.0, 1.0, 1000.0)]
    incomes = {models.score_income(v, scorer).first()["predicted_annual_income"] for v in variants}
    return scorer.preparation.engineered(asked, KEY).select(
        KEY, *_TOTALS, F.round("overall_credit_util_ratio", 8).alias("overall_credit_util_ratio"), F.lit(len(incomes) > 1).alias("totals_matter"))


@register("score_stream_models", _REQUEST_SQL + f""", checked as (select *, {ALL_REASONS_SQL} as reasons from req)
select unique_id, reasons = '' as valid, true as same from checked""")
def score_stream_models(spark, sf_dir):
    """The stream over the fitted repayment model against the same requests scored as a table."""
    scorer, folder = _both(_Session(spark, sf_dir))[0], fresh_path(spark, "model-stream")
    requests = request_rows(spark, sf_dir)
    stage_requests(requests, f"{folder}/requests")

    def scored(batch):
        return models.score_repayment(batch, scorer, "threshold")

    score_stream(
        spark, f"{folder}/requests", f"{folder}/out", f"{folder}/checkpoint", scored, once=True).awaitTermination()
    streamed = read_scored(spark, f"{folder}/out").select(KEY, F.col("probability").alias("streamed"))
    checked = with_reasons(requests)
    table = scored(checked.where(F.size("reasons") == 0).drop("reasons")).select(KEY, "probability")
    ids = checked.select(KEY, (F.size("reasons") == 0).alias("valid"))
    joined = ids.join(streamed, KEY, "left").join(table, KEY, "left")
    agree = F.when(F.col("valid"), F.abs(F.col("streamed") - F.col("probability")) < 1e-9).otherwise(F.col("streamed").isNull())
    return joined.select(KEY, "valid", F.coalesce(agree, F.lit(False)).alias("same"))


def _values(name: str, values) -> str:
    return f"(select unnest([{', '.join(map(str, values))}]) as {name})"


_GRID_SQL = (
    "select *, 5 as folds, true as scored, true as winner_is_of_use from "
    + " cross join ".join(_values(n, v) for n, v in fv.TUNING_GRID.items()))


def _grid(spark, sf_dir, label: str, task: str) -> DataFrame:
    """Every point of the full grid; the best must beat the mean (r2) or half of the true ones (f1)."""
    vectors = _vectors(_Session(spark, sf_dir))[0]
    search = tuning.grid_search(vectors, KEY, label, task)
    scores = search.table(spark)
    return scores.select(
        *[F.col(n).cast("double" if isinstance(v[0], float) else "int").alias(n) for n, v in fv.TUNING_GRID.items()],
        F.size("fold_scores").alias("folds"), (F.abs("score") <= 1).alias("scored"),
        F.lit(search.scores[0] > (0 if task == "regression" else 0.5)).alias("winner_is_of_use"))


@register("grid_search", _GRID_SQL, applicants=False)
def grid_search(spark, sf_dir):
    return _grid(spark, sf_dir, "income_log", "regression")


@register("grid_search_classifier", _GRID_SQL, applicants=False)
def grid_search_classifier(spark, sf_dir):
    return _grid(spark, sf_dir, "repayment_ok", "classification")


@register("cross_validate", "select fold, true as beats_the_mean from range(5) r(fold)", applicants=False)
def cross_validate(spark, sf_dir):
    scores = tuning.cross_validate(_vectors(_Session(spark, sf_dir))[0], KEY, "income_log")
    return spark.createDataFrame([(k, s > 0) for k, s in enumerate(scores)], "fold long, beats_the_mean boolean")


def _draws_sql() -> str:
    rows = []
    for family in fv.VOTING_WEIGHTS:
        for p in tuning.draw_points(family, fv.RANDOM_SEARCH_TRIALS):
            trees = "null" if family == "boosted_validated" else p["trees"]
            rate = repr(p["learning_rate"]) if "learning_rate" in p else "null"
            rows.append(f"('{family}', {trees}::int, {p['depth']}, {rate}::double, true, true)")
    return f"select * from (values {', '.join(rows)}) v(family, trees, depth, learning_rate, scored, best_beats_mean)"


@register("random_search", _draws_sql(), applicants=False)
def random_search(spark, sf_dir):
    """All trials of the three families; the number of trees of early-stopped ones is found, not drawn."""
    at = _Session(spark, sf_dir)
    rest = _vectors(at)[0]
    validation = holdout_flag(KEY, 0.25, seed=43)
    rows = []
    for family in fv.VOTING_WEIGHTS:
        found = tuning.random_search(rest.where(~validation), rest.where(validation), KEY, "income_log", family)
        spread = rest.where(validation).agg(F.stddev_pop("income_log")).first()[0]
        rows += [(family, None if family == "boosted_validated" else p["trees"], p["depth"], p.get("learning_rate"),
                  0 < rmse < float("inf"), found[0][1] < spread) for p, rmse in found]
    return spark.createDataFrame(rows, "family string, trees int, depth int, learning_rate double, scored boolean, best_beats_mean boolean")


@register("train_incremental", f"""
, numbered as (select unique_id, target, floor((row_number() over (order by unique_id) - 1) / 100)::bigint as batch_id
  from app where target is not null)
select unique_id, batch_id, true as predicted, true as better_than_mean from numbered where {held_out_sql()}""")
def train_incremental(spark, sf_dir):
    """Boosting over batches of 100 rows; the held-out rows of each batch are scored by the model after it."""
    rest, test, _ = _vectors(_Session(spark, sf_dir))
    batched = assign_batches(rest.unionByName(test), KEY)
    scored = materialize(train_by_batches(batched, "batch_id", "income_log", KEY), "incremental")
    verdict = scored.agg(_better("income_log", "prediction").alias("b")).first()["b"]
    return scored.select(
        KEY, "batch_id", (F.abs("prediction") < float("inf")).alias("predicted"), F.lit(verdict).alias("better_than_mean"))


@register("tree_contributions", "select unique_id, true as adds_up, true as unused_are_zero" + _TEST_ROWS)
def tree_contributions(spark, sf_dir):
    """Contributions of the forest: with the mean they add up to its prediction, and slots without a split have none."""
    at = _Session(spark, sf_dir)
    model = explain.from_mllib(spark, _forest(at))
    rows = explain.tree_contributions(_forest(at).transform(_vectors(at)[1]), model)
    used = model.importances() > 0
    total = F.aggregate("contributions", F.lit(explain.mean_margin(model)), lambda a, v: a + v)
    unused = F.array(*[F.abs(F.col("contributions")[i]) for i in range(len(used)) if not used[i]] or [F.lit(0.0)])
    return rows.select(
        KEY, _near(total, F.col("prediction")).alias("adds_up"), (F.array_max(unused) == 0).alias("unused_are_zero"))
