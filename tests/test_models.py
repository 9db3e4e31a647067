"""Trained models: better than the mean, stable, saved and loaded, streamed."""

from threading import Barrier

import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import model_queries
from ledgerloom.catalog.applicants import applicants
from ledgerloom.operators import encode, evaluate, train, tuning
from ledgerloom.plans import applicant_models as models
from ledgerloom.plans.shared import fresh_path, materialize
from ledgerloom.streaming import train_stream
from ledgerloom.streaming.score_stream import read_scored, score_stream, stage_requests

SF_DIR = "/root/testdata/sf0.01"
SMALL = {"trees": 8, "depth": 3, "learning_rate": 0.2}


@pytest.fixture(scope="module")
def rows(spark):
    return materialize(applicants(spark, SF_DIR).drop("last_updated", "transaction_date"), "rows")


@pytest.fixture(scope="module")
def income(rows):
    return models.fit_income_scorer(rows, "unique_id", "target", SMALL, {"trees": 10, "depth": 5})


@pytest.fixture(scope="module")
def both(rows):
    return models.fit_both_scorers(rows, "unique_id", "target", SMALL)


def _by_key(df):
    return {r["unique_id"]: r for r in df.collect()}


def test_income_beats_the_mean(income):
    _, scored = income
    metrics = evaluate.regression_metrics(scored, "target", "prediction").first()
    assert metrics["r2"] > 0.3


def test_target_is_no_input(income):
    scorer, _ = income
    names = models._slot_names(scorer.preparation)
    assert "target" not in names
    assert not {"debt_to_income_ratio", "income_to_emi_ratio"} & set(names)
    assert len(names) == len(set(names))


def test_every_row_is_scored_once(rows, income):
    scorer, _ = income
    scored = models.score_income(rows, scorer)
    found = _by_key(scored)
    assert len(found) == scored.count() == rows.count()
    one = next(iter(found.values()))
    assert one["predicted_monthly_income"] == pytest.approx(one["predicted_annual_income"] / 12)
    assert all(0 <= r["confidence_score"] <= 1 and 0 < r["feature_completeness"] <= 100 for r in found.values())


def test_scores_do_not_depend_on_partitioning_or_column_order(rows, income):
    scorer, _ = income
    mixed = rows.repartition(7).select(*[F.col(f"`{c}`") for c in reversed(rows.columns)])
    first = _by_key(models.score_income(rows, scorer))
    second = _by_key(models.score_income(mixed, scorer))
    assert first == second


def test_absent_and_unseen_inputs_are_scored(spark, income):
    scorer, _ = income
    df = spark.createDataFrame([(1, 30.0, "Atlantis"), (2, None, None)], "unique_id long, age double, city string")
    found = _by_key(models.score_income(df, scorer))
    assert all(r["predicted_annual_income"] > 0 for r in found.values())
    assert (found[1]["available_features"], found[2]["available_features"]) == (2, 0)


def test_vote_is_the_weighted_mean(income):
    _, scored = income
    row = scored.first()
    expected = (0.4 * row["prediction_boosted"] + 0.4 * row["prediction_boosted_validated"]
                + 0.2 * row["prediction_forest"])
    assert row["prediction"] == pytest.approx(expected)


def test_repayment_and_capability(both, rows):
    scorer, test = both
    classified = train.probability_of_one(scorer.repayment.transform(test))
    assert evaluate.auc_roc(classified, "repayment_ok", "probability_of_one").first()["auc"] > 0.75
    strict = models.score_repayment(rows, scorer, 0.9).where("prediction = 1").count()
    loose = models.score_repayment(rows, scorer, 0.1).where("prediction = 1").count()
    assert strict <= loose and loose > 0
    scaled = _by_key(models.score_capability(rows, scorer))
    rupees = _by_key(models.score_capability(rows, scorer, as_income=True))
    low, high = scorer.bounds.low, scorer.bounds.high
    key = next(iter(scaled))
    assert rupees[key]["predicted_income"] == pytest.approx(
        scaled[key]["capability_score"] * (high - low) + low)


def test_combined_equals_the_single_scores(rows, income, both):
    combined = _by_key(models.score_combined(rows, income[0], both[0]))
    alone = _by_key(models.score_income(rows, income[0]))
    repayment = _by_key(models.score_repayment(rows, both[0]))
    for key, row in combined.items():
        assert row["predicted_annual_income"] == alone[key]["predicted_annual_income"]
        assert (row["probability"], row["status"]) == (repayment[key]["probability"], repayment[key]["status"])


def test_saved_scorers_score_the_same(spark, rows, income, both):
    path = fresh_path(spark, "saved")
    models.save_scorer(income[0], f"{path}/income")
    models.save_scorer(both[0], f"{path}/both")
    assert _by_key(models.score_income(rows, models.load_scorer(spark, f"{path}/income"))) == _by_key(
        models.score_income(rows, income[0]))
    loaded = models.load_scorer(spark, f"{path}/both")
    assert loaded.bounds == both[0].bounds
    assert _by_key(models.score_repayment(rows, loaded)) == _by_key(models.score_repayment(rows, both[0]))
    importances = spark.read.parquet(f"{path}/income/importances/income_forest")
    assert importances.agg(F.sum("Importance")).first()[0] == pytest.approx(1.0)


def test_stream_equals_batch(spark, rows, income):
    """Three micro-batches, then a restart with new files, against one batch job."""
    scorer, _ = income
    folder = fresh_path(spark, "stream")
    checks = {"required": ["age"], "enums": {"gender": ["MALE", "FEMALE"]}}

    def run():
        score_stream(
            spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint",
            lambda batch: models.score_income(batch, scorer), checks=checks, files_per_batch=1, once=True,
        ).awaitTermination()

    stage_requests(rows.where("unique_id % 2 = 0").repartition(3), f"{folder}/in")
    run()
    stage_requests(rows.where("unique_id % 2 = 1").coalesce(1), f"{folder}/in")
    run()
    streamed = read_scored(spark, f"{folder}/out")
    rejected = read_scored(spark, f"{folder}/out", "rejected")
    batch = models.score_income(rows.where("age is not null"), scorer)
    assert _by_key(streamed) == _by_key(batch)
    assert streamed.count() == batch.count()
    assert rejected.count() == rows.where("age is null").count()
    assert rejected.first()["reasons"] == ["missing age"]


def test_permutation_importance_finds_the_signal(spark):
    df = spark.range(600).selectExpr("id", "rand(1) as a", "rand(2) as b").withColumn(
        "y", F.col("a") * 10 + F.col("b") * 0.01)
    from pyspark.ml.feature import VectorAssembler

    vectors = materialize(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df), "v")
    model = train.fit_forest_regressor(vectors, "y", {"trees": 10, "depth": 5, "feature_share": 1.0})
    table = {r["feature"]: r["rmse_increase"] for r in evaluate.permutation_importance(
        model, vectors, "id", "y").collect()}
    again = {r["feature"]: r["rmse_increase"] for r in evaluate.permutation_importance(
        model, vectors.repartition(5), "id", "y").collect()}
    assert table["a"] > 1 > table["b"]
    assert table == {k: pytest.approx(v) for k, v in again.items()}
    first = evaluate.feature_importance(spark, model, encode.feature_names(vectors), top_n=1).first()
    assert first["Feature"] == "a"


def test_random_search_is_sorted_and_repeatable(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(300).selectExpr("id", "id % 17 as a", "id % 17 * 2D + id % 3 as y")
    vectors = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    space = {"trees": (2, 6, 2), "depth": (1, 3)}
    runs = [tuning.random_search(vectors.where("id % 5 > 0"), vectors.where("id % 5 = 0"), "id", "y",
                                 trials=3, space=space) for _ in range(2)]
    assert [r for _, r in runs[0]] == sorted(r for _, r in runs[0])
    assert [p for p, _ in runs[0]] == [p for p, _ in runs[1]]


def test_boosting_stops_on_validation(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(400).selectExpr("id", "rand(3) as a", "rand(4) as y")
    vectors = materialize(VectorAssembler(inputCols=["a"], outputCol="features").transform(df), "noise")
    model = train.fit_boosted_regressor(
        vectors.where("id % 4 > 0"), "y", {"trees": 40, "depth": 4, "learning_rate": 0.5},
        validation=vectors.where("id % 4 = 0"))
    assert model.getNumTrees < 40


def test_totals_of_requests_reach_the_score(spark, income):
    """Three requests that differ in their totals alone."""
    scorer, _ = income
    totals = ("total_credit_limit_overall", "total_balance_overall", "total_emi_overall",
              "total_inquiries_overall", "total_loan_amount_overall")
    df = spark.createDataFrame(
        [(1, 30.0, None), (2, 30.0, 500_000.0), (3, 30.0, 5e8)], "unique_id long, age double, t double"
    ).select("unique_id", "age", *[F.col("t").alias(c) for c in totals])
    engineered = _by_key(scorer.preparation.engineered(df, "unique_id"))
    assert [engineered[k]["total_credit_limit_overall"] for k in (1, 2, 3)] == [0.0, 500_000.0, 5e8]
    incomes = [r["predicted_annual_income"] for r in _by_key(models.score_income(df, scorer)).values()]
    assert len(set(incomes)) > 1


def test_slots_win_over_a_supplied_total(spark, income):
    df = spark.createDataFrame([(1, 10.0, 99.0)], "unique_id long, credit_limit_1 double, total_credit_limit_overall double")
    row = income[0].preparation.engineered(df, "unique_id").first()
    assert row["total_credit_limit_overall"] == 10.0


def test_raw_names_are_scored_like_descriptive_ones(rows, income):
    from ledgerloom.sources.applicants import participant_mapping

    scorer, _ = income
    raw = {m: r for r, m in reversed(participant_mapping().items())}
    some = rows.where("unique_id < 40").drop("total_loans_2_dup1")
    renamed = some.toDF(*[raw[c] if c != "unique_id" and c in raw else c for c in some.columns])
    assert "var_0" in renamed.columns
    assert _by_key(models.score_income(renamed, scorer)) == _by_key(models.score_income(some, scorer))


def test_pin_frequency_is_an_input(spark, rows, income):
    scorer, _ = income
    assert "pin_code_frequency" in [n for n, _ in scorer.preparation.inputs]
    df = rows.select("unique_id", "pin code").limit(3).unionByName(
        spark.createDataFrame([(-1, "nowhere")], "unique_id long, `pin code` string"))
    found = _by_key(scorer.preparation.engineered(df, "unique_id"))
    assert found[-1]["pin_code_frequency"] == 0 and all(r["pin_code_frequency"] > 0 for k, r in found.items() if k > 0)
    supplied = spark.createDataFrame([(1, "nowhere", 7.0)], "unique_id long, `pin code` string, pin_code_frequency double")
    assert scorer.preparation.engineered(supplied, "unique_id").first()["pin_code_frequency"] == 7.0


def test_saving_over_the_folder_a_scorer_came_from(spark, rows, both):
    path = fresh_path(spark, "saved-twice")
    models.save_scorer(both[0], path)
    loaded = models.load_scorer(spark, path)
    models.save_scorer(loaded, path)
    again = models.load_scorer(spark, path)
    assert _by_key(models.score_repayment(rows, again)) == _by_key(models.score_repayment(rows, both[0]))


def test_encoding_by_name(rows):
    """A text column is target-encoded when its name says so."""
    known = rows.where("target is not null")
    fitted = models.fit_preparation(known, "unique_id", "target", target_encoded=["device_model", "city"])
    assert {"device_model", "city"} <= set(fitted.numeric) and "gender" in fitted.categorical


def test_tuned_income_is_fitted_with_the_winners(spark, rows):
    space = {"trees": (2, 4, 2), "depth": (2, 3), "learning_rate": (0.1, 0.3)}
    scorer, scored, winners = models.fit_tuned_income(rows, "unique_id", trials=2, space=space)
    assert set(winners) == {"boosted", "boosted_validated", "forest"}
    assert scorer.income.members["boosted"].getNumTrees == winners["boosted"]["trees"]
    assert scorer.income.members["forest"].getNumTrees == winners["forest"]["trees"]
    assert evaluate.regression_metrics(scored, "target", "prediction").first()["r2"] > 0
    path = fresh_path(spark, "tuned")
    models.save_scorer(scorer, path)
    assert _by_key(models.score_income(rows, models.load_scorer(spark, path))) == _by_key(models.score_income(rows, scorer))


def test_tuned_repayment_is_the_best_of_the_grid(spark, rows):
    scorer, test = models.fit_tuned_repayment(
        rows, "unique_id", grid={"depth": [1, 3]}, folds=2, params={"trees": 3, "depth": 2, "learning_rate": 0.3})
    scored = train.probability_of_one(scorer.repayment.transform(test))
    assert evaluate.auc_roc(scored, "repayment_ok", "probability_of_one").first()["auc"] > 0.6
    assert any(n.endswith("_log") for n in scorer.preparation.numeric)
    path = fresh_path(spark, "tuned-repayment")
    models.save_scorer(scorer, path)
    loaded = models.load_scorer(spark, path)
    assert loaded.profiled
    assert _by_key(models.score_repayment(rows, loaded)) == _by_key(models.score_repayment(rows, scorer))


def test_boosting_goes_on_from_batch_to_batch(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(1200).selectExpr("id", "cast(id % 3 as long) as batch", "rand(5) as a").withColumn("y", F.col("a") * 10)
    vectors = materialize(VectorAssembler(inputCols=["a"], outputCol="features").transform(df), "batches")
    scored = train_stream.train_incremental(vectors, "batch", "y", "id", {"trees": 4, "depth": 3, "learning_rate": 0.3})
    errors = {r["batch"]: r["rmse"] for r in evaluate.batch_metrics(scored, "batch", "y", "prediction").collect()}
    assert errors[2] < errors[1] < errors[0]
    assert scored.select("id").distinct().count() == scored.count()


def test_grid_and_cross_validation(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(300).selectExpr("id", "id % 17 as a", "id % 17 * 2D + id % 3 as y")
    vectors = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    params = {"trees": 3, "depth": 2, "learning_rate": 0.3}
    search = tuning.grid_search(vectors, "id", "y", grid={"depth": [1, 4], "trees": [2, 3]}, folds=3, params=params)
    table = search.table(spark).collect()
    assert {(r.depth, r.trees) for r in table} == {(1, 2), (1, 3), (4, 2), (4, 3)}
    assert search.best == {"depth": 4, "trees": 3} and len(table[0].fold_scores) == 3
    alone = tuning.cross_validate(vectors, "id", "y", {**params, "trees": 3, "depth": 4}, folds=3)
    assert alone == pytest.approx(search.fold_scores[0]) and min(alone) > 0.3


def test_halving_keeps_the_best_trials(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(400).selectExpr("id", "id % 17 as a", "id % 5 as b", "id % 17 * 2D + id % 5 as y")
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    sides = vectors.where("id % 4 > 0"), vectors.where("id % 4 = 0")
    space = {"trees": (6, 12, 2), "depth": (1, 4), "learning_rate": (0.02, 0.5)}
    full = tuning.random_search(*sides, "id", "y", trials=8, space=space)
    halved = tuning.random_search(*sides, "id", "y", trials=8, space=space, rungs=(0.25, 0.5))
    assert len(full) == 8 and len(halved) == 2
    assert halved[0][0] == full[0][0] and halved[0][1] == pytest.approx(full[0][1])
    stopped = tuning.random_search(*sides, "id", "y", "boosted_validated", trials=3, space=space)
    assert all(p["trees"] <= 12 for p, _ in stopped) and stopped[0][1] <= stopped[-1][1]


def test_independent_fits_run_side_by_side():
    from threading import Barrier

    both_run = Barrier(2, timeout=30)
    found = train.fit_side_by_side({n: lambda n=n: (both_run.wait(), n)[1] for n in ("a", "b")})
    assert found == {"a": "a", "b": "b"}


def test_fits_and_scores_derive_the_applicants_once(spark, monkeypatch):
    from ledgerloom.catalog import model_queries

    calls = []

    def derived(session, sf_dir):
        calls.append(sf_dir)
        return session.range(3).selectExpr("id as unique_id", "id as last_updated", "id as transaction_date")

    monkeypatch.setattr(model_queries, "applicants", derived)
    at = model_queries._Session.__new__(model_queries._Session)
    at.spark, at.sf_dir, at.state = spark, "own rows", ("test", spark.sparkContext.applicationId)
    assert model_queries._rows(at).columns == ["unique_id"]
    assert model_queries._applicants(at).count() == model_queries._rows(at).count() == 3
    assert calls == ["own rows"]


def test_combined_scorers_are_fitted_side_by_side(spark, monkeypatch):
    """Each fit waits for the other to begin."""
    met, given = Barrier(2, timeout=20), []

    def fit(name):
        def run(at):
            met.wait()
            return name, None
        return run

    class Scored(Exception):
        pass

    def score(rows, income, repayment):
        given.extend([rows, income, repayment])
        raise Scored

    monkeypatch.setattr(model_queries, "_applicants", lambda at: "rows")
    monkeypatch.setattr(model_queries, "_income", fit("income"))
    monkeypatch.setattr(model_queries, "_both", fit("both"))
    monkeypatch.setattr(models, "score_combined", score)
    with pytest.raises(Scored):
        model_queries.score_combined(spark, SF_DIR)
    assert given == ["rows", "income", "both"]
