"""Metrics against direct computation."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, score


def test_regression_metrics_and_undefined_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0), (5.0, None)], "y double, p double")
    row = evaluate.regression_metrics(df, "y", "p").first()
    assert (row["mse"], row["mae"], row["r2"]) == (0.5, 0.5, 0.5)
    assert evaluate.regression_metrics(df.where("y = 1"), "y", "p").first()["r2"] is None


def _brute_auc(pairs):
    ones = [s for y, s in pairs if y == 1]
    zeros = [s for y, s in pairs if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    return wins / (len(ones) * len(zeros))


@pytest.mark.parametrize("digits", [1, 6])
def test_auc_counts_ties_half(spark, digits):
    draw = random.Random(2)
    pairs = [(int(draw.random() < 0.3), round(draw.random(), digits)) for _ in range(400)]
    # A third of the rows share one score.
    pairs += [(i % 2, 0.5) for i in range(200)]
    df = spark.createDataFrame(pairs, "y int, s double").repartition(5)
    assert evaluate.auc_roc(df, "y", "s").first()["auc"] == pytest.approx(_brute_auc(pairs))


def test_auc_exchanges_rows_once(spark, monkeypatch):
    """Only the counts of ranges are exchanged besides the rows between cuts, whatever the number of ranges."""
    draw = random.Random(4)
    pairs = [(int(draw.random() < 0.4), draw.choice([draw.random(), 0.25, float("nan")])) for _ in range(900)]
    df = spark.createDataFrame(pairs, "y int, s double").repartition(3)
    known = [(y, 2.0 if s != s else s) for y, s in pairs]  # NaN is the greatest score
    plans = []
    stored = evaluate.Stored
    monkeypatch.setattr(evaluate, "Stored", lambda df, label: plans.append((label, df)) or stored(df, label))
    for ranges in (1, 7, 64):
        assert evaluate.auc_roc(df, "y", "s", ranges).first()["auc"] == pytest.approx(_brute_auc(known))
    plan = dict(plans)["score-ranges"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("Exchange") - plan.count("ENSURE_REQUIREMENTS") <= 2


def test_auc_of_one_class_is_undefined(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert evaluate.auc_roc(df, "y", "s").first()["auc"] is None


def test_classification_without_calls(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    assert tuple(evaluate.classification_metrics(df, "y", "p").first()) == (0.5, 0.0, 0.0, 0.0)


def test_confusion_matrix_has_every_cell(spark):
    df = spark.createDataFrame([(0, 0), (2, 1), (2, 2), (None, 1)], "y int, p int")
    cells = {(r["label"], r["predicted"]): r["count"] for r in evaluate.confusion_matrix(df, "y", "p").collect()}
    assert len(cells) == 9
    assert {k: v for k, v in cells.items() if v} == {(0, 0): 1, (2, 1): 1, (2, 2): 1}


def test_report_rows(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, p int")
    rows = {r["class"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert set(rows) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rows["1"]["precision"] == pytest.approx(2 / 3) and rows["1"]["support"] == 2
    assert rows["accuracy"]["f1"] == 0.75
    assert rows["macro avg"]["recall"] == pytest.approx(0.75)


def test_confidence_is_kept_within_bounds(spark):
    df = spark.createDataFrame([(10.0, 10.0), (1.0, 3.0), (0.0, 0.0), (-1.0, 9.0)], "a double, b double")
    values = [r[0] for r in df.select(score.ensemble_confidence([F.col("a"), F.col("b")])).collect()]
    assert values == [1.0, 0.5, 0.0, 0.0]


def test_threshold_is_checked(spark):
    df = spark.createDataFrame([(0.5, None), (0.5, 0.7), (0.5, 1.2)], "p double, t double")
    with pytest.raises(ValueError):
        score.apply_threshold(df, "p", 1.5)
    rows = score.apply_threshold(df, "p", "t").collect()
    assert [(r["prediction"], r["status"], r["threshold"]) for r in rows] == [
        (1, "Good", 0.5), (0, "Bad", 0.7), (None, None, 1.2)]
    assert score.importance_confidence([0.2, 0.3, 0.5]) == pytest.approx(1 / 3)
