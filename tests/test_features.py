"""Families, ratios, bands and labels on edge rows."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import rowwise
from ledgerloom.functions.scalars import age_bin, eligibility_band, ratio
from ledgerloom.operators import features


def test_reducers_skip_nulls(spark):
    df = spark.createDataFrame(
        [(None, None, None), (1.0, None, None), (1.0, 2.0, 6.0), (5.0, 5.0, None)],
        "a double, b double, c double")
    names = df.columns
    rows = df.select(
        rowwise.row_sum(names), rowwise.row_mean(names), rowwise.row_max(names),
        rowwise.row_count(names), rowwise.row_std(names)).collect()
    assert [tuple(r) for r in rows[:2]] == [(0.0, None, None, 0, None), (1.0, 1.0, 1.0, 1, None)]
    assert rows[2][:4] == (9.0, 3.0, 6.0, 3)
    assert rows[2][4] == pytest.approx(math.sqrt(7))
    assert rows[3][4] == 0.0


def test_empty_and_single_families(spark):
    df = spark.createDataFrame([(2.0,)], "a double")
    row = df.select(rowwise.row_sum([]), rowwise.row_mean([]), rowwise.row_max([]),
                    rowwise.row_count([]), rowwise.row_std([]), rowwise.row_max(["a"])).first()
    assert tuple(row) == (0.0, None, None, 0, None, 2.0)


def test_family_modes():
    names = ["credit_limit_1", "credit_limit_recent_1", "active_credit_limit_1",
             "credit_limit_1_is_missing", "total_credit_limit"]
    pick = rowwise.select_family
    assert pick(names, "regex", r"credit_limit_\d+") == ["credit_limit_1", "active_credit_limit_1"]
    assert pick(names, "regex", r"credit_limit_\d+", exclude_flags=False)[-1] == "credit_limit_1_is_missing"
    assert pick(names, "prefix", "credit_limit_") == ["credit_limit_1", "credit_limit_recent_1"]
    assert "total_credit_limit" in pick(names, "substring", "credit_limit")
    with pytest.raises(ValueError):
        pick(names, "suffix", "x")


def test_both_spellings_of_inquiries(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "total_inquiries_1 double, total_inquires_3 double")
    assert features.add_overall_families(df).first()["total_inquiries_overall"] == 3.0


def test_age_bands(spark):
    ages = [0.0, 24.0, 24.9, 25.0, 34.0, 35.0, 45.0, 54.9, 55.0, 120.0, -1.0, None]
    df = spark.createDataFrame([(a,) for a in ages], "age double")
    assert [r[0] for r in df.select(age_bin(F.col("age"))).collect()] == [
        "<25", "<25", "<25", "25-34", "25-34", "35-44", "45-54", "45-54", "55+", "55+", None, None]


def test_ratio_without_a_denominator(spark):
    df = spark.createDataFrame([(4.0, 0.0), (4.0, None), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"), 0)).collect()] == [None, None, 2.0]
    assert df.select(ratio(F.col("a"), F.col("b"))).first()[0] == pytest.approx(4e6)


def test_perfect_consistency(spark):
    df = spark.createDataFrame([(5.0, 5.0), (5.0, None)], "repayment_1 double, repayment_2 double")
    scores = [r["repayment_consistency_score"] for r in features.add_repayment_behaviour(df).collect()]
    assert scores == [pytest.approx(1e6), pytest.approx(1e6)]


def test_a_supplied_total_is_kept(spark):
    df = spark.createDataFrame([(500.0, 40.0)], "total_loan_amount double, age double")
    row = features.add_profile_features(df).first()
    assert (row["total_loan_amount"], row["age_squared"], row["recent_inquiries"]) == (500.0, 1600.0, 0.0)


def test_flags_stay_out_of_families(spark):
    df = spark.createDataFrame([(10.0, 1)], "credit_limit_1 double, credit_limit_2_is_missing int")
    total = "total_credit_limit_overall"
    assert features.add_overall_families(df).first()[total] == 10.0
    assert features.add_overall_families(df, exclude_flags=False).first()[total] == 11.0


def test_frequency_counts_missing_values_together(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), (None,), ("b",)], "pin string")
    rows = features.frequency(df, "pin", "n").collect()
    assert sorted((r["pin"] or "", r["n"]) for r in rows) == [
        ("", 3), ("", 3), ("", 3), ("a", 2), ("a", 2), ("b", 1)]


def test_minmax_of_a_constant(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [r["s"] for r in features.minmax_scale(df, "x", "s").collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        features.fit_minmax(df.where("x > 9"), "x")


def test_minmax_round_trip(spark):
    df = spark.createDataFrame([(4.0,), (10.0,), (7.0,)], "x double")
    bounds = features.fit_minmax(df, "x")
    back = df.select(bounds.inverse(bounds.scale(F.col("x")))).collect()
    assert [r[0] for r in back] == [4.0, 10.0, 7.0]


def test_label_at_the_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "target double")
    assert [r["repayment_status"] for r in features.label_repayment_status(df).collect()] == [0, 1, 1, 0]


def test_log_of_impossible_values(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (-2.0,), (None,)], "x double")
    assert [r["x_log"] for r in features.log1p_columns(df, ["x", "y"]).collect()] == [0.0, None, None, None]


def test_bands(spark):
    df = spark.createDataFrame([(0.81,), (0.8,), (0.6,), (0.59,), (None,)], "p double")
    assert [r[0] for r in df.select(eligibility_band(F.col("p"))).collect()] == [
        "above_limit", "up_to_limit", "up_to_limit", "improve_profile", None]


def test_enrichment_adds_only_new_columns(spark):
    area = spark.createDataFrame([("1", 0.5, 9.0)], "area string, market_density_score double, other double")
    df = spark.createDataFrame([("1",), ("2",)], "pin string")
    out = features.enrich_external(df, area, "pin") if "pin" in area.columns else \
        features.enrich_external(df.withColumnRenamed("pin", "area"), area, "area")
    assert out.columns == ["area", "market_density_score"]
    assert sorted((r[0], r[1]) for r in out.collect()) == [("1", 0.5), ("2", None)]


def test_features_do_not_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").selectExpr(
        "c_custkey as id", "c_acctbal as credit_limit_1", "c_acctbal * 2 as balance_1",
        "c_acctbal as repayment_1", "c_acctbal as repayment_2", "c_acctbal as age")
    plan = features.engineer_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
