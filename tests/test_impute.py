"""Imputation rules: order, absent columns, statistics, lookups."""

import hashlib

from ledgerloom.operators import impute


def _fill(df, columns):
    rules = [r for r in impute.rules_by_id() if r.column in columns]
    return impute.ImputeRules(rules).fit(df).transform(df)


def test_order_matters_for_closed_loans(spark):
    """closed loans read the loan count before the count itself is filled."""
    df = spark.createDataFrame(
        [(1, 50.0, None, None, 5.0), (2, 50.0, 4.0, None, None), (3, 30.0, None, None, 1.0)],
        "id int, age double, var_53 double, var_40 double, var_6 double")
    rows = {r["id"]: r for r in _fill(df, ["var_53", "var_40"]).collect()}
    assert (rows[1]["var_40"], rows[1]["var_53"]) == (None, 1.0)
    assert (rows[2]["var_40"], rows[2]["var_53"]) == (2.0, 4.0)
    assert (rows[3]["var_40"], rows[3]["var_53"]) == (0.0, 1.0)


def test_later_rules_see_earlier_fills(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, 60000.0), (2, None, None, 40.0, 10000.0)],
        "id int, var_32 double, var_37 double, age double, target_income double")
    rows = {r["id"]: r for r in _fill(df, ["age", "var_32", "var_37"]).collect()}
    assert (rows[1]["age"], rows[1]["var_32"], rows[1]["var_37"]) == (40.0, 750.0, 1.0)
    assert (rows[2]["var_32"], rows[2]["var_37"]) == (675.0, 0.0)


def test_null_condition_takes_the_other_branch(spark):
    df = spark.createDataFrame([(None, None), (20.0, 1.0)], "age double, target_income double")
    assert [r["age"] for r in _fill(df, ["age"]).collect()] == [30.0, 20.0]


def test_null_source_leaves_a_gap(spark):
    df = spark.createDataFrame([(None, None), (None, 10.0)], "var_1 double, var_0 double")
    assert [r["var_1"] for r in _fill(df, ["var_1"]).collect()] == [None, 4.0]


def test_absent_columns_use_the_other_fill(spark):
    df = spark.createDataFrame(
        [(None, None, None), (4.0, None, 2.0), (8.0, None, 3.0)], "var_0 double, age double, var_9 double")
    rows = _fill(df, ["var_0", "age", "var_9"]).collect()
    assert [tuple(r) for r in rows] == [(6.0, 30.0, 0.0), (4.0, 30.0, 2.0), (8.0, 30.0, 3.0)]


def test_loan_count_with_some_loan_columns(spark):
    df = spark.createDataFrame([(None, 5.0, 0.0), (None, None, 3.0)], "var_53 double, var_6 double, var_72 double")
    assert [r["var_53"] for r in _fill(df, ["var_53"]).collect()] == [1.0, 1.0]


def test_text_in_a_numeric_column_counts_as_missing(spark):
    df = spark.createDataFrame([("n/a",), ("3",), (None,)], "var_18 string")
    assert [r["var_18"] for r in _fill(df, ["var_18"]).collect()] == [0.0, 3.0, 0.0]


def test_any_other_column_gets_its_median(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (9.0,), (10.0,)], "x double")
    rule = impute.Rule("x", "{median:x}")
    filled = impute.ImputeRules([rule]).fit(df).transform(df)
    assert [r["x"] for r in filled.collect()] == [1.0, 5.5, 2.0, 9.0, 10.0]


def test_text_rules(spark):
    df = spark.createDataFrame(
        [(1, None, 60000.0, None, None, None), (2, "SAMSUNG s3", 1.0, None, "Q", "O'Hara"),
         (3, "Moto", 1.0, None, None, "O'Hara")],
        "id int, device_model string, target_income double, platform string, device_category string, gender string")
    rows = {r["id"]: r for r in _fill(
        df, ["device_model", "platform", "device_category", "gender"]).collect()}
    assert (rows[1]["device_model"], rows[1]["platform"], rows[1]["device_category"]) == (
        "iPhone", "IOS", "SMART PHONE")
    assert (rows[2]["platform"], rows[2]["device_category"]) == ("Android", "Q")
    assert rows[3]["device_category"] == "FEATURE PHONE"
    assert (rows[1]["gender"], rows[2]["gender"]) == ("Male", "O'Hara")


def test_mode_of_an_empty_column_is_unknown(spark):
    df = spark.createDataFrame([(None,)], "city string")
    assert impute.fit_modes(df, ["city"]).transform(df).first()["city"] == "Unknown"


def test_statistics_describe_the_unfilled_column(spark):
    """The median of balance 3 is taken before balance 3 is filled."""
    df = spark.createDataFrame(
        [(10.0, 1.0), (20.0, 2.0), (None, 3.0), (None, 4.0)], "var_4 double, target_income double")
    assert [r["var_4"] for r in _fill(df, ["var_4"]).collect()] == [10.0, 20.0, 0.0, 15.0]


def test_levels_give_the_same_result_as_one_rule_at_a_time(spark):
    from ledgerloom.catalog.applicants import raw_applicants

    raw = raw_applicants(spark, "/root/testdata/sf0.001").persist()
    rules = impute.rules_by_id()
    fitted = impute.ImputeRules(rules).fit(raw)
    assert len(fitted.levels) < 10
    grouped = fitted.transform(raw)
    single = impute.FittedRules(
        fitted.numeric, [[step] for rule in rules for level in fitted.levels for step in level
                         if step[0] == rule.column], {})
    assert grouped.exceptAll(single.transform(raw)).count() == 0
    raw.unpersist()


def test_lookup_then_mode(spark):
    df = spark.createDataFrame(
        [("400001", None, "Goa"), ("1", None, None), ("560100", "Pune", None), ("1", "Pune", None)],
        "pin string, city string, state string")
    rows = impute.impute_from_lookup(df, impute.pin_places(df), "pin", ["city", "state"]).collect()
    assert [tuple(r) for r in rows] == [
        ("400001", "Mumbai", "Goa"), ("1", "Pune", "Goa"), ("560100", "Pune", "Karnataka"),
        ("1", "Pune", "Goa")]


def test_whole_imputation_uses_the_fixed_lookup(spark):
    df = spark.createDataFrame(
        [(1, "110091", None, None), (2, "9", "Pune", "MH")], "id int, pin string, city string, state string")
    rows = {r["id"]: r for r in impute.impute_applicants(df).collect()}
    assert (rows[1]["city"], rows[1]["state"]) == ("Delhi", "Delhi")
    assert rows[2]["pin_anonymized"] == hashlib.sha256(b"9").hexdigest()
    assert str(rows[1]["imputation_timestamp"]) == "2025-06-14 15:18:00"


def test_dates_of_both_types(spark):
    df = spark.sql("select cast(null as timestamp) as last_updated, "
                   "cast(null as timestamp_ntz) as transaction_date")
    row = impute.fill_dates(df).selectExpr(
        "date_format(last_updated, 'yyyy-MM-dd HH:mm') as a",
        "date_format(transaction_date, 'yyyy-MM-dd HH:mm') as b").first()
    assert tuple(row) == ("2025-06-14 15:18", "2025-06-14 15:18")


def test_salted_hash_differs(spark):
    df = spark.createDataFrame([("1",)], "pin string")
    row = impute.anonymize(impute.anonymize(df, "pin"), "pin", "salted", "s").first()
    assert row["salted"] == hashlib.sha256(b"s1").hexdigest() != row["pin_anonymized"]


def test_flags_and_gaps(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert impute.columns_with_gaps(df, ["a", "b"]) == ["b"]
    assert [r["b_is_missing"] for r in impute.missing_indicators(df, ["b"]).collect()] == [1, 0]


def test_constants_by_type(spark):
    df = spark.createDataFrame([(None, None)], "a int, b string")
    row = impute.fill_constants(df, {"a": 1.5, "b": "it's"}).first()
    assert tuple(row) == (1.5, "it's")
