"""Sources, column layout, filters and request checks on hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import columns as cols
from ledgerloom.operators import validate
from ledgerloom.sources import applicants as source


def test_duplicate_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF("x", "x", "y", "x")
    assert cols.dedupe_column_names(df).columns == ["x", "x_dup1", "y", "x_dup2"]
    assert cols.dedupe_column_names(df).first()["x_dup2"] == 4


def test_mapping_both_ways(spark):
    mapping = source.participant_mapping()
    assert len(mapping) == 89
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "var_57 double, var_60 double, other double")
    renamed = cols.rename_by_mapping(df, mapping)
    assert renamed.columns == ["total_loans_2", "total_loans_2", "other"]
    back = cols.rename_by_mapping(
        spark.createDataFrame([(1.0,)], "total_loans_2 double"), mapping, reverse=True)
    assert back.columns == ["var_60"]


def test_mapping_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("column_name,description\nvar_0,first balance\n")
    assert source.read_mapping(spark, str(tmp_path / "m.csv")) == {"var_0": "first balance"}
    assert source.read_mapping(spark, str(tmp_path / "none.csv"))["var_2"] == "credit_limit_1"


def test_csv_columns_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "age,id,var_0,gender,var_1\n30,7,NaN,MALE,Inf\n,8,-Inf,,12.5\nabc,9,1,FEMALE,\n")
    rows = source.read_applicants(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        (30.0, 7, None, "MALE", None), (None, 8, None, None, 12.5), (None, 9, 1.0, "FEMALE", None)]


def test_requests_keep_known_fields_only(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"age": 35, "gender": "M", "surprise": 1}\n{"credit_score": 700.5}\n')
    df = source.read_requests(spark, str(tmp_path / "r.json"))
    assert "surprise" not in df.columns and "threshold" in df.columns
    assert {(r["age"], r["gender"], r["credit_score"]) for r in df.collect()} == {
        (35.0, "M", None), (None, None, 700.5)}


def test_number_parsing(spark):
    texts = ["1", " 2.5 ", "1e3", "x", "", "1.5d", "2f", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in cols.coerce_numeric(df, ["t"]).collect()]
    assert got == [1.0, 2.5, 1000.0, None, None, None, None, None]


def test_classification_rules(spark):
    df = spark.createDataFrame(
        [(1.0, "1", "2", None), (2.0, "x", "3", None)], "a double, b string, c string, d string")
    kinds = {rule: cols.classify_columns(df, rule) for rule in ("dtype", "all_parse", "any_parse")}
    assert kinds["dtype"] == dict(a="numeric", b="categorical", c="categorical", d="categorical")
    assert kinds["all_parse"] == dict(a="numeric", b="categorical", c="numeric", d="numeric")
    assert kinds["any_parse"] == dict(a="numeric", b="numeric", c="numeric", d="categorical")


@pytest.mark.parametrize("fill, number, text", [
    ("zero", 0.0, "0"), ("null", None, None), ("by_type", 0.0, "Unknown")])
def test_align(spark, fill, number, text):
    df = spark.createDataFrame([(1, 5, "z")], "id int, b int, extra string")
    out = cols.align_to_features(
        df, [("a", "double"), ("b", "double"), ("c", "string")], fill, keep=["id"])
    assert out.columns == ["id", "a", "b", "c"]
    assert tuple(out.first()) == (1, number, 5.0, text)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="target"):
        cols.require_columns(spark.range(1), ["id", "target"])


def test_infinities(spark):
    df = spark.createDataFrame(
        [(math.nan,), (math.inf,), (-math.inf,), (1.5,), (None,)], "x double")
    assert [r[0] for r in source.null_out_infinities(df).collect()] == [None, None, None, 1.5, None]


def test_sparse_limit_is_strict(spark):
    df = spark.createDataFrame(
        [(1, 1, None), (1, None, None), (1, 1, None), (1, None, 1)], "a int, b int, c int")
    assert validate.drop_sparse_columns(df).columns == ["a", "b"]
    assert validate.drop_sparse_columns(df, keep=["c"]).columns == ["a", "b", "c"]


def test_requests_are_split(spark):
    rows = [
        (1, 35.0, "male", "Married", "x", "y", "rented", 750.0),
        (2, 17.0, "male", "Married", "x", "y", "rented", 950.0),
        (3, None, "none", "Married", None, "y", "rented", 700.0),
        (4, 18.0, "OTHER", "single", "x", "y", "Parental", 300.0),
    ]
    df = spark.createDataFrame(rows, "id int, age double, gender string, marital_status string, "
                               "city string, state string, residence_ownership string, credit_score double")
    valid, rejected = validate.validate_requests(df)
    assert {(r["id"], r["gender"], r["residence_ownership"]) for r in valid.collect()} == {
        (1, "MALE", "RENTED"), (4, "OTHER", "PARENTAL")}
    assert {r["id"]: r["reasons"] for r in rejected.collect()} == {
        2: ["age out of range", "credit_score out of range"],
        3: ["missing age", "missing city", "gender not allowed"]}


def test_absent_required_field_rejects_every_row(spark):
    valid, rejected = validate.validate_requests(spark.range(3), required=["age"], enums={}, ranges={})
    assert valid.count() == 0
    assert rejected.first()["reasons"] == ["missing age"]


def test_copy_columns(spark):
    out = cols.copy_columns(spark.range(1), {"copied": "id", "made": "absent"}).first()
    assert (out["copied"], out["made"]) == (0, 0)


def test_head_is_a_top_k(spark):
    assert [r["id"] for r in cols.head(spark.range(100), 3, [F.desc("id")]).collect()] == [99, 98, 97]
