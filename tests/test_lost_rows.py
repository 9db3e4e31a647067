"""Rows that were once lost, swapped, doubled or mislabelled."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import columns, features, impute, profile, score, split, validate
from ledgerloom.plans.shared import Stored, fresh_path, shared_dir
from ledgerloom.sources import applicants as source
from ledgerloom.streaming.score_stream import read_scored, score_stream


def _write(spark, label, files):
    folder = fresh_path(spark, label).removeprefix("file:")
    os.makedirs(folder)
    for name, text in files.items():
        with open(f"{folder}/{name}", "w") as out:
            out.write(text)
    return folder


def test_csv_files_with_another_header_fail(spark):
    """Better than columns that change places."""
    folder = _write(spark, "csv", {"a.csv": "id,age,var_0\n1,40,200\n", "b.csv": "id,var_0,age\n2,200,40\n"})
    with pytest.raises(Exception):
        source.read_applicants(spark, folder).collect()
    same = _write(spark, "csv", {"a.csv": "id,age,var_0\n1,40,200\n", "b.csv": "id,age,var_0\n2,41,300\n"})
    assert sorted(map(tuple, source.read_applicants(spark, same).collect())) == [(1, 40.0, 200.0), (2, 41.0, 300.0)]


def test_splits_keep_rows_without_key_or_label(spark):
    df = spark.range(1000).selectExpr("if(id % 80 = 0, null, id) as k", "if(id % 150 = 0, null, id % 2) as y")
    for parts in (split.split_holdout(df, "k"), split.split_train_val_test(df, "k"), split.split_stratified(df, "k", "y")):
        assert sum(p.count() for p in parts) == 1000
    assert split.split_holdout(df, "k")[1].where("k is null").count() == 0


@pytest.mark.parametrize("fraction", [0.004, 0.2, 0.503])
def test_holdout_share_is_not_rounded(spark, fraction):
    test = split.split_holdout(spark.range(20_000), "id", fraction)[1].count()
    assert abs(test - 20_000 * fraction) < 4 * (20_000 * fraction) ** 0.5


def test_unknown_probability_has_no_status(spark):
    df = spark.createDataFrame([(1, None), (2, 0.4), (3, 0.6)], "id long, p double")
    rows = {r["id"]: (r["prediction"], r["status"]) for r in score.apply_threshold(df, "p").collect()}
    assert rows == {1: (None, None), 2: (0, "Bad"), 3: (1, "Good")}


def test_repeated_lookup_keys_do_not_double_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, None, "X")], "id long, pin string, city string")
    lookup = spark.createDataFrame([("a", "Z"), ("a", "B"), ("b", "C"), (None, "N")], "pin string, city string")
    filled = impute.impute_from_lookup(df, lookup, "pin", ["city"], fallback={"city": None})
    assert sorted(map(tuple, filled.select("id", "city").collect())) == [(1, "B"), (2, "C"), (3, "X")]
    table = spark.createDataFrame([("a", 2.0), ("a", 1.0)], "pin string, digital_literacy_score double")
    wide = features.enrich_external(df, table, "pin")
    assert sorted((r["id"], r["digital_literacy_score"]) for r in wide.collect()) == [(1, 1.0), (2, None), (3, None)]


def test_malformed_requests_are_rejected_with_their_text(spark):
    good = '{"unique_id": 1, "age": 30, "gender": "male", "var_0": 5}'
    folder = _write(spark, "requests", {"a.json": good + "\n{broken\n"})
    requests = source.read_requests(spark, folder)
    valid, rejected = validate.validate_requests(requests, required=())
    assert [(r["unique_id"], r["balance_1"]) for r in valid.collect()] == [(1, 5.0)]
    assert rejected.first()["reasons"] == ["malformed record: {broken"]
    out = fresh_path(spark, "out")
    score_stream(spark, folder, out, f"{out}-checkpoint", lambda b: b.select("unique_id", "balance_1"),
                 checks={"required": []}, once=True).awaitTermination()
    assert [tuple(r) for r in read_scored(spark, out).collect()] == [(1, 5.0)]
    assert read_scored(spark, out, "rejected").first()["reasons"] == ["malformed record: {broken"]


def test_requests_keep_external_fields(spark):
    folder = _write(spark, "requests", {"a.json": '{"unique_id": 1, "pin_code_frequency": 4, "night_light_intensity": 0.5}\n'})
    row = source.read_requests(spark, folder).first()
    assert (row["pin_code_frequency"], row["night_light_intensity"]) == (4.0, 0.5)


def test_descriptive_value_wins_over_raw(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, 7.0)], "unique_id long, var_0 double, balance_1 double")
    assert [r["balance_1"] for r in source.rename_raw(df).orderBy("unique_id").collect()] == [5.0, 7.0]


@pytest.mark.parametrize("names,expected", [
    (["x", "x", "x_dup1"], ["x", "x_dup2", "x_dup1"]),
    (["x_dup1", "x", "x", "x"], ["x_dup1", "x", "x_dup2", "x_dup3"]),
    (["a", "a", "b", "a", "b"], ["a", "a_dup1", "b", "a_dup2", "b_dup1"]),
])
def test_deduplicated_names_never_collide(spark, names, expected):
    df = spark.createDataFrame([tuple(range(len(names)))], [f"c{i}" for i in range(len(names))]).toDF(*names)
    assert columns.dedupe_column_names(df).columns == expected


def test_describe_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b long")
    rows = {r["feature"]: (r["count"], r["mean"], r["max"]) for r in profile.describe(empty).collect()}
    assert rows == {"a": (0, None, None), "b": (0, None, None)}


def test_stored_copies_are_dropped(spark):
    stored = Stored(spark.range(5), "copy")
    assert stored.frame.count() == 5 and stored.path.startswith(shared_dir(spark))
    stored.drop()
    assert not os.path.exists(stored.path.removeprefix("file:"))


def test_all_orders_count_for_closed_loans(spark):
    """Customers have more orders than there are slots."""
    from ledgerloom.catalog.applicants import applicants, table

    folder = "/root/testdata/sf0.001"
    closed = table(spark, folder, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").count()
    found = applicants(spark, folder).select(F.col("unique_id").alias("o_custkey"), "closed_total_loans")
    assert found.join(closed, "o_custkey").where("closed_total_loans <> count").count() == 0
