"""Profiles, correlations, encodings and splits."""

import math
import random
from hashlib import md5

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ledgerloom.operators import encode, profile, split

numpy = pytest.importorskip("numpy")


def _rows(df, key="feature"):
    return {r[key]: r for r in df.collect()}


def test_missing_reports(spark):
    df = spark.createDataFrame(
        [(1, None, None, "x"), (2, 5.0, None, "x"), (3, 5.0, None, None), (4, 5.0, 1.0, "x")],
        "id int, a double, b double, c string")
    assert {k: r["missing_fraction"] for k, r in _rows(profile.missing_profile(df)).items()} == {
        "id": 0.0, "a": 0.25, "b": 0.75, "c": 0.25}
    assert [r["feature"] for r in profile.missing_top_n(df, 2).collect()] == ["b", "a"]
    assert [r["feature"] for r in profile.missing_above(df).collect()] == ["b"]
    assert {k: r["nulls"] for k, r in _rows(profile.residual_nulls(df, ["a", "b"])).items()} == {"a": 1, "b": 3}


def test_reduction_lists_features_with_gaps_before(spark):
    before = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    after = spark.createDataFrame([(None, 1.0), (2.0, 3.0)], "a double, b double")
    rows = profile.missing_reduction(before, after, ["a", "b"]).collect()
    assert sorted(tuple(r) for r in rows) == [("b", "After (%)", 0.0), ("b", "Before (%)", 50.0)]


def test_correlations_on_edge_columns(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None, 2.0, 1.0), (2.0, 5.0, None, None, 2.0), (3.0, 5.0, 7.0, -1.0, 3.0),
         (4.0, 5.0, None, -2.0, None)],
        "up double, constant double, single double, down double, target double")
    names = ["up", "constant", "single", "down"]
    found = {k: r["correlation"] for k, r in _rows(profile.corr_with_target(df, names)).items()}
    assert found == {"up": pytest.approx(1.0), "constant": 0.0, "single": 0.0, "down": pytest.approx(1.0)}
    matrix = {(r["feature_x"], r["feature_y"]): r["correlation"]
              for r in profile.corr_matrix(df, names).collect()}
    assert len(matrix) == 16
    assert matrix[("up", "down")] == matrix[("down", "up")] == pytest.approx(
        numpy.corrcoef([1, 3, 4], [2, -1, -2])[0, 1])
    assert matrix[("constant", "up")] is None and matrix[("single", "single")] is None


def test_correlation_matrix_is_accurate_far_from_zero(spark):
    draw = random.Random(3)
    data = [(1e9 + draw.random(), 1e9 + draw.random()) for _ in range(2000)]
    df = spark.createDataFrame(data, "x double, y double").repartition(6)
    value = profile.corr_matrix(df, ["x", "y"]).where("feature_x = 'x' and feature_y = 'y'").first()
    assert value["correlation"] == pytest.approx(numpy.corrcoef(*zip(*data))[0, 1], abs=1e-6)


def test_screening_needs_both_conditions(spark):
    rows = [(float(i), None if i % 4 else 1.0 + (i % 8 == 0), None if i % 4 else float(i), float(i % 2))
            for i in range(80)]
    df = spark.createDataFrame(rows, "target double, sparse_flat double, sparse_good double, dense_flat double")
    table = _rows(profile.feature_screen(df, ["sparse_flat", "sparse_good", "dense_flat"], correlation_limit=0.2))
    assert {k: r["dropped"] for k, r in table.items()} == {
        "sparse_flat": True, "sparse_good": False, "dense_flat": False}
    assert profile.screen_features(
        df, ["sparse_flat", "sparse_good"], correlation_limit=0.2) == ["sparse_good"]


def test_describe_matches_numpy(spark):
    draw = random.Random(1)
    values = [draw.gauss(10, 3) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    row = profile.describe(df).first()
    assert row["count"] == 500
    assert row["std"] == pytest.approx(numpy.std(values, ddof=1))
    assert [row[c] for c in ("min", "q25", "q50", "q75", "max")] == [
        pytest.approx(v) for v in numpy.quantile(values, [0, 0.25, 0.5, 0.75, 1])]


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (None, 4.0)], "a double, b double")
    assert [tuple(r) for r in encode.standard_scale(df, ["a", "b"]).collect()] == [
        (-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_target_encoding_formula_and_unseen(spark):
    rows = [("a", 1.0)] * 30 + [("b", 0.0)] * 20 + [("c", 5.0)] + [(None, 2.0)] * 5
    df = spark.createDataFrame(rows, "city string, target double")
    prior = sum(v for _, v in rows) / len(rows)
    fitted = encode.TargetEncode(["city"]).fit(df, "target")
    scored = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), (None,)], "city string")
    got = [r["city"] for r in fitted.transform(scored).collect()]

    def smoothed(n, mean):
        w = 1 / (1 + math.exp(-(n - 20) / 0.2))
        return prior * (1 - w) + mean * w

    assert got == [pytest.approx(v) for v in (smoothed(30, 1.0), smoothed(20, 0.0), smoothed(1, 5.0), prior, prior)]


def test_one_hot_of_unknown_and_missing_is_all_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    fitted = encode.fit_one_hot(train, ["x"])
    assert fitted.names() == ["x_a", "x_b"]
    rows = fitted.transform(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "x string")).collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 1), (0, 0), (0, 0)]


def test_one_hot_of_many_categories(spark):
    df = spark.range(300).selectExpr("cast(id as string) as x")
    fitted = encode.fit_one_hot(df, ["x"])
    assert len(fitted.names()) == 300
    assert {sum(r) for r in fitted.transform(df).collect()} == {1}


def test_assembled_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "n double, t string")
    out = Pipeline(stages=encode.assemble(["n"], ["t"])).fit(df).transform(df)
    assert encode.feature_names(out) == ["n", "t_a", "t_b"]


@pytest.mark.parametrize("partitions", [1, 9])
def test_splits_ignore_partitioning(spark, partitions):
    df = spark.range(2000).repartition(partitions)
    train, test = split.split_holdout(df, "id")
    assert train.count() + test.count() == 2000
    assert {r["id"] for r in test.collect()} == {
        r["id"] for r in split.split_holdout(spark.range(2000), "id")[1].collect()}
    assert 340 < test.count() < 460
    sizes = [p.count() for p in split.split_train_val_test(df, "id")]
    assert sum(sizes) == 2000 and 1100 < sizes[0] < 1300


def test_stratified_split_is_exact_per_class(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 10 < 9, 1, 0) as label")
    train, test = split.split_stratified(df, "id", "label")
    assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {0: 100, 1: 900}
    assert train.count() == 4000 and "is_test" not in train.columns


def test_stratified_split_of_a_tiny_class(spark):
    df = spark.createDataFrame([(i, 0) for i in range(10)] + [(99, 1)], "id long, label int")
    _, test = split.split_stratified(df, "id", "label")
    assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {0: 2}


def test_stratified_split_of_ten_thousand_classes(spark):
    """Class c has c % 7 + 1 rows; one class more holds half of all."""
    df = spark.range(10_000).selectExpr("id as label", "explode(sequence(0, cast(id % 7 as int))) as k").unionByName(
        spark.range(40_000).selectExpr("cast(-1 as bigint) as label", "cast(id as int) as k"))
    df = df.withColumn("id", F.concat_ws("-", "label", "k"))
    _, test = split.split_stratified(df, "id", "label", fraction=0.4)
    sizes = {r["label"]: r["count"] for r in test.groupBy("label").count().collect()}
    expected = {c: int(0.4 * (c % 7 + 1) + 0.5) for c in range(10_000)}
    assert sizes == {c: n for c, n in expected.items() if n} | {-1: 16_000}
    lowest = df.where("label = -1").select("id").collect()
    order = sorted((md5(f"{r.id}#42".encode()).hexdigest()[:10], r.id) for r in lowest)[:16_000]
    assert {r.id for r in test.where("label = -1").collect()} == {i for _, i in order}


def test_batches_have_equal_size(spark):
    df = spark.range(250).repartition(6)
    sizes = {r["batch_id"]: r["count"] for r in split.assign_batches(df, "id").groupBy("batch_id").count().collect()}
    assert sizes == {0: 100, 1: 100, 2: 50}


@pytest.mark.parametrize("partitions", [1, 5])
def test_ordered_encoding_does_not_see_its_own_target(spark, partitions):
    """A hot category, a rare one, a missing one; rows without a target are encoded like new ones."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), None if i % 50 == 7 else float(i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, c string, y double").repartition(partitions)
    encoded, encoding = encode.OrderedTargetEncode(["c"], prior_weight=2.0).fit_transform(df, "id", "y")
    found = {r.id: r.c for r in encoded.collect()}
    known = [r for r in rows if r[2] is not None]
    prior = sum(y for _, _, y in known) / len(known)
    order = sorted(known, key=lambda r: (int(md5(f"{r[0]}#42".encode()).hexdigest()[:8], 16), r[0]))
    sums = {}
    for i, c, y in order:
        total, n = sums.get(c, (0.0, 0))
        assert found[i] == pytest.approx((total + 2 * prior) / (n + 2) if c is not None else prior)
        sums[c] = (total + y, n + 1)
    new = spark.createDataFrame([(1, "hot"), (2, "unseen"), (3, None)], "id long, c string")
    values = {r.id: r.c for r in encoding.transform(new).collect()}
    whole = (sums["hot"][0] + 2 * prior) / (sums["hot"][1] + 2)
    assert values == pytest.approx({1: whole, 2: prior, 3: prior})
    assert all(found[i] == pytest.approx(whole) for i, c, y in rows if y is None and c == "hot")
