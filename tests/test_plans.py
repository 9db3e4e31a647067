"""Order statistics, numbering and shared storage on awkward distributions."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import shared
from ledgerloom.plans.cells import by_column
from ledgerloom.plans.numbering import number_rows, running_totals
from ledgerloom.plans.order_stats import exact_modes, exact_quantiles

numpy = pytest.importorskip("numpy")


def _frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")


def _distributions():
    draw = random.Random(5)
    smooth = [draw.gauss(0, 1) for _ in range(4000)]
    heavy = [7.0] * 1500 + [draw.uniform(0, 20) for _ in range(3000)]
    tailed = [10 ** draw.uniform(-8, 12) for _ in range(3500)]
    two = [1.0] * 2000 + [2.0] * 2000
    return {"smooth": smooth, "a third on one value": heavy, "long tail": tailed, "two values": two}


@pytest.mark.parametrize("name", list(_distributions()))
@pytest.mark.parametrize("candidate_rows", [50, 1_000_000])
def test_quantiles_equal_numpy(spark, name, candidate_rows):
    values = _distributions()[name]
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = exact_quantiles(_frame(spark, values), {"x": shares}, candidate_rows)
    for share in shares:
        assert found[("x", share)] == pytest.approx(float(numpy.quantile(values, share)), rel=1e-9)


def test_quantiles_of_many_columns_and_empty_ones(spark):
    df = spark.range(3000).selectExpr(
        "cast(id as double) as a", "cast(null as double) as b", "if(id % 3 = 0, id * 2D, null) as c")
    found = exact_quantiles(df, {"a": [0.5], "b": [0.5], "c": [0.5, 0.25]}, candidate_rows=100)
    assert found == {("a", 0.5): 1499.5, ("b", 0.5): None, ("c", 0.5): 2997.0, ("c", 0.25): 1498.5}


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame(
        [("b", None), ("a", None), ("a", None), ("b", None), ("c", None), (None, None)],
        "x string, y string")
    assert exact_modes(df, ["x", "y"]) == {"x": "a", "y": None}


def test_by_column_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 4.0)], "a double, b double")
    rows = {r["feature"]: (r["n"], r["m"]) for r in by_column(
        df, ["a", "b"], {"n": "count(value)", "m": "avg(value)"}).collect()}
    assert rows == {"a": (2, 2.0), "b": (1, 4.0)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_row_numbers_do_not_depend_on_partitioning(spark, partitions):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(partitions)
    rows = number_rows(df, ["k"], "n").collect()
    assert sorted((r["k"], r["n"]) for r in rows) == [(i, i + 1) for i in range(1000)]


def test_running_totals(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(5)
    rows = running_totals(df, ["k"], {"total": F.col("k")}).collect()
    assert {r["k"]: r["total"] for r in rows} == {i: i * (i + 1) // 2 for i in range(500)}
    assert set(rows[0].asDict()) == {"k", "total"}


def test_shared_folder_comes_from_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared.shared_dir(spark) == named
    stored = shared.materialize(spark.range(5), "five")
    assert stored.count() == 5
    assert stored.inputFiles()[0].removeprefix("file:").lstrip("/").startswith(f"{named}/five-".lstrip("/"))


class _Session:
    """A session without the setting."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(_Session("yarn"))
    assert shared.shared_dir(_Session("local[2]")) == shared.shared_dir(_Session("local[2]"))
