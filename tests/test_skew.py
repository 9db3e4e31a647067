"""Plans that must hold when one key has a third of all rows."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog.applicants import _slots, applicants
from ledgerloom.operators import encode, features

SF_DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_orders_are_limited_before_the_shuffle(spark):
    assert _plan(_slots(spark, SF_DIR)).count("WindowGroupLimit") == 2


def test_unused_slots_are_not_read(spark):
    plan = _plan(applicants(spark, SF_DIR).select("unique_id", "loan_amt_1"))
    assert "lineitem" not in plan and "o_totalprice" in plan
    assert "orders" not in _plan(applicants(spark, SF_DIR).select("unique_id", "age"))


def test_hot_customer_fills_its_slots_once(spark, tmp_path):
    """One customer owns a third of the orders."""
    for name in ("customer", "nation", "region", "lineitem"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    hot = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(F.col("o_custkey")))
    hot.write.parquet(f"{tmp_path}/orders.parquet")
    row = applicants(spark, str(tmp_path)).where("unique_id = 7").select(
        "loan_amt_1", "loan_amt_9", "credit_limit_13").collect()
    latest = [r["o_totalprice"] for r in hot.where("o_custkey = 7").orderBy(
        F.desc("o_orderdate"), F.desc("o_orderkey")).limit(9).collect()]
    assert len(row) == 1 and (row[0]["loan_amt_1"], row[0]["loan_amt_9"]) == (latest[0], latest[8])


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_lookups_work_above_the_broadcast_size(spark, threshold):
    """The same result when the table of values is too large to broadcast."""
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) as pin",
                                      "cast(id % 7 as double) as target")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        counted = features.frequency(df, "pin", "n")
        joined = "BroadcastHashJoin" in _plan(counted)
        assert joined == (threshold == "10MB")
        assert counted.where("pin = 'hot'").select("n").distinct().collect()[0]["n"] == 1000
        assert counted.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_encoding_is_a_join_at_any_size(spark, threshold):
    df = spark.range(3000).selectExpr(
        "id", "if(id % 3 = 0, 'hot', concat('p', id % 50)) as pin", "cast(id % 7 as double) as target")
    fitted = encode.TargetEncode(["pin"]).fit(df, "target")
    codes = {r["category"]: r["encoded"] for r in fitted.table.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        encoded = fitted.transform(df)
        assert ("BroadcastHashJoin" in _plan(encoded)) == (threshold == "10MB")
        expected = {r["id"]: codes[r["pin"]] for r in df.collect()}
        assert {r["id"]: r["pin"] for r in encoded.collect()} == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
