"""The applicant table derived from the star-schema tables.

One row per customer. The customer's latest orders fill numbered slots, so gaps
grow with the slot number as they do in bureau data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.applicants import participant_mapping

SLOTS = 13
# family column prefix -> (per-order value, numbers used)
SLOT_FAMILIES = {
    "loan_amt_": ("o_totalprice", range(1, 10)),
    "balance_": ("bal", range(1, 13)),
    "credit_limit_": ("lim", range(1, 14)),
    "total_emi_": ("emi", range(1, 8)),
    "repayment_": ("rep", range(1, 11)),
    "total_inquiries_": ("inq", range(1, 3)),
    "total_inquires_": ("inq", range(3, 7)),
    "total_loans_": ("lns", range(1, 6)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order sums. Amounts have four decimals at most, so they add up exactly as
    whole ten-thousandths, in any order."""
    exact = "sum(cast(rint(({}) * 10000) as bigint)) / 10000D as {}"
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*map(F.expr, [
        exact.format("l_extendedprice * (1 - l_discount)", "bal"),
        exact.format("l_extendedprice * (1 + l_tax)", "lim"),
        "cast(count(*) * 100 as double) as emi",
        exact.format("l_quantity", "rep"),
        "cast(count_if(l_returnflag = 'R') as double) as inq",
        "cast(count_if(l_linestatus = 'O') as double) as lns",
    ]))


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest orders of each customer with their slot number ``k``.

    The rank limit runs before the shuffle as well, so a customer with very many
    orders sends at most 13 rows per input partition.
    """
    latest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    ranked = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(latest))
    kept = ranked.where(F.col("k") <= SLOTS)
    values = _order_values(spark, sf_dir)
    return kept.join(values, kept.o_orderkey == values.l_orderkey, "left")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    def at(k: int, value: str) -> str:
        return f"max(case when k = {k} then {value} end)"

    columns = [
        f"{at(k, value)} as {prefix}{k}"
        for prefix, (value, numbers) in SLOT_FAMILIES.items() for k in numbers
    ]
    columns += [
        f"{at(10, 'o_totalprice')} as loan_amt_large_tenure",
        f"{at(1, 'if(o_orderstatus = \'O\', lim, null)')} as active_credit_limit_1",
        "max(o_orderdate) as latest_order",
    ]
    latest = _slots(spark, sf_dir).groupBy("o_custkey").agg(*[F.expr(c) for c in columns])
    every = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("primary_loan_amt"),
        F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("closed"))
    return latest.join(every, "o_custkey")


# Columns outside the slots: value, and which ids (modulo, remainder) have none.
_OTHER_COLUMNS = {
    "business_balance": ("round(c_acctbal * 3, 2)", 6, 0),
    "active_credit_limit_1": ("active_credit_limit_1", None, 0),
    "credit_limit_recent_1": ("credit_limit_1", None, 0),
    "loan_amt_large_tenure": ("loan_amt_large_tenure", None, 0),
    "primary_loan_amt": ("primary_loan_amt", None, 0),
    "loan_amt_recent": ("loan_amt_1", None, 0),
    "total_inquiries_recent": ("total_inquiries_1", None, 0),
    "total_loan_recent": ("total_loans_1", None, 0),
    "total_loans_2_dup1": ("total_loans_2", 10, 0),
    "credit_score": ("cast(c_custkey * 37 % 601 + 300 as double)", 7, 0),
    "closed_loan": ("closed", 8, 0),
    "closed_total_loans": ("closed", None, 0),
    "score_comments": ("if(c_custkey % 3 = 0, 'Low Risk', 'Not Scored')", 10, 0),
    "score_type": ("'PERFORM CONSUMER 2.0'", 6, 1),
    "gender": ("if(c_custkey % 2 = 0, 'MALE', 'FEMALE')", 13, 0),
    "marital_status": ("if(c_custkey % 5 < 3, 'MARRIED', 'SINGLE')", 17, 0),
    "city": ("n_name", 9, 0),
    "state": ("r_name", 14, 0),
    "residence_ownership": ("c_mktsegment", 5, 0),
    "target": ("round((c_acctbal + 1000) * 10, 2)", 97, 0),
    "device_model": (
        "elt(cast(c_custkey % 3 + 1 as int), 'iPhone 12', 'samsung A5', 'Moto G')", 4, 0),
    "device_category": ("if(c_custkey % 3 < 2, 'SMART PHONE', 'FEATURE PHONE')", 4, 1),
    "platform": ("if(c_custkey % 3 = 0, 'IOS', 'Android')", 4, 2),
    "device_manufacturer": (
        "elt(cast(c_custkey % 3 + 1 as int), 'Apple', 'Samsung', 'Motorola')", 4, 3),
    "last_updated": ("latest_order", 15, 0),
    "transaction_date": ("latest_order", 12, 0),
}


def _except(value: str, divisor: int | None, remainder: int) -> str:
    return value if divisor is None else f"if(c_custkey % {divisor} <> {remainder}, {value}, null)"


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applicant table under descriptive names (lazy; unused slots are pruned)."""
    customer, wide = table(spark, sf_dir, "customer"), _wide(spark, sf_dir)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = (
        customer.join(wide, customer.c_custkey == wide.o_custkey, "left")
        .join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(region, nation.n_regionkey == region.r_regionkey, "left")
    )
    slots = [f"{prefix}{k}" for prefix, (_, numbers) in SLOT_FAMILIES.items() for k in numbers]
    return joined.selectExpr(
        "c_custkey as unique_id",
        "cast(c_nationkey as string) as `pin code`",
        f"{_except('cast(c_custkey % 60 + 18 as double)', 11, 0)} as age",
        *slots,
        *[f"{_except(*rule)} as {name}" for name, rule in _OTHER_COLUMNS.items()],
    )


def raw_names() -> dict[str, str]:
    """raw name -> column of ``applicants`` (the repeated description apart)."""
    names, seen = {}, set()
    for raw, description in participant_mapping().items():
        names[raw] = f"{description}_dup1" if description in seen else description
        seen.add(description)
    return names


def raw_applicants(spark: SparkSession, sf_dir: str, dates: bool = False) -> DataFrame:
    """The same rows as they arrive: 89 columns under raw names."""
    extra = ["last_updated", "transaction_date"] if dates else []
    return applicants(spark, sf_dir).selectExpr(
        *[f"`{name}` as {raw}" for raw, name in raw_names().items()], *extra)


# ---- the same table as SQL text for the check engine -------------------------

def _slot_sql() -> str:
    return ",\n".join(
        f"round(max(case when k = {k} then {value} end), 4) as {prefix}{k}"
        for prefix, (value, numbers) in SLOT_FAMILIES.items() for k in numbers)


def applicants_sql() -> str:
    """WITH clauses that define ``app`` (descriptive names) and ``raw`` (raw names)."""
    slots = ", ".join(f"{p}{k}" for p, (_, ks) in SLOT_FAMILIES.items() for k in ks)
    raw = ", ".join(f'"{name}" as {raw}' for raw, name in raw_names().items())
    return f"""
with li as (
  select l_orderkey,
    cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double) as bal,
    cast(sum(cast(l_extendedprice * (1 + l_tax) as decimal(18,4))) as double) as lim,
    cast(100 * count(*) as double) as emi,
    cast(sum(cast(l_quantity as decimal(18,4))) as double) as rep,
    cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as double) as inq,
    cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as double) as lns
  from lineitem group by l_orderkey),
ranked as (
  select orders.*, li.*, row_number() over (
    partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k
  from orders left join li on o_orderkey = l_orderkey),
wide as (
  select o_custkey, {_slot_sql()},
    round(max(case when k = 10 then o_totalprice end), 4) as loan_amt_large_tenure,
    round(max(case when k = 1 and o_orderstatus = 'O' then lim end), 4) as active_credit_limit_1,
    max(o_orderdate) as latest_order
  from ranked where k <= {SLOTS} group by o_custkey),
every as (
  select o_custkey as every_custkey, round(max(o_totalprice), 4) as primary_loan_amt,
    cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as double) as closed
  from orders group by o_custkey),
app as (
  select c_custkey as unique_id, cast(c_nationkey as varchar) as "pin code",
    case when c_custkey % 11 <> 0 then cast(c_custkey % 60 + 18 as double) end as age,
    {slots},
    case when c_custkey % 6 <> 0 then round(c_acctbal * 3, 2) end as business_balance,
    active_credit_limit_1, credit_limit_1 as credit_limit_recent_1,
    loan_amt_large_tenure, primary_loan_amt, loan_amt_1 as loan_amt_recent,
    total_inquiries_1 as total_inquiries_recent, total_loans_1 as total_loan_recent,
    case when c_custkey % 10 <> 0 then total_loans_2 end as total_loans_2_dup1,
    case when c_custkey % 7 <> 0 then cast(c_custkey * 37 % 601 + 300 as double) end as credit_score,
    case when c_custkey % 8 <> 0 then closed end as closed_loan,
    closed as closed_total_loans,
    case when c_custkey % 10 <> 0 then
      case when c_custkey % 3 = 0 then 'Low Risk' else 'Not Scored' end end as score_comments,
    case when c_custkey % 6 <> 1 then 'PERFORM CONSUMER 2.0' end as score_type,
    case when c_custkey % 13 <> 0 then
      case when c_custkey % 2 = 0 then 'MALE' else 'FEMALE' end end as gender,
    case when c_custkey % 17 <> 0 then
      case when c_custkey % 5 < 3 then 'MARRIED' else 'SINGLE' end end as marital_status,
    case when c_custkey % 9 <> 0 then n_name end as city,
    case when c_custkey % 14 <> 0 then r_name end as state,
    case when c_custkey % 5 <> 0 then c_mktsegment end as residence_ownership,
    case when c_custkey % 97 <> 0 then round((c_acctbal + 1000) * 10, 2) end as target,
    case when c_custkey % 4 <> 0 then
      case c_custkey % 3 when 0 then 'iPhone 12' when 1 then 'samsung A5' else 'Moto G' end
      end as device_model,
    case when c_custkey % 4 <> 1 then
      case when c_custkey % 3 < 2 then 'SMART PHONE' else 'FEATURE PHONE' end end as device_category,
    case when c_custkey % 4 <> 2 then
      case when c_custkey % 3 = 0 then 'IOS' else 'Android' end end as platform,
    case when c_custkey % 4 <> 3 then
      case c_custkey % 3 when 0 then 'Apple' when 1 then 'Samsung' else 'Motorola' end
      end as device_manufacturer,
    case when c_custkey % 15 <> 0 then latest_order end as last_updated,
    case when c_custkey % 12 <> 0 then latest_order end as transaction_date
  from customer
    left join wide on c_custkey = o_custkey
    left join every on c_custkey = every_custkey
    left join nation on c_nationkey = n_nationkey
    left join region on n_regionkey = r_regionkey),
raw as (select {raw}, last_updated, transaction_date from app)
"""
