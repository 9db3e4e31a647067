"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.catalog.applicants import applicants_sql

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    build: Build
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def register(name: str, sql: str | None = None, applicants: bool = True) -> Callable[[Build], Build]:
    """Register a query. ``sql`` follows the WITH clauses of the applicant table, so it
    starts with ``select`` or with ``,`` and further clauses."""

    def keep(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        text = sql
        if text is not None and applicants:
            text = applicants_sql() + text
        REGISTRY[name] = Registered(build, text)
        return build

    return keep


# Small SQL text helpers for the twins.

def sql_sum(columns) -> str:
    return "(" + " + ".join(f"coalesce({c}, 0)" for c in columns) + ")"


def sql_count(columns) -> str:
    return "(" + " + ".join(f"case when {c} is null then 0 else 1 end" for c in columns) + ")"


def sql_mean(columns) -> str:
    return f"({sql_sum(columns)} / nullif({sql_count(columns)}, 0))"


def sql_std(columns) -> str:
    return f"list_aggregate([{', '.join(columns)}], 'stddev_samp')"


def sql_ratio(top: str, bottom: str, shift: str = "1e-6") -> str:
    return f"({top} / nullif({bottom} + cast({shift} as double), 0))"


def numbered(prefix: str, numbers) -> list[str]:
    return [f"{prefix}{i}" for i in numbers]


FAMILY_COLUMNS = {
    "credit_limit": [*numbered("credit_limit_", range(1, 14)), "active_credit_limit_1"],
    "balance": numbered("balance_", range(1, 13)),
    "total_emi": numbered("total_emi_", range(1, 8)),
    "inquiries": [*numbered("total_inquiries_", (1, 2)), *numbered("total_inquires_", range(3, 7))],
    "loan_amt": numbered("loan_amt_", range(1, 10)),
    "repayment": numbered("repayment_", range(1, 11)),
}
