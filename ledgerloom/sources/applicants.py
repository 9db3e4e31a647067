"""Applicant tables, scoring requests and the column mapping as Spark sources."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerloom.fixed_values import (
    DEFAULT_MAPPING, EXTERNAL_COLUMNS, IMPUTED_DATES, PARTICIPANT_MAPPING_CSV, TEXT_COLUMNS,
)
from ledgerloom.functions.text import named, quoted


def participant_mapping() -> dict[str, str]:
    """The full raw -> descriptive mapping."""
    rows = csv.DictReader(io.StringIO(PARTICIPANT_MAPPING_CSV))
    return {r["column_name"]: r["description"] for r in rows}


def read_mapping(spark: SparkSession, path: str | None = None) -> dict[str, str]:
    """Mapping from a two-column CSV; the short default when the file is absent.

    A mapping is metadata with one row per column, so it lives on the driver.
    """
    if path is None:
        return participant_mapping()
    try:
        rows = spark.read.option("header", True).csv(path).select("column_name", "description")
        return {r["column_name"]: r["description"] for r in rows.toLocalIterator()}
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return dict(DEFAULT_MAPPING)
        raise


def applicant_schema(names: Iterable[str]) -> T.StructType:
    """Types of applicant columns, whether raw or descriptive names are used."""
    descriptions = participant_mapping()
    fields = []
    for name in names:
        meaning = descriptions.get(name, name)
        if meaning == "unique_id":
            kind = T.LongType()
        elif meaning in TEXT_COLUMNS:
            kind = T.StringType()
        elif meaning in IMPUTED_DATES:
            kind = T.TimestampNTZType()
        else:
            kind = T.DoubleType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def null_out_infinities(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN and infinities of floating columns become null, in one projection."""
    chosen = set(df.columns if columns is None else columns)
    floating = (T.DoubleType, T.FloatType)
    return df.selectExpr(*[
        named(f"case when abs({quoted(f.name)}) < double('infinity') then {quoted(f.name)} end", f.name)
        if f.name in chosen and isinstance(f.dataType, floating) else quoted(f.name)
        for f in df.schema.fields
    ])


def read_applicants(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None
) -> DataFrame:
    """The wide applicant table with fixed types; NaN and infinities read as null."""
    if fmt == "parquet":
        df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    elif fmt == "csv":
        if schema is None:
            # Only the header line is read here; types come from the names.
            schema = applicant_schema(spark.read.option("header", True).csv(path).columns)
        # A file whose header is in another order than the schema fails instead of swapping columns.
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    else:
        raise ValueError(f"unsupported applicant format: {fmt}")
    return null_out_infinities(df)


CORRUPT = "_corrupt_record"


def rename_raw(df: DataFrame) -> DataFrame:
    """Raw names become descriptive ones; where a row has both, the descriptive value wins."""
    meaning = _descriptive_names()
    raw = [c for c in df.columns if c in meaning and meaning[c] != c]
    if not raw:
        return df
    kinds = dict(df.dtypes)

    def value(name: str) -> str:
        sources = [quoted(name)] if name in kinds else []
        sources += [f"cast({quoted(c)} as {kinds[name]})" if sources else quoted(c) for c in raw if meaning[c] == name]
        return named(f"coalesce({', '.join(sources)})", name)

    renamed = list(dict.fromkeys(meaning[c] for c in raw))
    others = [c for c in df.columns if c not in raw and c not in renamed]
    return df.selectExpr(*[quoted(c) for c in others], *[value(n) for n in renamed])


def _descriptive_names() -> dict[str, str]:
    """Raw to descriptive; a meaning that comes again gets the name deduplication gives it."""
    names: dict[str, str] = {}
    for raw, meaning in participant_mapping().items():
        names[raw] = f"{meaning}_dup1" if meaning in names.values() else meaning
    return names


def request_schema() -> T.StructType:
    """Every field a scoring request may carry, under descriptive and raw names, and the text of
    a record that is no JSON; absent fields read as null."""
    names = list(dict.fromkeys(participant_mapping().values()))
    # The second column of that meaning, under the name deduplication gives it.
    names.insert(names.index("total_loans_2") + 1, "total_loans_2_dup1")
    totals = ["total_loan_amount", "total_credit_limit", "total_emi", "threshold"]
    overall = [
        "total_credit_limit_overall", "total_balance_overall", "total_emi_overall",
        "total_inquiries_overall", "total_loan_amount_overall",
    ]
    external = ["pin_code_frequency", *EXTERNAL_COLUMNS]
    raw = [r for r, meaning in participant_mapping().items() if r != meaning and r not in names]
    fields = applicant_schema([*names, *totals, *overall, *external, *raw]).fields
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def read_requests(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON scoring records under descriptive names; unknown keys are dropped.

    A line that is no JSON is a row of nulls with its text in ``_corrupt_record``; the request
    checks reject it, with the text.
    """
    return rename_raw(spark.read.schema(schema or request_schema()).json(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a table as Parquet or as CSV with a header line per file."""
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unsupported table format: {fmt}")
