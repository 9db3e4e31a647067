"""Column names, types and layout."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.fixed_values import IDENTIFIER_COLUMNS
from ledgerloom.functions.text import as_double, named, quoted


def rename_by_mapping(df: DataFrame, mapping: Mapping[str, str], reverse: bool = False) -> DataFrame:
    """Rename columns; names outside the mapping pass through.

    Two raw names may share a description: forward renaming then yields
    duplicates (see ``dedupe_column_names``), reverse renaming uses the last one.
    """
    names = {v: k for k, v in mapping.items()} if reverse else mapping
    return df.toDF(*[names.get(c, c) for c in df.columns])


def dedupe_column_names(df: DataFrame) -> DataFrame:
    """Every name once: the first ``x`` stays, the next are ``x_dup1``, ``x_dup2``, ...

    A name that the table brings along is never given to another column: with
    ``x, x, x_dup1`` the second ``x`` becomes ``x_dup2``.
    """
    own = set(df.columns)

    def new_names(name: str) -> Iterator[str]:
        yield name
        yield from (made for n in count(1) if (made := f"{name}_dup{n}") not in own)

    names = {name: new_names(name) for name in own}
    return df.toDF(*[next(names[name]) for name in df.columns])


def drop_identifiers(df: DataFrame, columns: Sequence[str] = tuple(IDENTIFIER_COLUMNS)) -> DataFrame:
    return df.drop(*[c for c in columns if c != "target"])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail before any job when a needed column is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")
    return df


def parse_number(name: str) -> str:
    """SQL text: a text column as a double, null where it is not a number.

    Spark also reads Java's type suffixes, as in 1.5d; those are no numbers here.
    """
    text = f"trim(cast({quoted(name)} as string))"
    return f"case when not {text} rlike '[dDfF]$' then try_cast({text} as double) end"


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def numeric_columns(df: DataFrame, excluded: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in excluded]


def text_columns(df: DataFrame, excluded: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in excluded
    ]


def classify_columns(df: DataFrame, rule: str = "dtype") -> dict[str, str]:
    """{column: "numeric" | "categorical"}.

    "dtype" reads the schema. "all_parse" calls a text column numeric when every
    present value parses, "any_parse" when at least one does; both look at all
    text columns in one aggregate.
    """
    kinds = {
        f.name: "numeric" if is_numeric(f.dataType) else "categorical" for f in df.schema.fields
    }
    if rule == "dtype":
        return kinds
    if rule not in ("all_parse", "any_parse"):
        raise ValueError(f"unknown classification rule: {rule}")
    texts = text_columns(df)
    if not texts:
        return kinds
    counts = df.selectExpr(
        *[f"count({quoted(c)}) as present{i}" for i, c in enumerate(texts)],
        *[f"count({parse_number(c)}) as parsed{i}" for i, c in enumerate(texts)],
    ).first()
    for i, c in enumerate(texts):
        present, parsed = counts[f"present{i}"], counts[f"parsed{i}"]
        numeric = parsed == present if rule == "all_parse" else parsed > 0
        kinds[c] = "numeric" if numeric else "categorical"
    return kinds


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; values that do not parse become null."""
    chosen = set(columns)
    return df.selectExpr(*[
        quoted(f.name) if f.name not in chosen
        else named(as_double(f.name) if is_numeric(f.dataType) else parse_number(f.name), f.name)
        for f in df.schema.fields
    ])


def align_to_features(
    df: DataFrame, features: Sequence[tuple[str, str]], fill: str = "zero", keep: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``features`` (name, type), in order, after the ``keep`` columns.

    Absent columns get 0 ("zero"), null ("null"), or 0 / 'Unknown' by type
    ("by_type"); columns outside the list are dropped.
    """
    present = set(df.columns)

    def filler(kind: str) -> str:
        if fill == "null":
            return "null"
        return "'Unknown'" if fill == "by_type" and kind == "string" else "0"

    return df.selectExpr(
        *[quoted(c) for c in keep],
        *[
            named(f"cast({quoted(name) if name in present else filler(kind)} as {kind})", name)
            for name, kind in features
        ],
    )


def copy_columns(df: DataFrame, copies: Mapping[str, str], absent=0) -> DataFrame:
    """New column := existing column, or the constant when there is none."""
    return df.withColumns({
        new: F.col(f"`{old}`") if old in df.columns else F.lit(absent)
        for new, old in copies.items()
    })


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first rows in a stated order (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


def one_row_per_key(table: DataFrame, key: str) -> DataFrame:
    """The smallest row of every key, by the other columns in their order."""
    others = [c for c in table.columns if c != key]
    if not others:
        return table.distinct()
    smallest = table.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_row"))
    return smallest.select(key, "_row.*")
