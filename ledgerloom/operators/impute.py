"""Filling gaps: ordered rules as data, fitted statistics, lookups and constants.

Every fill touches nulls only. Rules run in list order and a rule sees the
columns already filled by earlier rules, while statistics (mean, median, mode,
quantile) always describe the column's own present values. ``fit`` therefore
gathers all statistics first and ``transform`` is a short chain of projections,
one per dependency level.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import fixed_values as fv
from ledgerloom.functions.text import as_double, literal, named, quoted
from ledgerloom.operators.columns import coerce_numeric, numeric_columns, one_row_per_key, text_columns
from ledgerloom.plans.cells import collected
from ledgerloom.plans.order_stats import exact_modes, exact_quantiles
from ledgerloom.plans.shared import Stored, materialize
from ledgerloom.sources.applicants import participant_mapping

_STATISTIC = re.compile(r"\{(\w+):(\w+)\}")


@dataclass(frozen=True)
class Rule:
    """Fill ``column`` with the SQL text ``fill``.

    ``needs`` names the columns the text reads; when one of them is absent from
    the table, ``otherwise`` is used. ``{mean:x}``, ``{median:x}``, ``{p75:x}``
    and ``{mode:x}`` stand for statistics of column x.
    """

    column: str
    fill: str
    needs: tuple[str, ...] = ()
    otherwise: str = "0"
    numeric: bool = True
    #: Columns of which those present are counted where positive, in place of ``fill``.
    counts: tuple[str, ...] = ()


def _count_positive(columns: Sequence[str]) -> str:
    return " + ".join(f"if(coalesce({c}, 0) > 0, 1, 0)" for c in columns) or "0"


def _named(rules) -> dict[str, Rule]:
    return {column: Rule(column, fill, tuple(needs), otherwise)
            for column, fill, needs, otherwise in rules}


def rules_by_id() -> list[Rule]:
    """The rule set keyed by raw ids, in its fixed order."""
    named = _named(fv.NUMERIC_FILL_RULES)
    zero = {c for ids in fv.ZERO_FILLED_IDS.values() for c in ids}
    rules = []
    for column in fv.IMPUTED_NUMERIC:
        if column in named:
            rules.append(named[column])
        elif column in zero:
            rules.append(Rule(column, "0"))
        elif column in fv.REPAYMENT_IDS:
            rules.append(Rule(column, "var_37", ("var_37",)))
        elif column in fv.LOAN_COUNT_IDS:
            rules.append(Rule(column, "var_53", ("var_53",)))
        elif column == "var_53":
            rules.append(Rule(column, "", counts=tuple(fv.LOAN_AMOUNT_IDS)))
        else:
            rules.append(Rule(column, f"{{median:{column}}}"))
    return rules + text_rules()


def text_rules() -> list[Rule]:
    named = {c: Rule(c, fill, tuple(needs), otherwise, numeric=False)
             for c, fill, needs, otherwise in fv.TEXT_FILL_RULES}
    # City and state come from the pin lookup; without one the mode remains.
    return [
        named.get(c, Rule(c, f"{{mode:{c}}}", numeric=False, otherwise=f"{{mode:{c}}}"))
        for c in fv.IMPUTED_TEXT
    ]


def rules_by_meaning() -> list[Rule]:
    """The same fills attached to descriptive names and whole slot families."""
    meaning = participant_mapping()

    def renamed(text: str) -> str:
        return re.sub(r"\b(var_\d+|target_income)\b", lambda m: meaning[m.group()], text)

    rules = []
    for column, fill, needs, otherwise in fv.NUMERIC_FILL_RULES:
        if column not in ("var_40",):
            rules.append(Rule(renamed(column), renamed(fill),
                              tuple(renamed(n) for n in needs), renamed(otherwise)))
    loans = [f"loan_amt_{i}" for i in range(1, 10)]
    zero = [f"balance_{i}" for i in range(4, 13)]
    zero += [f"credit_limit_{i}" for i in range(3, 14)]
    zero += loans[2:]
    zero += [f"total_emi_{i}" for i in range(2, 8)]
    zero += ["total_inquiries_2"] + [f"total_inquires_{i}" for i in range(3, 7)]
    rules += [Rule(c, "0") for c in zero]
    rules += [Rule(f"repayment_{i}", "repayment_1", ("repayment_1",)) for i in range(2, 11)]
    rules.append(Rule("total_loans_1", "", counts=tuple(loans)))
    rules += [Rule(c, "total_loans_1", ("total_loans_1",)) for c in (
        "total_loans_2", "total_loans_2_dup1", "total_loans_3", "total_loans_4", "total_loans_5")]
    rules += [
        Rule(renamed(c), renamed(f), tuple(renamed(n) for n in needs), o)
        for c, f, needs, o in fv.NUMERIC_FILL_RULES if c == "var_40"
    ]
    rules += [
        Rule(renamed(r.column), renamed(r.fill), tuple(renamed(n) for n in r.needs),
             renamed(r.otherwise), numeric=False)
        for r in text_rules()
    ]
    return rules


@dataclass(frozen=True)
class FittedRules:
    numeric: list[str]
    levels: list[list[tuple[str, str]]]
    statistics: dict[tuple[str, str], object] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        filled = coerce_numeric(df, self.numeric)
        for level in self.levels:
            fills = dict(level)
            filled = filled.selectExpr(*[
                named(f"coalesce({quoted(c)}, cast({fills[c]} as {kind}))", c)
                if c in fills else quoted(c)
                for c, kind in filled.dtypes
            ])
        return filled


class ImputeRules:
    """An ordered list of fill rules."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)

    def fit(self, df: DataFrame) -> FittedRules:
        present = set(df.columns)
        active = []
        for rule in self.rules:
            if rule.column not in present:
                continue
            if rule.counts:
                there = [c for c in rule.counts if c in present]
                active.append((rule, _count_positive(there), there))
            elif set(rule.needs) <= present:
                active.append((rule, rule.fill, list(rule.needs)))
            else:
                active.append((rule, rule.otherwise, []))
        statistics = _statistics(df, {m for _, text, _ in active for m in _STATISTIC.findall(text)})

        def constant(match) -> str:
            value = statistics[match.groups()]
            if match.group(1) == "mode":
                return literal(fv.NO_MODE if value is None else value)
            return literal(value)

        numeric = [r.column for r, _, _ in active if r.numeric]
        numeric += [c for r, _, reads in active for c in reads if c == "target_income"]
        steps = [(r.column, _STATISTIC.sub(constant, text), reads) for r, text, reads in active]
        return FittedRules(list(dict.fromkeys(numeric)), _levels(steps), statistics)


def _levels(steps: Sequence[tuple[str, str, Sequence[str]]]) -> list[list[tuple[str, str]]]:
    """Group ordered fills into projections that give the same result.

    A projection reads the values from before it. So a fill goes after the fills
    of the columns it reads when those come earlier in the list, and not before
    any earlier fill that still has to read its own column unfilled.
    """
    level_of: dict[str, int] = {}
    read_at: dict[str, int] = {}
    for column, _, reads in steps:
        after_sources = [level_of[s] + 1 for s in reads if s in level_of and s != column]
        level = max([0, read_at.get(column, 0), *after_sources])
        level_of[column] = level
        for source in reads:
            read_at[source] = max(read_at.get(source, 0), level)
    grouped: list[list[tuple[str, str]]] = [[] for _ in range(max(level_of.values(), default=-1) + 1)]
    for column, text, _ in steps:
        grouped[level_of[column]].append((column, text))
    return grouped


def _statistics(df: DataFrame, wanted: set[tuple[str, str]]) -> dict[tuple[str, str], object]:
    if not wanted:
        return {}
    numeric = sorted({c for kind, c in wanted if kind != "mode"})
    text = sorted({c for kind, c in wanted if kind == "mode"})
    with Stored(coerce_numeric(df.select(*numeric, *text), numeric), "statistics") as stored:
        return _gathered(stored, wanted, text)


def _gathered(stored: DataFrame, wanted: set[tuple[str, str]], text: Sequence[str]) -> dict:
    found: dict[tuple[str, str], object] = {}
    means = [c for kind, c in sorted(wanted) if kind == "mean"]
    rows = collected(stored, means, {"mean": "avg(value)"})
    found.update({("mean", c): rows[c]["mean"] if c in rows else None for c in means})
    shares = {"median": 0.5, "p25": 0.25, "p75": 0.75}
    by_column: dict[str, list[float]] = {}
    for kind, c in sorted(wanted):
        if kind in shares:
            by_column.setdefault(c, []).append(shares[kind])
    quantiles = exact_quantiles(stored, by_column)
    found.update({(k, c): quantiles[(c, shares[k])] for k, c in wanted if k in shares})
    modes = exact_modes(stored, text)
    found.update({("mode", c): modes[c] for c in text})
    return found


@dataclass(frozen=True)
class FillValues:
    """Fitted constants per column: medians, means or modes."""

    values: dict[str, object]

    def transform(self, df: DataFrame) -> DataFrame:
        return fill_constants(df, self.values)


def fit_medians(df: DataFrame, columns: Sequence[str] | None = None) -> FillValues:
    columns = list(columns or numeric_columns(df))
    with Stored(df.select(*[F.col(f"`{c}`") for c in columns]), "medians") as stored:
        quantiles = exact_quantiles(stored, {c: [0.5] for c in columns})
    return FillValues({c: quantiles[(c, 0.5)] for c in columns})


def fit_means(df: DataFrame, columns: Sequence[str] | None = None) -> FillValues:
    columns = list(columns or numeric_columns(df))
    rows = collected(df, columns, {"mean": "avg(value)"})
    return FillValues({c: rows[c]["mean"] if c in rows else None for c in columns})


def fit_modes(df: DataFrame, columns: Sequence[str] | None = None) -> FillValues:
    columns = list(columns or text_columns(df))
    return FillValues({c: fv.NO_MODE if m is None else m for c, m in exact_modes(df, columns).items()})


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Nulls of each named column become its constant."""
    def filled(name: str) -> str:
        constant = values.get(name)
        if constant is None:
            return quoted(name)
        present = as_double(name) if isinstance(constant, float) else quoted(name)
        return named(f"coalesce({present}, {literal(constant)})", name)

    return df.selectExpr(*[filled(c) for c in df.columns])


def pin_places(df: DataFrame) -> DataFrame:
    """The fixed five-row pin lookup."""
    return df.sparkSession.createDataFrame(fv.PIN_PLACES, "pin string, city string, state string")


def impute_from_lookup(
    df: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str],
    fallback: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Fill gaps from a lookup table, then with the fallback.

    Of several lookup rows with one key, the smallest (by the columns in their order)
    counts, so rows are never doubled. A left join: Spark broadcasts the lookup when it is under its size threshold
    and otherwise shuffles, splitting hot keys adaptively. Without ``fallback``
    the columns' modes are used.
    """
    if fallback is None:
        fallback = {c: fv.NO_MODE if m is None else m for c, m in exact_modes(df, columns).items()}
    names = {c: f"_lookup_{c}" for c in columns}
    right = one_row_per_key(lookup.select(
        F.col(key).cast("string").alias("_lookup_key"),
        *[F.col(c).alias(n) for c, n in names.items()]), "_lookup_key")
    joined = df.join(right, F.col(f"`{key}`").cast("string") == F.col("_lookup_key"), "left")
    return joined.selectExpr(*[
        named(f"coalesce({quoted(c)}, {names[c]}, {literal(fallback[c])})", c)
        if c in names else quoted(c)
        for c in df.columns
    ])


def _moment(kind: T.DataType) -> Column:
    text = fv.IMPUTATION_TIMESTAMP_UTC
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestamp_ntz'{text}'")
    return F.expr(f"timestamp'{text}Z'").cast(kind)


def fill_dates(df: DataFrame, columns: Sequence[str] = tuple(fv.IMPUTED_DATES)) -> DataFrame:
    """Missing dates become the imputation timestamp."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        c: F.coalesce(F.col(c), _moment(kinds[c])) for c in columns if c in kinds})


def stamp_imputation(df: DataFrame) -> DataFrame:
    return df.withColumn("imputation_timestamp", _moment(T.TimestampNTZType()))


def anonymize(df: DataFrame, column: str, name: str | None = None, salt: str = "") -> DataFrame:
    """SHA-256 of the column's text. Pins are few, so pass a secret ``salt`` to publish them."""
    text = F.col(f"`{column}`").cast("string")
    hashed = F.sha2(F.concat(F.lit(salt), text) if salt else text, 256)
    return df.withColumn(name or f"{column}_anonymized", hashed)


def columns_with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Which columns hold a null, from one aggregate (fix this at fit time)."""
    rows = collected(
        df, columns, {"gap": "bool_or(value)"}, cell=lambda c: f"{quoted(c)} is null")
    return [c for c in columns if c in rows and rows[c]["gap"]]


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_is_missing`` 0/1 flags."""
    return df.selectExpr(
        "*", *[named(f"cast({quoted(c)} is null as int)", f"{c}_is_missing") for c in columns])


def impute_applicants(df: DataFrame, rules: Sequence[Rule] | None = None,
                      lookup: DataFrame | None = None) -> DataFrame:
    """The whole imputation of an applicant table with raw column names."""
    df = materialize(df, "to-impute")  # read for the statistics and again for the result
    fitted = ImputeRules(rules_by_id() if rules is None else rules).fit(df)
    places = [c for c in ("city", "state") if c in df.columns]
    if "pin" in df.columns and places:
        # The lookup goes first: the place rules then fill what it left open.
        lookup = pin_places(df) if lookup is None else lookup
        df = impute_from_lookup(df, lookup, "pin", places, fallback={c: None for c in places})
    filled = stamp_imputation(fill_dates(fitted.transform(df)))
    return anonymize(filled, "pin") if "pin" in df.columns else filled
