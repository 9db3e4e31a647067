"""Scaling, category encodings and the assembled feature matrix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.scalars import hash_number
from ledgerloom.functions.text import as_double, literal, named, quoted
from ledgerloom.plans.cells import collected
from ledgerloom.plans.numbering import running_within
from ledgerloom.plans.shared import Stored, materialize


@dataclass(frozen=True)
class Scaling:
    """Mean and population standard deviation per column."""

    moments: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(c: str) -> str:
            if c not in self.moments:
                return quoted(c)
            mean, spread = self.moments[c]
            return named(f"({as_double(c)} - {literal(mean)}) / {literal(spread or 1.0)}", c)

        return df.selectExpr(*[scaled(c) for c in df.columns])


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> Scaling:
    rows = collected(df, columns, {"mean": "avg(value)", "spread": "stddev_pop(value)"})
    return Scaling({c: (rows[c]["mean"] or 0.0, rows[c]["spread"] or 0.0) for c in columns if c in rows})


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fit_scaling(df, columns).transform(df)


@dataclass(frozen=True)
class TargetEncoding:
    """Encoded value of every category seen in training, in a stored table (feature,
    category, n, encoded), and the overall mean."""

    columns: list[str]
    table: DataFrame
    prior: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the columns by numbers; unseen and missing categories get the prior.

        One join per column with its stored codes, which Spark broadcasts only below its
        size threshold and otherwise shuffles, splitting hot categories.
        """
        out = df
        for c in self.columns:
            codes = self.table.where(F.col("feature") == c).select(
                F.col("category").alias("_category"), F.col("encoded").alias(f"_encoded_{c}"))
            out = out.join(codes, F.col(f"`{c}`").cast("string") == F.col("_category"), "left")
            out = out.drop("_category")
        return out.selectExpr(*[
            named(f"coalesce({quoted(f'_encoded_{c}')}, {literal(self.prior)})", c)
            if c in self.columns else quoted(c)
            for c in df.columns
        ])


class TargetEncode:
    """Smoothed category means: w = 1 / (1 + exp(-(n - min_samples) / smoothing))."""

    def __init__(self, columns: Sequence[str] = tuple(fv.TARGET_ENCODED),
                 min_samples: int = fv.TARGET_MIN_SAMPLES, smoothing: float = fv.TARGET_SMOOTHING):
        self.columns = list(columns)
        self.min_samples = min_samples
        self.smoothing = smoothing

    def encoded_table(self, df: DataFrame, target: str) -> tuple[DataFrame, float]:
        """(feature, category, n, encoded), lazily, and the prior."""
        known = df.where(F.col(target).isNotNull())
        prior = known.agg(F.avg(target).alias("prior")).first()["prior"]
        if prior is None:
            raise ValueError(f"no value present in {target}")
        long = known.select(
            F.col(target).cast("double").alias("_target"),
            *[F.col(f"`{c}`").cast("string").alias(c) for c in self.columns],
        ).unpivot("_target", self.columns, "feature", "category").where("category is not null")
        means = long.groupBy("feature", "category").agg(
            F.count("*").alias("n"), F.avg("_target").alias("mean"))
        weight = F.lit(1.0) / (
            F.lit(1.0) + F.exp(-(F.col("n") - F.lit(self.min_samples)) / F.lit(float(self.smoothing))))
        encoded = F.lit(prior) * (F.lit(1.0) - weight) + F.col("mean") * weight
        return means.select("feature", "category", "n", encoded.alias("encoded")), prior

    def fit(self, df: DataFrame, target: str) -> TargetEncoding:
        table, prior = self.encoded_table(df, target)
        return TargetEncoding(self.columns, materialize(table, "target-encoding"), prior)


class OrderedTargetEncode:
    """Category means over the rows before a row, in the order of a hash of its key.

    A row's own target never enters its value, so the encoding does not leak it. Running sums
    are taken over range partitions, so a category may hold any part of the rows. New rows take
    the sums of all training rows.
    """

    def __init__(self, columns: Sequence[str] = tuple(fv.TARGET_ENCODED), prior_weight: float = 1.0,
                 seed: int = fv.SPLIT_SEED):
        self.columns = list(columns)
        self.prior_weight = prior_weight
        self.seed = seed

    def _smoothed(self, total, n, prior: float):
        weight = F.lit(float(self.prior_weight))
        return (F.coalesce(total, F.lit(0.0)) + weight * F.lit(prior)) / (F.coalesce(n, F.lit(0)) + weight)

    def fit_transform(self, df: DataFrame, key: str, target: str) -> tuple[DataFrame, TargetEncoding]:
        """The rows with their columns replaced, and the encoding for rows to come.

        ``key`` must be unique. Missing categories get the prior, the mean of all targets; rows without a target are
        encoded like new ones.
        """
        known = df.where(F.col(target).isNotNull())
        prior = known.agg(F.avg(F.col(target).cast("double")).alias("prior")).first()["prior"]
        if prior is None:
            raise ValueError(f"no value present in {target}")
        cells = known.select(
            F.col(f"`{key}`").alias("_key"), F.col(target).cast("double").alias("_target"),
            hash_number(F.col(f"`{key}`"), self.seed, digits=8).alias("_order"),
            *[F.col(f"`{c}`").cast("string").alias(c) for c in self.columns],
        ).unpivot(["_key", "_target", "_order"], self.columns, "feature", "category").where("category is not null")
        placed, ranged = running_within(cells, ["feature", "category"], ["_order", "_key"], {"_upto": "_target"}, "_nth")
        before = placed.select("_key", "feature", self._smoothed(
            F.col("_upto") - F.col("_target"), F.col("_nth"), prior).alias("value"))
        wide = Stored(before.groupBy("_key").agg(*[
            F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"_encoded_{i}") for i, c in enumerate(self.columns)]), "ordered")
        ranged.drop()
        table = materialize(cells.groupBy("feature", "category").agg(F.count("*").alias("n"), F.sum("_target").alias("_sum")).select(
            "feature", "category", "n", self._smoothed(F.col("_sum"), F.col("n"), prior).alias("encoded")), "target-encoding")
        encoding = TargetEncoding(self.columns, table, prior)
        joined = known.join(wide.frame, F.col(f"`{key}`") == F.col("_key"), "left")
        own = joined.selectExpr(*[
            named(f"coalesce(_encoded_{self.columns.index(c)}, {literal(prior)})", c) if c in self.columns else quoted(c)
            for c in df.columns])
        return own.unionByName(encoding.transform(df.where(F.col(target).isNull()))), encoding


def one_hot_stages(columns: Sequence[str]) -> list:
    """Index and expand each column; unknown and missing values become all zeros."""
    if not columns:
        return []
    return [
        StringIndexer(
            inputCols=list(columns), outputCols=[f"{c}__index" for c in columns],
            stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(
            inputCols=[f"{c}__index" for c in columns],
            outputCols=[f"{c}__onehot" for c in columns],
            # The indexer's extra index for unknown values is the last one.
            dropLast=True),
    ]


@dataclass(frozen=True)
class OneHot:
    """Fitted categories of some columns."""

    columns: list[str]
    model: PipelineModel

    @property
    def categories(self) -> dict[str, list[str]]:
        return dict(zip(self.columns, [list(x) for x in self.model.stages[0].labelsArray]))

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, values in self.categories.items() for v in values]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each column by one 0/1 column per category."""
        arrays = self.model.transform(df).withColumns(
            {f"{c}__onehot": vector_to_array(F.col(f"{c}__onehot")) for c in self.columns})
        kept = [quoted(c) for c in df.columns if c not in self.columns]
        slots = [
            named(f"cast({quoted(f'{c}__onehot')}[{i}] as int)", f"{c}_{v}")
            for c, values in self.categories.items() for i, v in enumerate(values)
        ]
        return arrays.selectExpr(*kept, *slots)


def fit_one_hot(df: DataFrame, columns: Sequence[str]) -> OneHot:
    return OneHot(list(columns), Pipeline(stages=one_hot_stages(columns)).fit(df))


def assemble(numeric: Sequence[str], categorical: Sequence[str], output: str = "features") -> list:
    """Stages that turn numeric and categorical columns into one vector."""
    return [
        *one_hot_stages(categorical),
        VectorAssembler(
            inputCols=[*numeric, *[f"{c}__onehot" for c in categorical]], outputCol=output,
            handleInvalid="error"),
    ]


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of the vector's slots, from its ML attributes."""
    attributes = df.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a for group in attributes.values() for a in group), key=lambda a: a["idx"])
    return [a["name"].replace("__onehot_", "_") for a in slots]
