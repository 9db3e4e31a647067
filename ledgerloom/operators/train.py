"""Tree ensembles for income and repayment, trained by MLlib.

All fits take a frame that already has a vector column, return an MLlib model,
and work on histograms added up across executors. ``params`` use the names of
``fixed_values.BOOSTED_TREES`` and override its defaults.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.plans.shared import set_checkpoint_folder


def _gbt_settings(params: Mapping | None, defaults: Mapping) -> dict:
    chosen = {**defaults, **(params or {})}
    settings = {
        "maxIter": chosen["trees"], "maxDepth": chosen["depth"],
        "stepSize": chosen["learning_rate"], "seed": chosen.get("seed", fv.SPLIT_SEED),
        # Residuals build on each other: cut the growing lineage in the shared folder.
        "checkpointInterval": 10,
        "maxMemoryInMB": 512,
    }
    optional = {"subsample": "subsamplingRate", "min_child": "minInstancesPerNode",
                "min_gain": "minInfoGain", "feature_share": "featureSubsetStrategy"}
    for ours, theirs in optional.items():
        if ours in chosen:
            settings[theirs] = str(chosen[ours]) if ours == "feature_share" else chosen[ours]
    return settings


def fit_side_by_side(fits: Mapping[str, Callable[[], Model]]) -> dict[str, Model]:
    """Independent fits from driver threads: the many short jobs of one fill the gaps between those of another."""
    with ThreadPool(max(1, len(fits))) as pool:
        return dict(zip(fits, pool.map(lambda fit: fit(), fits.values()), strict=True))


def fit_boosted_regressor(
    train: DataFrame, label: str, params: Mapping | None = None, features: str = "features",
    validation: DataFrame | None = None,
) -> Model:
    """Boosted trees on squared error; with ``validation``, stops when it no longer improves."""
    set_checkpoint_folder(train.sparkSession)
    settings = _gbt_settings(params, fv.BOOSTED_TREES)
    if validation is None:
        return GBTRegressor(featuresCol=features, labelCol=label, **settings).fit(train)
    marked = train.withColumn("_validation", F.lit(False)).unionByName(
        validation.withColumn("_validation", F.lit(True)))
    return GBTRegressor(
        featuresCol=features, labelCol=label, validationIndicatorCol="_validation",
        validationTol=0.0, **settings).fit(marked)


def fit_boosted_classifier(
    train: DataFrame, label: str, params: Mapping | None = None, features: str = "features"
) -> Model:
    """Boosted trees on logistic loss, for a 0/1 label."""
    set_checkpoint_folder(train.sparkSession)
    settings = _gbt_settings(params, fv.RIGOROUS_TREES)
    typed = train.withColumn(label, F.col(label).cast("double"))
    return GBTClassifier(featuresCol=features, labelCol=label, **settings).fit(typed)


def fit_forest_regressor(
    train: DataFrame, label: str, params: Mapping | None = None, features: str = "features"
) -> Model:
    """Averaged trees."""
    set_checkpoint_folder(train.sparkSession)
    chosen = {**fv.FOREST, **(params or {})}
    return RandomForestRegressor(
        featuresCol=features, labelCol=label, numTrees=chosen["trees"], maxDepth=chosen["depth"],
        minInstancesPerNode=chosen.get("min_child", 1),
        featureSubsetStrategy=str(chosen.get("feature_share", "auto")),
        seed=chosen.get("seed", fv.SPLIT_SEED), maxMemoryInMB=512).fit(train)


@dataclass(frozen=True)
class Voting:
    """Weighted mean of member predictions on the scale the members were trained on."""

    members: dict[str, Model]
    weights: dict[str, float]

    def member_columns(self) -> list[str]:
        return [f"prediction_{name}" for name in self.members]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for name, model in self.members.items():
            out = model.copy({model.predictionCol: f"prediction_{name}"}).transform(out)
        return out.withColumn("prediction", vote(self.weights))


def vote(weights: Mapping[str, float]) -> Column:
    """The weighted mean over ``prediction_<name>`` columns."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(f"prediction_{name}") * F.lit(float(weight))
    return total / F.lit(float(sum(weights.values())))


def fit_voting(members: Mapping[str, Model], weights: Mapping[str, float] = fv.VOTING_WEIGHTS) -> Voting:
    """Combine fitted models; they are not fitted again."""
    return Voting(dict(members), {name: weights[name] for name in members})


def fit_two_targets(
    train: DataFrame, label: str, income: str, params: Mapping | None = None,
    features: str = "features",
) -> tuple[Model, Model]:
    """A repayment classifier and an income regressor over one prepared frame."""
    chosen = {**fv.BOOSTED_TREES, "feature_share": fv.BOOSTED_FEATURE_SHARE, **(params or {})}
    set_checkpoint_folder(train.sparkSession)
    fitted = fit_side_by_side({
        "class": lambda: fit_boosted_classifier(train, label, chosen, features),
        "income": lambda: fit_boosted_regressor(train, income, chosen, features),
    })
    return fitted["class"], fitted["income"]


def probability_of_one(df: DataFrame, name: str = "probability_of_one") -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1])
