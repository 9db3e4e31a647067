"""From applicant rows to fitted scorers, saved and loaded as one folder."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.operators import encode, features, impute, score, train, tuning
from ledgerloom.operators.columns import align_to_features, numeric_columns, text_columns
from ledgerloom.sources.applicants import rename_raw
from ledgerloom.operators.evaluate import feature_importance
from ledgerloom.operators.profile import feature_completeness, screen_features
from ledgerloom.operators.split import holdout_flag, split_stratified, three_way
from ledgerloom.operators.validate import drop_sparse_columns
from ledgerloom.plans.shared import Stored, materialize, set_checkpoint_folder


PIN = "pin code"


@dataclass(frozen=True)
class Preparation:
    """Everything fitted on the training rows that turns raw rows into a vector."""

    inputs: list[tuple[str, str]]
    flagged: list[str]
    numeric: list[str]
    categorical: list[str]
    encoding: encode.TargetEncoding
    medians: dict[str, float]
    scaling: encode.Scaling
    stages: PipelineModel
    frequency: features.Frequency | None = None

    def engineered(self, df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
        """Aligned inputs with flags and derived features.

        Raw column names are renamed first. Totals that come with the rows are no inputs of
        their own, but stand in for the sum of a family without any slot.
        """
        named = rename_raw(df)
        if self.frequency is not None:
            named = self.frequency.transform(named)
        aside = features.set_aside_totals(named)
        totals = [c for c in aside.columns if c not in named.columns]
        aligned = align_to_features(aside, self.inputs, fill="null", keep=[key, *keep, *totals])
        return features.engineer_features(impute.missing_indicators(aligned, self.flagged))

    def transform(self, df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
        """Key, kept columns, completeness of the inputs and the feature vector."""
        rows = self.engineered(df, key, keep)
        counted = feature_completeness(rows, [n for n, _ in self.inputs])
        numbers = self.scaling.transform(
            impute.fill_constants(self.encoding.transform(counted), self.medians))
        texts = impute.fill_constants(numbers, {c: "Missing" for c in self.categorical})
        return self.stages.transform(texts).select(
            key, *keep, "available_features", "total_features", "feature_completeness", "features")


def fit_preparation(
    rows: DataFrame, key: str, target: str, drop: Sequence[str] = tuple(fv.ID_LIKE_TEXT_COLUMNS),
    target_encoded: Sequence[str] = tuple(fv.TARGET_ENCODED),
) -> Preparation:
    """Fit on the training rows only: flags, screening, encoding, medians, scaling, categories.

    Text columns named in ``target_encoded`` become one number, the others one vector slot
    per category: name a column with very many categories there. ``rows`` is read twice
    before its features are stored, so it should be stored too.
    """
    excluded = {key, target, *drop}
    frequency = None
    if PIN in rows.columns:
        frequency = features.fit_frequency(rows, PIN, "pin_code_frequency")
        rows = frequency.transform(rows)
    inputs = [(n, t) for n, t in rows.dtypes
              if n not in excluded and (t == "string" or n in numeric_columns(rows))]
    chosen = rows.select(*[F.col(f"`{c}`") for c in (key, target, *[n for n, _ in inputs])])
    flagged = impute.columns_with_gaps(chosen, [n for n, _ in inputs])
    derived = Stored(features.engineer_features(impute.missing_indicators(chosen, flagged)), "engineered")
    engineered = derived.frame
    candidates = numeric_columns(engineered, excluded)
    kept = screen_features(engineered, candidates, target)
    texts = text_columns(engineered, excluded)
    encoded = [c for c in target_encoded if c in texts]
    categorical = [c for c in texts if c not in encoded]
    encoding = encode.TargetEncode(encoded).fit(engineered, target)
    numeric = kept + encoded
    # The columns are looked up by joins: make them once, not in every pass below.
    stored = Stored(encoding.transform(engineered), "encoded")
    numbers = stored.frame
    medians = {
        # A column without any value in training contributes a constant.
        c: 0.0 if m is None else float(m)
        for c, m in impute.fit_medians(numbers, numeric).values.items()
    }
    filled = impute.fill_constants(numbers, medians)
    scaling = encode.fit_scaling(filled, numeric)
    texts_filled = impute.fill_constants(filled, {c: "Missing" for c in categorical})
    stages = Pipeline(stages=encode.assemble(numeric, categorical)).fit(
        scaling.transform(texts_filled))
    stored.drop()
    derived.drop()
    return Preparation(
        inputs, flagged, numeric, categorical, encoding, medians, scaling, stages, frequency)


@dataclass(frozen=True)
class Scorer:
    """A preparation with named models: "income" (a vote or one model) and/or "repayment"."""

    key: str
    preparation: Preparation
    income: train.Voting | None = None
    repayment: Model | None = None
    capability: Model | None = None
    bounds: features.MinMax | None = None
    #: The inputs are those of the single-model trainers, with profile features and log copies.
    profiled: bool = False

    def vectors(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        if self.profiled:
            logged = [c for c in fv.LOG_COLUMNS if c != "income"]
            df = features.log1p_columns(features.add_profile_features(rename_raw(df)), logged)
        return self.preparation.transform(df, self.key, keep)

    def names(self, scored: DataFrame) -> list[str]:
        return encode.feature_names(scored)


def _income_columns(vectors: DataFrame, voting: train.Voting) -> DataFrame:
    voted = voting.transform(vectors)
    incomes = voted.withColumns({
        "income": F.expm1("prediction"),
        **{f"income_{m}": F.expm1(f"prediction_{m}") for m in voting.members},
    })
    return score.income_summary(incomes, "income", [f"income_{m}" for m in voting.members])


INCOME_OUTPUT = [
    "predicted_annual_income", "predicted_monthly_income", "feature_completeness",
    "confidence_score", "available_features", "total_features",
]


def score_income(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Income, monthly income, completeness and confidence for every row."""
    return _income_columns(scorer.vectors(df), scorer.income).select(scorer.key, *INCOME_OUTPUT)


def score_repayment(
    df: DataFrame, scorer: Scorer, threshold: float | str = fv.DEFAULT_THRESHOLD
) -> DataFrame:
    """Class, probability, status and threshold for every row."""
    keep = [threshold] if isinstance(threshold, str) else []
    scored = train.probability_of_one(
        scorer.repayment.transform(scorer.vectors(df, keep)), "probability_good").drop("prediction")
    return score.apply_threshold(scored, "probability_good", threshold).select(
        scorer.key, "prediction", F.col("probability_good").alias("probability"), "status", "threshold")


def score_capability(df: DataFrame, scorer: Scorer, as_income: bool = False) -> DataFrame:
    """The 0-1 capability score or the income behind it, with the constant confidence."""
    scored = scorer.capability.transform(scorer.vectors(df))
    confidence = score.importance_confidence(
        list(scorer.capability.featureImportances.toArray()))
    out = score.capability(scored, "prediction", scorer.bounds, as_income)
    name = "predicted_income" if as_income else "capability_score"
    return out.select(scorer.key, name, F.lit(confidence).alias("confidence_score"))


def score_combined(
    df: DataFrame, income: Scorer, repayment: Scorer, threshold: float | str = fv.DEFAULT_THRESHOLD
) -> DataFrame:
    """Income and repayment of the same rows, each scorer with its own feature vector.

    The key travels through both projections, so the rows need no join.
    """
    wide = df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    keep = ["_row"] + ([threshold] if isinstance(threshold, str) else [])
    incomes = _income_columns(income.vectors(wide, keep), income.income)
    outputs = F.struct(*[F.col(c) for c in INCOME_OUTPUT])
    again = incomes.select("_row.*", outputs.alias("_income"))
    scored = train.probability_of_one(
        repayment.repayment.transform(repayment.vectors(again, ["_income"] + keep[1:])),
        "probability_good").drop("prediction")
    return score.apply_threshold(scored, "probability_good", threshold).select(
        income.key, "_income.*", "prediction",
        F.col("probability_good").alias("probability"), "status", "threshold")


def fit_income_scorer(
    applicants: DataFrame, key: str, target: str = "target", params: Mapping | None = None,
    forest: Mapping | None = None, drop: Sequence[str] = tuple(fv.ID_LIKE_TEXT_COLUMNS),
) -> tuple[Scorer, DataFrame]:
    """The voting ensemble on log1p(income), and its scored test rows.

    Rows are split by key hash before anything is fitted. 20 % are test rows, and
    a quarter of the rest validates the second boosted model.
    """
    known = applicants.where(F.col(target).isNotNull() & (F.col(target) > -1)).withColumn(
        target, F.log1p(target))
    test_rows = known.where(holdout_flag(key))
    rest = known.where(~holdout_flag(key))
    preparation = fit_preparation(rest, key, target, drop)
    ready = materialize(preparation.transform(rest, key, [target]), "income-vectors")
    validation = holdout_flag(key, 0.25, seed=fv.SPLIT_SEED + 1)
    set_checkpoint_folder(applicants.sparkSession)
    members = train.fit_side_by_side({
        "boosted": lambda: train.fit_boosted_regressor(ready, target, params),
        "boosted_validated": lambda: train.fit_boosted_regressor(
            ready.where(~validation), target, params, validation=ready.where(validation)),
        "forest": lambda: train.fit_forest_regressor(
            ready, target, {"feature_share": fv.FOREST_FEATURE_SHARE, **(forest or {})}),
    })
    voting = train.fit_voting(members)
    scorer = Scorer(key, preparation, income=voting)
    return scorer, voting.transform(preparation.transform(test_rows, key, [target]))


def fit_both_scorers(
    applicants: DataFrame, key: str, target: str = "target", params: Mapping | None = None,
    drop: Sequence[str] = tuple(fv.ID_LIKE_TEXT_COLUMNS),
) -> tuple[Scorer, DataFrame]:
    """Repayment class and min-max-scaled income over one preparation."""
    known = applicants.where(F.col(target).isNotNull())
    labelled = features.label_repayment_ok(known, target)
    bounds = features.fit_minmax(labelled.where(~holdout_flag(key)), target)
    labelled = labelled.withColumn("scaled_income", bounds.scale(F.col(target)))
    rest, test_rows = labelled.where(~holdout_flag(key)), labelled.where(holdout_flag(key))
    preparation = fit_preparation(
        rest, key, target, [*drop, "repayment_ok", "scaled_income"])
    extra = [target, "repayment_ok", "scaled_income"]
    ready = materialize(preparation.transform(rest, key, extra), "two-target-vectors")
    repayment, capability = train.fit_two_targets(ready, "repayment_ok", "scaled_income", params)
    scorer = Scorer(key, preparation, repayment=repayment, capability=capability, bounds=bounds)
    return scorer, preparation.transform(test_rows, key, extra)


def fit_tuned_income(
    applicants: DataFrame, key: str, target: str = "target", trials: int = fv.RANDOM_SEARCH_TRIALS,
    space: Mapping[str, tuple] | None = None, drop: Sequence[str] = tuple(fv.ID_LIKE_TEXT_COLUMNS),
) -> tuple[Scorer, DataFrame, dict[str, dict]]:
    """Search every family on train / validation rows, refit the winners on both, let them vote.

    Returns the scorer, the scored test rows and the winning settings per family.
    """
    known = applicants.where(F.col(target).isNotNull() & (F.col(target) > -1)).withColumn(
        target, F.log1p(target))
    side = three_way(key)
    rest, test_rows = known.where(side != "test"), known.where(side == "test")
    preparation = fit_preparation(rest.where(side != "val"), key, target, drop)
    ready = materialize(preparation.transform(rest, key, [target]), "tuning-vectors")
    training, validation = ready.where(side == "train"), ready.where(side == "val")
    winners, members = {}, {}
    for family in fv.VOTING_WEIGHTS:
        best = tuning.random_search(training, validation, key, target, family, trials, space)[0][0]
        winners[family] = best
        if family == "forest":
            members[family] = train.fit_forest_regressor(
                ready, target, {"feature_share": fv.FOREST_FEATURE_SHARE, **best})
        elif family == "boosted_validated":
            members[family] = train.fit_boosted_regressor(training, target, best, validation=validation)
        else:
            members[family] = train.fit_boosted_regressor(ready, target, best)
    voting = train.fit_voting(members)
    scored = voting.transform(preparation.transform(test_rows, key, [target]))
    return Scorer(key, preparation, income=voting), scored, winners


def fit_tuned_repayment(
    applicants: DataFrame, key: str, target: str = "target", grid: Mapping | None = None,
    folds: int = 5, params: Mapping | None = None, drop: Sequence[str] = tuple(fv.ID_LIKE_TEXT_COLUMNS),
) -> tuple[Scorer, DataFrame]:
    """A stratified split, a grid decided by f1 over folds, and a scorer with the refitted winner.

    The steps before are those of the single-model trainer: profile features, sparse columns
    dropped, log copies; then the preparation's medians, scaling and categories.
    """
    known = applicants.where(F.col(target).isNotNull())
    labelled = features.label_repayment_ok(known, target)
    rest, test_rows = split_stratified(labelled, key, "repayment_ok")
    columns = [c for c in profiled(rest.drop("repayment_ok"), target, keep=[key, target]).columns if c != target]
    keep = [target, "repayment_ok"]
    shaped = profiled(rest, target, columns=[*columns, *keep])
    preparation = fit_preparation(shaped, key, target, [*drop, "repayment_ok"])
    ready = materialize(preparation.transform(shaped, key, keep), "tuning-vectors")
    search = tuning.grid_search(ready, key, "repayment_ok", "classification", grid, folds, params=params)
    model = train.fit_boosted_classifier(ready, "repayment_ok", {**(params or {}), **search.best})
    scorer = Scorer(key, preparation, repayment=model, profiled=True)
    return scorer, scorer.vectors(test_rows, keep)


def profiled(
    df: DataFrame, target: str, keep: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """Profile features and log copies without the target; sparse columns go, unless ``columns`` says what stays."""
    logged = [c for c in fv.LOG_COLUMNS if c != "income"]
    wide = features.log1p_columns(features.add_profile_features(df), logged)
    if columns is not None:
        return wide.select(*[F.col(f"`{c}`") for c in columns])
    with Stored(wide, "profiled") as stored:
        left = drop_sparse_columns(stored, keep=keep).columns
    return wide.select(*[F.col(f"`{c}`") for c in left])


def save_scorer(scorer: Scorer, path: str) -> None:
    """Write models, preparation, importances and metadata below one folder."""
    p, spark = scorer.preparation, scorer.preparation.encoding.table.sparkSession
    p.stages.write().overwrite().save(f"{path}/stages")
    # The table may live in this very folder, when the scorer was loaded from it.
    with Stored(p.encoding.table, "target-encoding") as copy:
        copy.write.mode("overwrite").parquet(f"{path}/target_encoding")
    if p.frequency is not None:
        with Stored(p.frequency.table, "frequency") as copy:
            copy.write.mode("overwrite").parquet(f"{path}/frequency")
    models = {}
    if scorer.income is not None:
        models.update({f"income_{n}": m for n, m in scorer.income.members.items()})
    if scorer.repayment is not None:
        models["repayment"] = scorer.repayment
    if scorer.capability is not None:
        models["capability"] = scorer.capability
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
        slots = [f"{n}" for n in _slot_names(p)]
        feature_importance(spark, model, slots).write.mode("overwrite").parquet(
            f"{path}/importances/{name}")
    metadata = {
        "key": scorer.key, "profiled": scorer.profiled, "inputs": p.inputs, "flagged": p.flagged, "numeric": p.numeric,
        "categorical": p.categorical, "encoded": p.encoding.columns, "prior": p.encoding.prior,
        "medians": p.medians, "moments": p.scaling.moments, "models": sorted(models),
        "weights": scorer.income.weights if scorer.income is not None else None,
        "frequency": [p.frequency.column, p.frequency.name] if p.frequency else None,
        "bounds": [scorer.bounds.low, scorer.bounds.high] if scorer.bounds else None,
    }
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/metadata")


def _slot_names(p: Preparation) -> list[str]:
    names = list(p.numeric)
    if p.categorical:
        indexer = p.stages.stages[0]
        for c, values in zip(p.categorical, indexer.labelsArray):
            names += [f"{c}_{v}" for v in values]
    return names


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    encoding = encode.TargetEncoding(
        metadata["encoded"], spark.read.parquet(f"{path}/target_encoding"), metadata["prior"])
    preparation = Preparation(
        [tuple(i) for i in metadata["inputs"]], metadata["flagged"], metadata["numeric"],
        metadata["categorical"], encoding, metadata["medians"],
        encode.Scaling({c: tuple(m) for c, m in metadata["moments"].items()}),
        PipelineModel.load(f"{path}/stages"),
        features.Frequency(*metadata["frequency"], spark.read.parquet(f"{path}/frequency"))
        if metadata["frequency"] else None)
    models = {n: DefaultParamsReader.loadParamsInstance(f"{path}/models/{n}", spark)
              for n in metadata["models"]}
    members = {n.removeprefix("income_"): m for n, m in models.items() if n.startswith("income_")}
    income = None
    if members:
        income = train.Voting({n: members[n] for n in metadata["weights"]}, metadata["weights"])
    bounds = features.MinMax(*metadata["bounds"]) if metadata["bounds"] else None
    return Scorer(metadata["key"], preparation, income, models.get("repayment"),
                  models.get("capability"), bounds, metadata["profiled"])
