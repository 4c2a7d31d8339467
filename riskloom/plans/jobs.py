"""End-to-end jobs: train, score, compare single models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import clean
from riskloom.operators.encode import LabelEncoder, MinMaxScaler, StandardScaler
from riskloom.operators.explain import explain_models
from riskloom.operators.metrics import (
    classification_report,
    confusion_matrix,
    evaluate,
    rank_direction,
    rank_importance,
    risk_distribution,
    threshold_metrics,
)
from riskloom.operators.neighbors import smote
from riskloom.operators.profile import exact_medians
from riskloom.operators.reduce import drop_correlated_wide
from riskloom.operators.sampling import random_split, sample_rows, stratified_kfold, stratified_split
from riskloom.plans.features import FeaturePlan, PlanOptions
from riskloom.plans.models import BASE_MODELS, train
from riskloom.plans.stack import TRAINING_VOTE, StackResult, compare_scored, in_sample_comparison, train_stack
from riskloom.session import materialise
from riskloom.sources import sinks
from riskloom.sources.state import FittedState, save_state
from riskloom.sources.tables import ROW_ORDER, load_joined


@dataclass
class TrainingReport:
    """Everything a training run yields, as tables."""

    state: FittedState
    stack: StackResult
    cv_scores: DataFrame
    in_sample: DataFrame
    holdout: DataFrame  # scored hold-out rows
    comparison: DataFrame  # metrics per model on the hold-out
    metrics: DataFrame
    confusion: DataFrame
    report: DataFrame
    attributions: DataFrame | None = None  # every row's, where asked for
    importance: DataFrame | None = None
    direction: DataFrame | None = None
    fold_importance: DataFrame | None = None  # of the last fold's rows and models
    fold_direction: DataFrame | None = None


def train_job(
    fact: DataFrame,
    identity: DataFrame | None = None,
    options: PlanOptions | None = None,
    k: int = 5,
    size: str = "full",
    base_models: Sequence[str] = BASE_MODELS,
    overrides: Mapping[str, Mapping] | None = None,
    test_share: float = 0.2,
    fit_scope: str = "train",
    final: str = "refit",
    explain_rows: int | None = None,
    keep_attributions: bool = False,
    explain_last_fold: bool = False,
    draws: int = 8,
    sample_size: int | None = None,
    seed: int = 42,
    output: str | None = None,
    workers: int | None = None,
) -> TrainingReport:
    """Join, split, fit the feature plan, stack, evaluate on the hold-out, explain, save.

    ``fit_scope="train"`` fits the plan on the training part only, ``"all"`` on
    every row. The whole hold-out is explained, whatever the base models are, and only
    means are written; ``explain_rows`` asks for a sample of it (0: nothing),
    ``keep_attributions`` for the values of every row, ``explain_last_fold`` for the rows of
    the last fold and the models that never saw them as well. ``draws`` is for models
    without an exact way.
    """
    o = options or PlanOptions()
    rows = load_joined(fact, identity, o.key)
    if sample_size is not None:
        rows = sample_rows(rows, o.key, sample_size, seed)
    split = stratified_split(rows, o.key, o.label, test_share, seed).persist()
    try:
        train_rows, test_rows = split.where("is_test = 0").drop("is_test"), split.where("is_test = 1").drop("is_test")
        plan = FeaturePlan.fit(train_rows if fit_scope == "train" else split.drop("is_test"), o)
        train_features = plan.transform(train_rows, [o.label]).persist()
        test_features = materialise(plan.transform(test_rows, [o.label]))
        result = train_stack(
            train_features, plan.features, o.key, o.label, k, base_models, size, overrides, seed, final, workers=workers
        )
        fold_rows = None
        if explain_last_fold:
            folded = stratified_kfold(train_features, o.key, o.label, k, seed)
            fold_rows = materialise(folded.where(F.col("fold") == k - 1).drop("fold"))
        pool = materialise(train_features.select(o.key, *plan.features))
        train_features.unpersist()
    finally:
        split.unpersist()

    holdout = materialise(result.model.score(test_features, TRAINING_VOTE))
    models = [*result.model.base, *result.model.meta]
    report = TrainingReport(
        FittedState(plan, result.model),
        result,
        result.cv_scores(),
        in_sample_comparison(result),
        holdout,
        compare_scored(holdout, models, o.label),
        evaluate(holdout, o.label, "predicted_label", "fraud_probability"),
        confusion_matrix(holdout, o.label, "predicted_label"),
        classification_report(holdout, o.label, "predicted_label"),
    )
    if explain_rows != 0:
        sample = test_features if explain_rows is None else sample_rows(test_features, o.key, explain_rows, seed)
        summary, report.attributions = explain_models(
            result.model.base, sample, o.key, plan.features, pool, draws, seed, keep_attributions
        )
        report.importance, report.direction = rankings(summary)
    if fold_rows is not None:
        summary, _ = explain_models(result.last_fold, fold_rows, o.key, plan.features, pool, draws, seed)
        report.fold_importance, report.fold_direction = rankings(summary)
    if output is not None:
        write_training(report, output, o)
    return report


def rankings(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Importance and direction tables of mean attributions per model and feature."""
    importance = summary.select("model", "feature", F.col("mean_abs").alias("importance"))
    direction = summary.select("model", "feature", F.col("mean_signed").alias("mean_value"))
    return rank_importance(importance, groups=["model"]), rank_direction(direction, groups=["model"])


def write_training(report: TrainingReport, output: str, o: PlanOptions) -> None:
    spark = report.holdout.sparkSession
    save_state(spark, f"{output}/models", report.state.plan, report.state.stack)
    sinks.write_table(sinks.prediction_rows(report.holdout, o.label), f"{output}/predictions")
    sinks.write_meta(report.stack.meta_table, report.stack.base_models, f"{output}/meta_model_data", o.label)
    sinks.write_table(report.comparison, f"{output}/comparison", "parquet")
    sinks.write_table(report.report, f"{output}/report", "parquet")
    if report.importance is not None:
        sinks.write_importance(report.importance, f"{output}/importance")
    if report.fold_importance is not None:
        sinks.write_importance(report.fold_importance, f"{output}/importance_last_fold")


def score_rows(
    state: FittedState,
    fact: DataFrame,
    identity: DataFrame | None = None,
    vote: tuple[float, float] | None = None,
    refit_on_batch: bool = False,
    deduplicate: bool = True,
) -> DataFrame:
    """``key, fraud_probability, predicted_label`` for each row of a new table.

    Uses the fitted tables; ``refit_on_batch`` recomputes statistics, codes and
    frequencies on the given rows instead. ``deduplicate=False`` leaves out the
    keep-first step on ``fact`` (streams).
    """
    o = state.plan.options
    if deduplicate:
        rows = load_joined(fact, identity, o.key)
    else:
        rows = clean.rename_columns(fact)
        if identity is not None:
            one_each = clean.dedup_keep_first(clean.rename_columns(identity), o.key).drop(ROW_ORDER)
            rows = rows.join(one_each, o.key, "left")
    if refit_on_batch:  # read a dozen times
        rows = materialise(rows)
    plan = state.plan.refit(rows) if refit_on_batch else state.plan
    scored = state.stack.score(plan.transform(rows), vote)
    return scored.select(o.key, "fraud_probability", "predicted_label")


def submission_job(state: FittedState, fact: DataFrame, identity: DataFrame | None, path: str, **kwargs) -> None:
    """Score a table in bulk into ``TransactionID, isFraud`` (CSV)."""
    sinks.write_table(sinks.submission_rows(score_rows(state, fact, identity, **kwargs), state.plan.options.key), path)


@dataclass
class RiskReport:
    rows: DataFrame  # key, fraud_probability, is_fraud, risk_level
    distribution: DataFrame
    first: DataFrame


def risk_job(
    state: FittedState, fact: DataFrame, identity: DataFrame | None = None, shown: int = 100, path: str | None = None
) -> RiskReport:
    """Score with bands: the rows, how many per band, the first ones by id, CSV export."""
    key = state.plan.options.key
    rows = materialise(sinks.export_rows(score_rows(state, fact, identity), key))
    if path is not None:
        sinks.write_table(rows, path)
    return RiskReport(rows, risk_distribution(rows), rows.orderBy(key).limit(shown))


@dataclass
class SingleModelResult:
    model: object
    features: list[str]
    predictions: DataFrame  # TransactionID, y_pred, proba_0, proba_1
    accuracy: DataFrame
    report: DataFrame
    params: DataFrame


def single_model_job(
    fact: DataFrame,
    identity: DataFrame | None = None,
    name: str = "log",
    key: str = "TransactionID",
    label: str = "isFraud",
    size: str = "full",
    overrides: Mapping[str, object] | None = None,
    fit_scope: str = "train",
    min_distinct: int = 55,
    max_correlation: float = 0.8,
    seed: int = 42,
    output: str | None = None,
) -> SingleModelResult:
    """One comparison run: medians, codes, scaling to [0, 1], wide uncorrelated
    features, 80/20 split, minority oversampling of the training part, fit, report."""
    rows = random_split(load_joined(fact, identity, key), key, 0.2, seed).persist()
    try:
        fit_rows = rows.where("is_test = 0") if fit_scope == "train" else rows
        numeric = clean.numeric_columns(rows, [key, label, "is_test"])
        medians = exact_medians(fit_rows, numeric)
        strings = clean.string_columns(rows)
        filled = clean.fill_median(rows, numeric, medians)
        labels = LabelEncoder.fit(filled.where("is_test = 0") if fit_scope == "train" else filled, strings)
        coded = labels.transform(filled).persist()
        fit_coded = coded.where("is_test = 0") if fit_scope == "train" else coded
        candidates = clean.numeric_columns(coded, [key, label, "is_test"])
        features = drop_correlated_wide(fit_coded, candidates, max_correlation, min_distinct)
        scaler = StandardScaler.fit(fit_coded, features)
        ranges = MinMaxScaler.fit_after(scaler, fit_coded, features)
        scaled = ranges.transform(scaler.transform(coded.select(key, label, "is_test", *features)))
        packed = scaled.select(
            key, label, "is_test", F.array(*[F.col(c).cast("double") for c in features]).alias("_x")
        )
        data = materialise(packed)
        coded.unpersist()
    finally:
        rows.unpersist()

    oversampled = smote(data.where("is_test = 0"), key, "_x", label, seed=seed)
    # Synthetic rows have no id; they get a negative one from the rows they were drawn between.
    made_key = -F.abs(F.xxhash64("base_id", "neighbor_id", "_x")) - 1
    train_rows = _spread(
        oversampled.withColumn(key, F.coalesce(F.col(key), made_key)).select(key, label, "_x"), features
    ).persist()
    try:
        model = train(train_rows, name, features, label, size, overrides, seed, key)
    finally:
        train_rows.unpersist()
    valid = _spread(data.where("is_test = 1").select(key, label, "_x"), features)
    scored = materialise(model.transform(valid).select(key, label, "prediction", "probability"))
    called = scored.withColumn("prediction", F.col("prediction").cast("int"))
    result = SingleModelResult(
        model,
        features,
        sinks.single_model_rows(scored, key),
        threshold_metrics(called, label, "prediction").select("accuracy"),
        classification_report(called, label, "prediction"),
        sinks.params_row(scored.sparkSession, name, model.params),
    )
    if output is not None:
        model.save(f"{output}/{name}_model")
        sinks.write_table(result.predictions, f"{output}/{name}_predictions")
        sinks.write_report(result.report, result.params, f"{output}/{name}")
    return result


def _spread(df: DataFrame, features: list[str]) -> DataFrame:
    kept = [c for c in df.columns if c != "_x"]
    return df.select(*kept, *[F.col("_x")[i].alias(c) for i, c in enumerate(features)])
