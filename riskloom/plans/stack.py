"""Out-of-fold stacking: base learners, two meta learners, a weighted vote."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import decide, soft_vote
from riskloom.operators.metrics import mean_over_folds, model_comparison
from riskloom.operators.sampling import stratified_kfold
from riskloom.plans.models import BASE_MODELS, META_MODELS, TrainedModel, load_trained, train
from riskloom.session import fits_at_once, for_passes, materialise, run_jobs, tasks_of_a_pass

TRAINING_VOTE = (0.5, 0.5)
SCORING_VOTE = (0.25, 0.75)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass
class StackModel:
    """Base models, meta models, vote weights and decision rule."""

    base: dict[str, TrainedModel]
    meta: dict[str, TrainedModel]
    features: list[str]
    vote: tuple[float, float] = SCORING_VOTE
    threshold: float = 0.5
    strict: bool = False

    def score(self, df: DataFrame, vote: tuple[float, float] | None = None) -> DataFrame:
        """Add every model's columns, ``fraud_probability`` and ``predicted_label``.

        One narrow pass: no shuffle, so it also runs on a stream.
        """
        out = df
        for name, model in self.base.items():
            out = model.score(out, name)
        for name, model in self.meta.items():
            out = model.score(out, name)
        p = soft_vote([F.col(f"{m}_prob") for m in self.meta], list(vote or self.vote))
        return out.withColumn("fraud_probability", p).withColumn(
            "predicted_label", decide(F.col("fraud_probability"), self.threshold, self.strict)
        )

    def comparison(self, df: DataFrame, label: str = "isFraud", vote: tuple[float, float] = TRAINING_VOTE) -> DataFrame:
        """All metrics for each base model, both metas and the vote on one labelled table."""
        return compare_scored(self.score(df, vote), [*self.base, *self.meta], label)

    def save(self, path: str) -> dict:
        """Write every model; returns the part of the manifest that describes them."""
        for kind, models in (("base", self.base), ("meta", self.meta)):
            for name, model in models.items():
                model.save(f"{path}/{kind}_{name}")
        return {
            "base": {n: {"features": m.features, "params": m.params} for n, m in self.base.items()},
            "meta": {n: {"features": m.features, "params": m.params} for n, m in self.meta.items()},
            "features": self.features,
            "vote": list(self.vote),
            "threshold": self.threshold,
            "strict": self.strict,
        }

    @classmethod
    def load(cls, spark, path: str, entry: dict) -> StackModel:
        def models(kind: str) -> dict:
            return {
                n: load_trained(spark, f"{path}/{kind}_{n}", n, d["features"], d["params"])
                for n, d in entry[kind].items()
            }

        return cls(
            models("base"), models("meta"), entry["features"], tuple(entry["vote"]), entry["threshold"], entry["strict"]
        )


def compare_scored(scored: DataFrame, models: Sequence[str], label: str = "isFraud") -> DataFrame:
    narrow = scored.select(
        F.col(label).alias("label"),
        *[f"{m}_prob" for m in models],
        *[f"{m}_pred" for m in models],
        F.col("fraud_probability").alias("ensemble_prob"),
        F.col("predicted_label").alias("ensemble_pred"),
    )
    names = [*models, "ensemble"]
    return model_comparison(
        narrow, "label", {m: f"{m}_prob" for m in names}, predictions={m: f"{m}_pred" for m in names}
    )


@dataclass
class StackResult:
    model: StackModel
    meta_table: DataFrame  # key, fold, label, <model>_prob, <model>_pred
    base_models: list[str]
    label: str
    in_sample: DataFrame = field(default=None)
    last_fold: dict[str, TrainedModel] = field(default_factory=dict)  # base models that never saw fold k - 1

    def cv_scores(self) -> DataFrame:
        """``model, mean_auc, n_folds`` of the base models over the folds."""
        rows = F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.col(f"{m}_prob").alias("p"))
                for m in self.base_models
            ]
        )
        long = self.meta_table.select("fold", F.col(self.label).alias("label"), F.explode(rows).alias("r"))
        return mean_over_folds(long.select("fold", "label", "r.model", "r.p"))


def out_of_fold(
    folded: DataFrame,
    features: list[str],
    key: str,
    label: str,
    k: int,
    base_models: Sequence[str],
    size: str = "full",
    overrides: Mapping[str, Mapping] | None = None,
    seed: int = 42,
    workers: int = 4,
    dealt: bool = False,
) -> tuple[DataFrame, dict[tuple[int, str], TrainedModel]]:
    """Score every row with models that never saw its fold.

    ``folded`` should be persisted: it is read once per fit. ``dealt`` as for ``train``.
    """
    fits = _fold_fits(folded, features, key, label, k, base_models, size, overrides or {}, seed, dealt)
    models = run_jobs(fits, workers)
    return _scored_folds(folded, features, key, label, k, base_models, models), models


def _fold_fits(folded, features, key, label, k, base_models, size, overrides, seed, dealt) -> dict:
    """``(fold, name)``: a fit of that model on the rows of all other folds."""

    def fit(i: int, name: str):
        return lambda: train(
            folded.where(F.col("fold") != i), name, features, label, size, overrides.get(name), seed, key, dealt
        )

    return {(i, name): fit(i, name) for name in base_models for i in range(k)}


def _scored_folds(folded, features, key, label, k, base_models, models) -> DataFrame:
    parts = []
    for i in range(k):
        part = folded.where(F.col("fold") == i).select(key, "fold", label, *features)
        for name in base_models:
            part = models[i, name].score(part, name)
        parts.append(part.drop(*features))
    return union_all(parts)


def train_stack(
    df: DataFrame,
    features: list[str],
    key: str = "TransactionID",
    label: str = "isFraud",
    k: int = 5,
    base_models: Sequence[str] = BASE_MODELS,
    size: str = "full",
    overrides: Mapping[str, Mapping] | None = None,
    seed: int = 42,
    final: str = "refit",
    vote: tuple[float, float] = SCORING_VOTE,
    workers: int | None = None,
) -> StackResult:
    """Folds, out-of-fold meta table, meta models, and base models for scoring.

    ``final="refit"`` fits the base models again on all rows;
    ``final="last_fold"`` keeps those of the last fold. The fits on all rows need nothing of
    the folds, so they run beside those of the folds, ``workers`` at a time (by default as
    many as keep the cores busy).
    """
    overrides = overrides or {}
    rows = df.select(key, label, *features)
    n_rows = rows.count()
    workers = workers or fits_at_once(df.sparkSession, tasks_of_a_pass(df.sparkSession, n_rows, len(features)))
    folded = for_passes(stratified_kfold(rows, key, label, k, seed), n_rows, len(features)).persist()
    try:
        fits = _fold_fits(folded, features, key, label, k, base_models, size, overrides, seed, True)
        if final == "refit":
            whole = {
                (None, name): (lambda name=name: train(folded, name, features, label, size, overrides.get(name), seed, key, True))
                for name in base_models
            }
            fits = whole | fits  # the longest come first
        by_fold = run_jobs(fits, workers)
        meta_table = materialise(_scored_folds(folded, features, key, label, k, base_models, by_fold))
        meta_inputs = {
            META_MODELS[0]: [f"{m}_pred" for m in base_models],
            META_MODELS[1]: [f"{m}_prob" for m in base_models],
        }
        fitted = run_jobs(
            {
                name: (lambda name=name, cols=cols: train(meta_table, name, cols, label, size, overrides.get(name), seed, key))
                for name, cols in meta_inputs.items()
            },
            workers,
        )
        base = {name: by_fold[None if final == "refit" else k - 1, name] for name in base_models}
    finally:
        folded.unpersist()
    model = StackModel(base, {name: fitted[name] for name in META_MODELS}, features, vote)
    last = {name: by_fold[k - 1, name] for name in base_models}
    return StackResult(model, meta_table, list(base_models), label, last_fold=last)


def in_sample_comparison(result: StackResult) -> DataFrame:
    """Metrics on the rows the meta models were fitted on; not a hold-out measure."""
    scored = result.meta_table
    for name, model in result.model.meta.items():
        scored = model.score(scored, name)
    p = soft_vote([F.col(f"{m}_prob") for m in result.model.meta], list(TRAINING_VOTE))
    scored = scored.withColumn("fraud_probability", p).withColumn("predicted_label", decide(F.col("fraud_probability")))
    return compare_scored(scored, [*result.base_models, *result.model.meta], result.label)
