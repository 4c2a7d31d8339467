"""Named classifier presets on MLlib, and the calibrated linear SVM."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.machines import Machine, fit_machines, pack
from riskloom.operators.sampling import stratified_kfold, with_class_weight
from riskloom.session import ROWS_A_TASK, checkpoint_dir, for_passes, run_jobs

MAX_DEPTH = 30  # MLlib's limit; stands for "no limit"

# Learner settings. Where MLlib has no such knob (leaf count, L1/L2
# on leaves, border sampling) the nearest one is used. ``positive_weight`` None
# means balanced, 0 means unweighted.
FULL: dict[str, dict] = {
    "rf": {
        "kind": "forest", "numTrees": 1000, "maxDepth": MAX_DEPTH, "minInstancesPerNode": 4,
        "featureSubsetStrategy": "sqrt", "positive_weight": None,
    },
    "lgb": {
        "kind": "gbt", "maxIter": 2000, "stepSize": 0.01, "maxDepth": 6, "minInstancesPerNode": 100,
        "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "positive_weight": 20.0,
    },
    "xgb": {
        "kind": "gbt", "maxIter": 3000, "stepSize": 0.0139, "maxDepth": 16, "minInstancesPerNode": 170,
        "minInfoGain": 0.0, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7463", "positive_weight": 20.0,
    },
    "catboost": {
        "kind": "gbt", "maxIter": 2000, "stepSize": 0.03, "maxDepth": 7, "maxBins": 254, "positive_weight": 20.0,
    },
    "log": {"kind": "logistic", "C": 1.0, "maxIter": 1000, "tol": 1e-4},
    "contrast_rf": {"kind": "forest", "numTrees": 100, "maxDepth": MAX_DEPTH, "featureSubsetStrategy": "sqrt"},
    "contrast_xgb": {"kind": "gbt", "maxIter": 100, "stepSize": 0.1, "maxDepth": 6},
    "mlp": {"kind": "mlp", "hidden": [100, 50], "maxIter": 20},
    "svm": {"kind": "svm", "C": 1.0, "maxIter": 10000, "tol": 1e-4, "folds": 5},
    "meta_pred": {"kind": "gbt", "maxIter": 100, "stepSize": 0.1, "maxDepth": 5},
    "meta_prob": {"kind": "gbt", "maxIter": 100, "stepSize": 0.1, "maxDepth": 5},
}

# Full settings but for the number of rounds.
SHORT: dict[str, dict] = {
    "rf": {"numTrees": 6},
    "lgb": {"maxIter": 4},
    "xgb": {"maxIter": 3},
    "catboost": {"maxIter": 4},
    "contrast_rf": {"numTrees": 6},
    "contrast_xgb": {"maxIter": 5},
    "meta_pred": {"maxIter": 5},
    "meta_prob": {"maxIter": 5},
}

# The same learners cut down further, for tests.
SMALL: dict[str, dict] = {
    "rf": {"numTrees": 10, "maxDepth": 6},
    "lgb": {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3, "minInstancesPerNode": 10},
    "xgb": {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3, "minInstancesPerNode": 17},
    "catboost": {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3, "maxBins": 64},
    "log": {"maxIter": 50},
    "contrast_rf": {"numTrees": 10, "maxDepth": 6},
    "contrast_xgb": {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3},
    "mlp": {"hidden": [16, 8], "maxIter": 60},
    "svm": {"maxIter": 10},
    "meta_pred": {"maxIter": 5, "maxDepth": 3},
    "meta_prob": {"maxIter": 5, "maxDepth": 3},
}

BASE_MODELS = ("rf", "lgb", "xgb", "catboost")
META_MODELS = ("meta_pred", "meta_prob")
SINGLE_MODELS = ("log", "contrast_rf", "contrast_xgb", "mlp", "svm")


def settings(name: str, size: str = "full", overrides: Mapping[str, object] | None = None) -> dict:
    chosen = dict(FULL[name])
    if size != "full":
        chosen.update({"short": SHORT, "small": SMALL}[size].get(name, {}))
    chosen.update(overrides or {})
    return chosen


@dataclass
class TrainedModel:
    """A fitted pipeline from feature columns to ``probability`` and ``prediction``."""

    name: str
    features: list[str]
    pipeline: PipelineModel
    params: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)

    def score(self, df: DataFrame, prefix: str | None = None) -> DataFrame:
        """Add ``<prefix>_prob`` and ``<prefix>_pred``; the input columns are kept."""
        prefix = prefix or self.name
        return self.transform(df).select(
            *[F.col(f"`{c}`") for c in df.columns],
            vector_to_array(F.col("probability"))[1].alias(f"{prefix}_prob"),
            F.col("prediction").cast("int").alias(f"{prefix}_pred"),
        )

    @property
    def learner(self):
        return self.pipeline.stages[-1]

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)


@dataclass
class CalibratedSVM:
    """Linear SVMs, one per fold, each with a sigmoid fitted on its held-out fold.

    The probability is the mean over the folds.
    """

    name: str
    features: list[str]
    assembler: VectorAssembler
    machines: list[Machine]
    sigmoids: list[LogisticRegressionModel]
    params: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and ``probability`` (a vector), as MLlib models do."""
        from pyspark.ml.functions import array_to_vector

        out = self.assembler.transform(df)
        parts = []
        for machine, sigmoid in zip(self.machines, self.sigmoids, strict=True):
            margin = machine.margin(vector_to_array(F.col("_features")))
            slope, intercept = float(sigmoid.coefficients[0]), float(sigmoid.intercept)
            parts.append(1.0 / (1.0 + F.exp(-(margin * F.lit(slope) + F.lit(intercept)))))
        p = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
        return out.withColumn("_p", p).select(
            *[F.col(f"`{c}`") for c in df.columns],
            array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p"))).alias("probability"),
            (F.col("_p") > 0.5).cast("double").alias("prediction"),
        )

    score = TrainedModel.score

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        rows = [(i, m.coefficients, m.intercept) for i, m in enumerate(self.machines)]
        table = spark.createDataFrame(rows, "fold int, coefficients array<double>, intercept double")
        table.write.mode("overwrite").parquet(f"{path}/machines")
        for i, sigmoid in enumerate(self.sigmoids):
            sigmoid.write().overwrite().save(f"{path}/sigmoid_{i}")


def _learner(spec: dict, n_features: int, n_rows: int | None, seed: int, weight: str | None):
    spec = dict(spec)
    kind = spec.pop("kind")
    spec.pop("positive_weight", None)
    common = {"labelCol": "_label", "featuresCol": "_features"}
    if kind == "forest":
        learner = RandomForestClassifier(seed=seed, **common, **spec)
    elif kind == "gbt":
        learner = GBTClassifier(seed=seed, **common, **spec)
    elif kind == "logistic":
        reg = 1.0 / (spec.pop("C") * max(1, n_rows or 1))
        learner = LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, **common, **spec)
    elif kind == "mlp":
        layers = [n_features, *spec.pop("hidden"), 2]
        return MultilayerPerceptronClassifier(seed=seed, layers=layers, **common, **spec)
    else:
        raise ValueError(f"unknown learner kind {kind}")
    return learner.setWeightCol(weight) if weight else learner


def train(
    df: DataFrame,
    name: str,
    features: list[str],
    label: str = "isFraud",
    size: str = "full",
    overrides: Mapping[str, object] | None = None,
    seed: int = 42,
    key: str | None = None,
    dealt: bool = False,
) -> TrainedModel | CalibratedSVM:
    """Fit the preset ``name`` on ``features``; ``key`` is needed by the calibrated SVM.

    ``dealt`` says that ``df`` lies as ``for_passes`` lays it.
    """
    spec = settings(name, size, overrides)
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    rows = df.withColumn("_label", F.col(label).cast("double"))
    if spec["kind"] == "svm":
        return _train_svm(rows, name, features, assembler, spec, label, seed, key)
    if spec["kind"] == "gbt":
        checkpoint_dir(df.sparkSession)  # with no folder the lineage grows by the round and overflows the stack
    weight = None
    if spec.get("positive_weight", 0) != 0 and spec["kind"] != "mlp":
        rows, weight = with_class_weight(rows, label, spec["positive_weight"], "_weight"), "_weight"
    n_rows = None if dealt and spec["kind"] != "logistic" else rows.count()
    learner = _learner(spec, len(features), n_rows, seed, weight)
    rows = rows.select("_label", *([weight] if weight else []), *[F.col(f"`{c}`") for c in features])
    if not dealt:
        # a network has thousands of products a row, so a few rows fill a task
        rows = for_passes(rows, n_rows, len(features), 256 if spec["kind"] == "mlp" else ROWS_A_TASK)
    return TrainedModel(name, features, Pipeline(stages=[assembler, learner]).fit(rows), spec)


def _train_svm(rows, name, features, assembler, spec, label, seed, key) -> CalibratedSVM:
    if key is None:
        raise ValueError("the calibrated SVM needs the row key to form its folds")
    folds = spec["folds"]
    folded = stratified_kfold(assembler.transform(rows), key, label, folds, seed).select("_features", "_label", "fold")
    folded = for_passes(folded, rows.count(), len(features)).persist()
    blocks = pack(folded, "_features", "_label").persist()
    try:
        counts = {r["fold"]: (r["n"], r["p"]) for r in folded.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_label").alias("p")).collect()}
        total = sum(n for n, _ in counts.values())
        others = [total - counts.get(i, (0, 0.0))[0] for i in range(folds)]
        regs = [1.0 / (spec["C"] * max(1, n)) for n in others]
        machines = fit_machines(blocks, others, len(features), regs, spec["maxIter"], spec["tol"])

        def calibrate(i: int):
            held, positives = counts.get(i, (0, 0.0))
            margin = machines[i].margin(vector_to_array(F.col("_features")))
            margins = folded.where(F.col("fold") == i).select("_label", margin.alias("m"))
            return _fit_sigmoid(margins, positives, held - positives)

        fitted = run_jobs({i: (lambda i=i: calibrate(i)) for i in range(folds)}, workers=folds)
        sigmoids = [fitted[i] for i in range(folds)]
    finally:
        blocks.unpersist()
        folded.unpersist()
    return CalibratedSVM(name, features, assembler, machines, sigmoids, spec)


def _fit_sigmoid(margins: DataFrame, positives: float, negatives: float) -> LogisticRegressionModel:
    """Platt's smoothed targets: every row twice, label 1 with weight t and 0 with 1 - t."""
    high, low = (positives + 1.0) / (positives + 2.0), 1.0 / (negatives + 2.0)
    target = F.when(F.col("_label") == 1.0, F.lit(high)).otherwise(F.lit(low))
    pair = F.array(
        F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1.0 - target).alias("w"))
    )
    rows = margins.select("m", F.explode(pair).alias("t"))
    one = VectorAssembler(inputCols=["m"], outputCol="f").transform(rows.select("m", "t.y", "t.w"))
    return LogisticRegression(
        featuresCol="f", labelCol="y", weightCol="w", regParam=0.0, maxIter=100, tol=1e-5
    ).fit(one)


def load_trained(spark: SparkSession, path: str, name: str, features: list[str], params: dict):
    if params["kind"] != "svm":
        return TrainedModel(name, features, PipelineModel.load(path), params)
    folds = range(params["folds"])
    return CalibratedSVM(
        name,
        features,
        VectorAssembler(inputCols=features, outputCol="_features"),
        [Machine(list(r["coefficients"]), r["intercept"]) for r in spark.read.parquet(f"{path}/machines").orderBy("fold").collect()],
        [LogisticRegressionModel.load(f"{path}/sigmoid_{i}") for i in folds],
        params,
    )


def build_base_models(size: str = "full") -> dict[str, dict]:
    return {name: settings(name, size) for name in BASE_MODELS}


def build_meta_models(size: str = "full") -> dict[str, dict]:
    return {name: settings(name, size) for name in META_MODELS}
