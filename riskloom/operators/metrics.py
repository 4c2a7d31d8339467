"""Evaluation of scored rows: curves, areas, reports, comparisons.

Curves first reduce rows to distinct scores (a map-side combined aggregate), so
ties, however heavy, never reach the ordered part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.scalars import decide
from riskloom.operators.ordering import running_totals


def _by_score(df: DataFrame, label: str, score: str, groups: list[str]) -> DataFrame:
    positive = (F.col(label) == 1).cast("long")
    return df.groupBy(*groups, F.col(score).cast("double").alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def curve(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Per distinct score, highest first: counts at the score and at or above it."""
    scored = df.where(F.col(score).isNotNull())
    return running_totals(_by_score(scored, label, score, groups or []), "score", ["pos", "neg"], groups, True)


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``threshold, fpr, tpr`` per distinct score, plus the start (NULL, 0, 0)."""
    points = curve(df, label, score).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("upto_neg"), F.col("total_neg")).alias("fpr"),
        F.try_divide(F.col("upto_pos"), F.col("total_pos")).alias("tpr"),
    )
    start = df.sparkSession.sql("select cast(null as double) as threshold, 0.0D as fpr, 0.0D as tpr")
    return points.unionByName(start)


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``threshold, precision, recall`` per distinct score, plus the end (NULL, 1, 0)."""
    points = curve(df, label, score).select(
        F.col("score").alias("threshold"),
        (F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg"))).alias("precision"),
        F.try_divide(F.col("upto_pos"), F.col("total_pos")).alias("recall"),
    )
    end = df.sparkSession.sql("select cast(null as double) as threshold, 1.0D as precision, 0.0D as recall")
    return points.unionByName(end)


def _roc_auc() -> Column:
    """Ties count half; NULL with one class only."""
    negatives_below = F.col("total_neg") - F.col("upto_neg")
    pairs = F.sum(F.col("pos") * (negatives_below + F.col("neg") / F.lit(2.0)))
    return F.try_divide(pairs, F.max(F.col("total_pos").cast("double") * F.col("total_neg")))


def _pr_auc() -> Column:
    """Trapezoids over (recall, precision) from (0, 1)."""
    before_pos, before_neg = F.col("upto_pos") - F.col("pos"), F.col("upto_neg") - F.col("neg")
    precision = F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg"))
    before = F.coalesce(F.try_divide(before_pos, before_pos + before_neg), F.lit(1.0))
    return F.sum(F.try_divide(F.col("pos"), F.col("total_pos")) * (precision + before) / 2)


def areas(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """``roc_auc, pr_auc`` per group, both from one pass over the curve."""
    points = curve(df, label, score, groups)
    return points.groupBy(*(groups or [])).agg(_roc_auc().alias("roc_auc"), _pr_auc().alias("pr_auc"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return areas(df, label, score).select("roc_auc")


def pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return areas(df, label, score).select("pr_auc")


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``true_label, predicted_label, n`` with all four cells; one pass, no shuffle of rows."""
    cells = [(t, p) for t in (0, 1) for p in (0, 1)]
    wide = df.agg(
        *[F.count_if((F.col(label) == t) & (F.col(predicted) == p)).alias(f"n{t}{p}") for t, p in cells]
    )
    grid = F.array(
        *[
            F.struct(
                F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"), F.col(f"n{t}{p}").alias("n")
            )
            for t, p in cells
        ]
    )
    return wide.select(F.explode(grid).alias("c")).select("c.*")


def _threshold_aggregates(label: Column, predicted: Column) -> list[Column]:
    tp = F.count_if((label == 1) & (predicted == 1))
    actual, called = F.count_if(label == 1), F.count_if(predicted == 1)
    zero = F.lit(0.0)
    return [
        F.avg((label == predicted).cast("int")).alias("accuracy"),
        F.coalesce(F.try_divide(tp, called), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, actual), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, actual + called), zero).alias("f1_score"),
    ]


def threshold_metrics(df: DataFrame, label: str, predicted: str, groups: list[str] | None = None) -> DataFrame:
    """Accuracy, and precision, recall and F1 of the positive class (0 if undefined)."""
    return df.groupBy(*(groups or [])).agg(*_threshold_aggregates(F.col(label), F.col(predicted)))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``class, precision, recall, f1_score, support`` for 0, 1, accuracy and both averages."""
    c = confusion_matrix(df, label, predicted)
    n = {
        (t, p): F.sum(F.when((F.col("true_label") == t) & (F.col("predicted_label") == p), F.col("n"))).alias(f"n{t}{p}")
        for t in (0, 1)
        for p in (0, 1)
    }
    one = c.agg(*n.values())

    def cell(t: int, p: int) -> Column:
        return F.col(f"n{t}{p}")

    def over(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    total = cell(0, 0) + cell(0, 1) + cell(1, 0) + cell(1, 1)
    per_class = []
    for k in (0, 1):
        support, called = cell(k, 0) + cell(k, 1), cell(0, k) + cell(1, k)
        per_class.append((over(cell(k, k), called), over(cell(k, k), support), over(2 * cell(k, k), support + called), support))
    accuracy = over(cell(0, 0) + cell(1, 1), total)

    def line(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"), s.alias("support")
        )

    zero, first = per_class
    macro = [(zero[i] + first[i]) / 2 for i in range(3)]
    weighted = [over(zero[i] * zero[3] + first[i] * first[3], total) for i in range(3)]
    lines = F.array(
        line("0", *zero),
        line("1", *first),
        line("accuracy", accuracy, accuracy, accuracy, total),
        line("macro avg", *macro, total),
        line("weighted avg", *weighted, total),
    )
    return one.select(F.explode(lines).alias("l")).select("l.*")


def evaluate(df: DataFrame, label: str, predicted: str, score: str) -> DataFrame:
    """All scalar metrics as one row."""
    parts = areas(df, label, score).unionByName(threshold_metrics(df, label, predicted), allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def model_metrics(long: DataFrame) -> DataFrame:
    """Metrics per ``model`` from ``model, label, p, pred`` rows."""
    areas_by_model = areas(long, "label", "p", ["model"])
    counts = threshold_metrics(long, "label", "pred", ["model"])
    return areas_by_model.join(counts, "model")


def model_comparison(
    scored: DataFrame, label: str, scores: dict[str, str], threshold: float = 0.5, predictions: dict[str, str] | None = None
) -> DataFrame:
    """All metrics for several score columns of one table, in one job.

    ``scores`` maps a model name to its probability column; labels come from
    ``predictions`` where given, else from the threshold.
    """
    predictions = predictions or {}
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("model"),
                F.col(label).cast("int").alias("label"),
                F.col(column).cast("double").alias("p"),
                (F.col(predictions[name]).cast("int") if name in predictions else decide(F.col(column), threshold)).alias(
                    "pred"
                ),
            )
            for name, column in scores.items()
        ]
    )
    return model_metrics(scored.select(F.explode(rows).alias("m")).select("m.*"))


def score_histogram(df: DataFrame, label: str, score: str, bins: int = 50) -> DataFrame:
    """``label, bin, bin_start, n, density``: equal bins on each class's own range, empty ones kept."""
    ranges = df.groupBy(F.col(label).alias("label")).agg(
        F.min(score).alias("low"), F.max(score).alias("high"), F.count(score).alias("total")
    )
    # A class with one score only gets the range half a unit to each side.
    flat = F.col("low") == F.col("high")
    ranges = ranges.select(
        "label",
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        "total",
    )
    position = F.floor((F.col(score) - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    counted = (
        df.withColumnRenamed(label, "label")
        .join(F.broadcast(ranges), "label")
        .groupBy("label", F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("high") - F.col("low")) / F.lit(bins)
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(F.broadcast(counted), ["label", "bin"], "left").select(
        "label",
        "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_start"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        (F.coalesce(F.col("n"), F.lit(0)) / (F.col("total") * width)).alias("density"),
    )


def mean_over_folds(long: DataFrame, by: str = "fold") -> DataFrame:
    """``model, mean_auc``: the AUC of every (model, fold), averaged per model."""
    per_fold = areas(long, "label", "p", ["model", by])
    return per_fold.groupBy("model").agg(F.avg("roc_auc").alias("mean_auc"), F.count("roc_auc").alias("n_folds"))


def risk_distribution(df: DataFrame, band: str = "risk_level") -> DataFrame:
    """``risk_level, n`` with the total as its own row; all bands present."""
    bands = ("High", "Medium", "Low")
    wide = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(band) == b).alias(b) for b in bands],
    )
    rows = F.array(
        *[F.struct(F.lit(b).alias("risk_level"), F.col(b).alias("n")) for b in bands],
        F.struct(F.lit("total").alias("risk_level"), F.col("total").alias("n")),
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def importance_rank(attributions: DataFrame, top: int | None = None, groups: list[str] | None = None) -> DataFrame:
    """``feature, importance, rank`` by mean absolute attribution, highest first."""
    means = attributions.groupBy(*(groups or []), "feature").agg(F.avg(F.abs("shap_value")).alias("importance"))
    return rank_importance(means, top, groups)


def rank_importance(means: DataFrame, top: int | None = None, groups: list[str] | None = None) -> DataFrame:
    """``rank`` by ``importance``, one row per (group, feature), highest first."""
    # One row per (model, feature): the window sees features, not rows.
    order = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(F.col("importance").desc(), F.col("feature"))
    ranked = means.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def direction_top(attributions: DataFrame, top: int = 5, groups: list[str] | None = None) -> DataFrame:
    """The strongest features towards and away from the positive class; zero in neither."""
    means = attributions.groupBy(*(groups or []), "feature").agg(F.avg("shap_value").alias("mean_value"))
    return rank_direction(means, top, groups)


def rank_direction(means: DataFrame, top: int = 5, groups: list[str] | None = None) -> DataFrame:
    """The ``top`` of either sign of ``mean_value``, one row per (group, feature)."""
    groups = groups or []
    signed = means.where(F.col("mean_value") != 0).withColumn(
        "direction", F.when(F.col("mean_value") > 0, "towards").otherwise("away")
    )
    order = Window.partitionBy(*groups, "direction").orderBy(F.abs("mean_value").desc(), F.col("feature"))
    return signed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def attribution_summary(attributions: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """``feature, mean_abs, mean_signed`` in one pass."""
    return attributions.groupBy(*(groups or []), "feature").agg(
        F.avg(F.abs("shap_value")).alias("mean_abs"), F.avg("shap_value").alias("mean_signed")
    )
