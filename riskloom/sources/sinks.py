"""Writers whose column layout is a contract."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, format: str = "csv", partition_by: list[str] | None = None) -> None:
    """Parallel write; CSV gets a header. Floats keep full precision."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def prediction_rows(df: DataFrame, label: str = "isFraud", predicted: str = "predicted_label", score: str = "fraud_probability") -> DataFrame:
    return df.select(
        F.col(label).alias("true_label"), F.col(predicted).alias("predicted_label"), F.col(score).alias("fraud_probability")
    )


def submission_rows(df: DataFrame, key: str = "TransactionID", score: str = "fraud_probability") -> DataFrame:
    return df.select(key, F.col(score).alias("isFraud"))


def export_rows(df: DataFrame, key: str = "TransactionID", score: str = "fraud_probability", threshold: float = 0.5) -> DataFrame:
    """``TransactionID, fraud_probability, is_fraud, risk_level``; is_fraud is a strict ``>``."""
    from riskloom.functions.scalars import risk_band

    p = F.col(score)
    return df.select(
        key, p.alias("fraud_probability"), (p > F.lit(threshold)).alias("is_fraud"), risk_band(p).alias("risk_level")
    )


def meta_rows(meta: DataFrame, models: list[str], label: str = "isFraud") -> tuple[DataFrame, DataFrame]:
    """The two meta-training tables, ``model_i_pred`` and ``model_i_prob``, with their fold."""
    tables = []
    for kind in ("pred", "prob"):
        columns = [F.col(f"{m}_{kind}").alias(f"model_{i}_{kind}") for i, m in enumerate(models)]
        tables.append(meta.select("fold", *columns, F.col(label).alias("true_label")))
    return tables[0], tables[1]


def write_meta(meta: DataFrame, models: list[str], path: str, label: str = "isFraud") -> None:
    predictions, probabilities = meta_rows(meta, models, label)
    write_table(predictions, f"{path}/meta_train_pred", "parquet", ["fold"])
    write_table(probabilities, f"{path}/meta_train_prob", "parquet", ["fold"])


def write_importance(importance: DataFrame, path: str, format: str = "parquet") -> None:
    """``feature, importance`` per model, most important first, one folder per model."""
    rows = importance.select("model", "feature", "importance")
    write_table(rows.repartition("model").sortWithinPartitions("model", F.desc("importance"), "feature"), path, format, ["model"])


def single_model_rows(scored: DataFrame, key: str = "TransactionID") -> DataFrame:
    """``TransactionID, y_pred, proba_0, proba_1`` with the real id."""
    p = vector_to_array(F.col("probability"))
    return scored.select(key, F.col("prediction").cast("int").alias("y_pred"), p[0].alias("proba_0"), p[1].alias("proba_1"))


def params_row(spark: SparkSession, model: str, params: Mapping[str, object]) -> DataFrame:
    return spark.createDataFrame([(model, json.dumps(dict(params), sort_keys=True))], "model string, params string")


def write_report(report: DataFrame, params: DataFrame, path: str) -> None:
    """Per-class report as one table, parameters as JSON text."""
    write_table(report, f"{path}/report", "csv")
    write_table(params, f"{path}/params", "json")
