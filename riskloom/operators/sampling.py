"""Reproducible splits, folds, samples and class weights.

All draw their order from a hash of the row key, so the result does not depend
on partitioning or row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.scalars import ordering_hash
from riskloom.operators.ordering import hashed_rank

LIMIT_ROWS = 10_000


def _ranked(df: DataFrame, key: str, seed: int, groups: list[str]) -> DataFrame:
    hashed = df.withColumn("_hash", ordering_hash(F.col(key), seed))
    return hashed_rank(hashed, "_hash", groups, "_rank", "_size").drop("_hash")


def ranked_by_hash(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add ``rank``, 1 to the number of rows in hash order of ``key``."""
    return _ranked(df, key, seed, []).withColumnRenamed("_rank", "rank").drop("_size")


def random_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly ceil(share x rows) rows."""
    ranked = _ranked(df, key, seed, [])
    return ranked.select(
        *df.columns, (F.col("_rank") <= F.ceil(F.col("_size") * F.lit(test_share))).cast("int").alias("is_test")
    )


def stratified_split(
    df: DataFrame, key: str, label: str = "isFraud", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: round(share x rows) rows of each label."""
    ranked = _ranked(df, key, seed, [label])
    return ranked.select(
        *df.columns, (F.col("_rank") <= F.round(F.col("_size") * F.lit(test_share))).cast("int").alias("is_test")
    )


def stratified_kfold(df: DataFrame, key: str, label: str = "isFraud", k: int = 6, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1; per label the folds differ by at most one row."""
    ranked = _ranked(df, key, seed, [label])
    return ranked.select(*df.columns, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int").alias("fold"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows in hash order (all of them if there are fewer).

    A small sample is a top-n; a large one is cut by rank so that no task has to
    hold it.
    """
    if n <= LIMIT_ROWS:
        return df.orderBy(ordering_hash(F.col(key), seed)).limit(n)
    return _ranked(df, key, seed, []).where(F.col("_rank") <= n).select(*df.columns)


def class_weights(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """``label, n, weight`` with weight = rows / (2 x rows of the class)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per class
    return counts.select("label", "n", (total / (F.lit(2.0) * F.col("n"))).alias("weight"))


def with_class_weight(
    df: DataFrame, label: str = "isFraud", positive: float | None = None, name: str = "weight"
) -> DataFrame:
    """Add a row weight: ``positive`` against 1, or balanced when it is None."""
    if positive is not None:
        return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(positive))).otherwise(F.lit(1.0)))
    counts = {r["label"]: r["weight"] for r in class_weights(df, label).collect()}
    return df.withColumn(
        name, F.when(F.col(label) == 1, F.lit(counts.get(1, 1.0))).otherwise(F.lit(counts.get(0, 1.0)))
    )
