"""Fewer columns: principal components of a block, correlated columns."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.feature import StandardScaler as Centre
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.profile import correlation_matrix


@dataclass
class BlockPCA:
    """Centred projection of a block of columns on its first components.

    The sign of a component is fixed: its largest weight is positive.
    """

    columns: list[str]
    model: PipelineModel
    signs: list[float]
    prefix: str = "V_PCA_"

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], k: int = 5, prefix: str = "V_PCA_") -> BlockPCA:
        k = min(k, len(columns))
        assembler = VectorAssembler(inputCols=columns, outputCol="_block")
        block = assembler.transform(df.select(*columns)).select("_block")
        centre = Centre(withMean=True, withStd=False, inputCol="_block", outputCol="_centred").fit(block)
        pca = PCA(k=k, inputCol="_centred", outputCol="_scores").fit(centre.transform(block))
        weights = pca.pc.toArray()
        signs = np.sign(weights[np.abs(weights).argmax(axis=0), np.arange(k)])
        return cls(columns, PipelineModel([assembler, centre, pca]), [float(s) or 1.0 for s in signs], prefix)

    def transform(self, df: DataFrame, drop: bool = True) -> DataFrame:
        kept = [c for c in df.columns if not (drop and c in set(self.columns))]
        scores = vector_to_array(F.col("_scores"))
        return (
            self.model.transform(df)
            .withColumn("_s", scores)
            .select(
                *kept,
                *[(F.col("_s")[i] * F.lit(s)).alias(f"{self.prefix}{i + 1}") for i, s in enumerate(self.signs)],
            )
        )

    @property
    def explained_variance_ratio(self) -> list[float]:
        return [float(v) for v in self.model.stages[2].explainedVariance]

    def state(self) -> str:
        return json.dumps({"columns": self.columns, "signs": self.signs, "prefix": self.prefix})

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, state: str) -> BlockPCA:
        return cls(model=PipelineModel.load(path), **json.loads(state))


def block_from_array(df: DataFrame, column: str, size: int, prefix: str = "V") -> DataFrame:
    """Spread an array column over ``size`` double columns."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, *[F.col(column)[i].cast("double").alias(f"{prefix}{i + 1}") for i in range(size)])


def correlated_columns(df: DataFrame, columns: list[str], threshold: float = 0.85) -> list[str]:
    """Columns with |r| above the threshold to any earlier column, dropped or not."""
    columns, matrix = correlation_matrix(df, columns)
    strong = np.abs(np.nan_to_num(matrix)) > threshold
    return [c for j, c in enumerate(columns) if strong[:j, j].any()]


def drop_correlated(df: DataFrame, columns: list[str], threshold: float = 0.85) -> DataFrame:
    return df.drop(*correlated_columns(df, columns, threshold))


def drop_correlated_wide(
    df: DataFrame, columns: list[str], threshold: float = 0.8, min_distinct: int = 55
) -> list[str]:
    """Selected features of the single-model runs: numeric columns with at least
    ``min_distinct`` values that do not correlate with an earlier such column."""
    from riskloom.operators.profile import distinct_counts

    narrow = {
        r["feature"] for r in distinct_counts(df, columns, min_distinct).where("categorical").select("feature").collect()
    }
    wide = [c for c in columns if c not in narrow]
    if not wide:
        return []
    dropped = set(correlated_columns(df, wide, threshold))
    return [c for c in wide if c not in dropped]
