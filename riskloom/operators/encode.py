"""Label codes, frequencies and scaling, each with fitted state."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import finite
from riskloom.operators.clean import numeric_columns, replace_columns, string_columns
from riskloom.operators.lookup import BROADCAST_BYTES, lookup_join, row_bytes
from riskloom.operators.ordering import sorted_position
from riskloom.operators.profile import narrow_frequencies, value_frequencies
from riskloom.session import materialise

INLINE_VALUES = 64


@dataclass
class LabelEncoder:
    """Sorted distinct strings become 0..k-1 per column; unseen strings -1."""

    columns: list[str]
    table: DataFrame  # feature, value, n, code
    sizes: dict[str, int]  # distinct values
    bytes: dict[str, int]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] | None = None) -> LabelEncoder:
        columns = columns if columns is not None else string_columns(df)
        if not columns:
            return cls([], df.sparkSession.createDataFrame([], "feature string, value string, n long, code long"), {}, {})
        placed = sorted_position(value_frequencies(df, columns), ["feature", "value"])
        first = placed.groupBy("feature").agg(F.min("position").alias("first"))
        coded = placed.join(F.broadcast(first), "feature").select(
            "feature", "value", "n", (F.col("position") - F.col("first")).alias("code")
        )
        return cls.from_table(materialise(coded), columns)

    @classmethod
    def from_table(cls, table: DataFrame, columns: list[str]) -> LabelEncoder:
        counts = table.groupBy("feature").agg(F.count("*").alias("n"), F.sum(row_bytes(table)).alias("bytes"))
        found = counts.collect() if columns else []
        return cls(columns, table, {r["feature"]: r["n"] for r in found}, {r["feature"]: r["bytes"] for r in found})

    def transform(
        self, df: DataFrame, suffix: str = "", unseen: int = -1, broadcast_bytes: int = BROADCAST_BYTES
    ) -> DataFrame:
        """Replace each column by its code, or add ``<column><suffix>``."""
        columns = [c for c in self.columns if c in df.columns]
        small = [c for c in columns if self.sizes.get(c, 0) <= INLINE_VALUES]
        order = list(df.columns)
        maps = _inline_maps(self.table.where(F.col("feature").isin(small)), "code") if small else {}
        new: dict[str, Column] = {
            c + suffix: F.coalesce(_from_map(maps.get(c), F.col(c), "long"), F.lit(unseen).cast("long")) for c in small
        }
        for c in columns:
            if c in small:
                continue
            codes = self.table.where(F.col("feature") == c).select(
                F.col("value").alias(c), "n", F.col("code").alias(f"_code_{c}")
            )
            df = lookup_join(df, codes, c, self.bytes[c], broadcast_bytes=broadcast_bytes)
            new[c + suffix] = F.coalesce(F.col(f"_code_{c}"), F.lit(unseen).cast("long"))
        return replace_columns(df, new).select(*order, *[c for c in new if c not in order])


@dataclass
class FrequencyEncoder:
    """``<column>_freq``: how often the value occurred where the encoder was fitted.

    Only columns with fewer than ``limit`` values are encoded, so each map is
    bounded by ``limit`` entries and is part of the expression.
    """

    columns: list[str]
    table: DataFrame  # feature, value, n
    types: dict[str, str]
    limit: int = 50

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] | None = None, limit: int = 50) -> FrequencyEncoder:
        columns = columns if columns is not None else list(df.columns)
        table = materialise(narrow_frequencies(df, columns, limit))
        found = {r["feature"] for r in table.select("feature").distinct().collect()}
        types = dict(df.dtypes)
        kept = [c for c in columns if c in found]
        return cls(kept, table, {c: types[c] for c in kept}, limit)

    def transform(self, df: DataFrame) -> DataFrame:
        maps = _inline_maps(self.table, "n")
        # Cast to the fitted type first: 5 and 5.0 are one value but two texts.
        return replace_columns(
            df,
            {
                f"{c}_freq": _from_map(maps.get(c), F.col(c).try_cast(self.types[c]).cast("string"), "long")
                for c in self.columns
                if c in df.columns
            },
        )


def _inline_maps(table: DataFrame, column: str) -> dict[str, list[tuple[str, int]]]:
    maps: dict[str, list[tuple[str, int]]] = {}
    for r in table.select("feature", "value", column).collect():
        maps.setdefault(r["feature"], []).append((r["value"], r[column]))
    return {f: sorted(pairs) for f, pairs in maps.items()}


def _from_map(pairs: list[tuple[str, int]] | None, key: Column, type_name: str) -> Column:
    """A bounded lookup inside the expression; the JSON text is folded into a map literal."""
    if not pairs:
        return F.lit(None).cast(type_name)
    return F.from_json(F.lit(json.dumps(dict(pairs))), f"map<string,{type_name}>")[key]


@dataclass
class StandardScaler:
    """Mean 0 and unit population deviation; a constant column is only centred."""

    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit_complete(cls, df: DataFrame, columns: list[str]) -> StandardScaler:
        """Fit on columns without missing values: one vector aggregate for all of them."""
        vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(df.select(*columns))
        row = vectors.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()["s"]
        n = row["count"]
        population = (n - 1) / n if n > 1 else 1.0
        mean = {c: float(m) for c, m in zip(columns, row["mean"], strict=True)}
        std = {c: float(v * population) ** 0.5 or 1.0 for c, v in zip(columns, row["variance"], strict=True)}
        return cls(mean, std)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] | None = None) -> StandardScaler:
        columns = columns or numeric_columns(df)
        row = df.agg(
            *[F.avg(finite(F.col(c))).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(finite(F.col(c))).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        mean = {c: row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i, c in enumerate(columns)}
        std = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)}
        return cls(mean, std)

    def transform(self, df: DataFrame) -> DataFrame:
        return replace_columns(
            df,
            {
                c: (F.col(c).cast("double") - F.lit(self.mean[c])) / F.lit(self.std[c])
                for c in self.mean
                if c in df.columns
            },
        )

    def state(self) -> str:
        return json.dumps({"mean": self.mean, "std": self.std})

    @classmethod
    def from_state(cls, text: str) -> StandardScaler:
        return cls(**json.loads(text))


@dataclass
class MinMaxScaler:
    """Range [0, 1]; a constant column becomes 0."""

    low: dict[str, float]
    high: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] | None = None) -> MinMaxScaler:
        columns = columns or numeric_columns(df)
        row = df.agg(
            *[F.min(finite(F.col(c))).alias(f"a{i}") for i, c in enumerate(columns)],
            *[F.max(finite(F.col(c))).alias(f"b{i}") for i, c in enumerate(columns)],
        ).first()
        return cls(
            {c: row[f"a{i}"] if row[f"a{i}"] is not None else 0.0 for i, c in enumerate(columns)},
            {c: row[f"b{i}"] if row[f"b{i}"] is not None else 0.0 for i, c in enumerate(columns)},
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return replace_columns(
            df,
            {
                c: (F.col(c).cast("double") - F.lit(self.low[c])) / F.lit((self.high[c] - self.low[c]) or 1.0)
                for c in self.low
                if c in df.columns
            },
        )

    @classmethod
    def fit_after(cls, scaler: StandardScaler, df: DataFrame, columns: list[str]) -> MinMaxScaler:
        """Fit on the scaled columns; the scaling is only an expression in the scan."""
        return cls.fit(scaler.transform(df.select(*columns)), columns)


def load_label_encoder(spark: SparkSession, path: str, columns: list[str]) -> LabelEncoder:
    return LabelEncoder.from_table(spark.read.parquet(path), columns)
