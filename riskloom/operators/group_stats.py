"""Per-entity statistics fitted once and looked up afterwards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import ratio, zscore
from riskloom.operators.clean import replace_columns
from riskloom.operators.lookup import BROADCAST_BYTES, lookup_join, row_bytes
from riskloom.session import materialise

# Which amounts are compared with which entity's mean and deviation.
RATIO_SPECS: dict[str, tuple[str, ...]] = {
    "TransactionAmt": ("card1", "card4"),
    "id_02": ("card1", "card4"),
    "D15": ("card1", "card4", "addr1", "addr2"),
}
FILLED_WITH_CONSTANT = ("id_02", "D15")


@dataclass
class GroupStats:
    """One table per key: ``key, n, mean_<value>, std_<value>``."""

    specs: dict[str, tuple[str, ...]]
    tables: dict[str, DataFrame]
    sizes: dict[str, int]  # bytes
    key_types: dict[str, str] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, specs: dict[str, tuple[str, ...]] | None = None) -> GroupStats:
        """All keys in one pass: grouping sets with map-side partial aggregates."""
        present = set(df.columns)
        specs = {
            value: tuple(k for k in keys if k in present)
            for value, keys in (specs or RATIO_SPECS).items()
            if value in present
        }
        keys = list(dict.fromkeys(k for ks in specs.values() for k in ks))
        if not keys:
            return cls({}, {}, {})
        aggregates: list[Column] = [F.count(F.lit(1)).alias("n")]
        for value in specs:
            number = F.col(value).cast("double")
            aggregates += [F.avg(number).alias(f"mean_{value}"), F.stddev_samp(number).alias(f"std_{value}")]
        if len(keys) == 1:
            grouped = df.groupBy(keys[0]).agg(*aggregates).withColumn("key_index", F.lit(0))
        else:
            # Bit k of grouping_id is 0 for the one key the row is grouped by.
            full = (1 << len(keys)) - 1
            index = F.create_map(
                *[x for i in range(len(keys)) for x in (F.lit(full ^ (1 << (len(keys) - 1 - i))), F.lit(i))]
            )
            grouped = (
                df.select(*keys, *[v for v in specs if v not in keys])
                .groupingSets([[F.col(k)] for k in keys], *keys)
                .agg(F.grouping_id().cast("int").alias("gid"), *aggregates)
                .withColumn("key_index", index[F.col("gid")])
                .drop("gid")
            )
        return cls.from_table(materialise(grouped), specs, keys)

    @classmethod
    def from_table(cls, stored: DataFrame, specs: dict[str, tuple[str, ...]], keys: list[str]) -> GroupStats:
        taken = stored.groupBy("key_index").agg(F.sum(row_bytes(stored)).alias("bytes")).collect()
        found = {r["key_index"]: r["bytes"] for r in taken}
        tables, sizes = {}, {}
        for i, key in enumerate(keys):
            columns = [f"{stat}_{v}" for v, ks in specs.items() if key in ks for stat in ("mean", "std")]
            tables[key] = stored.where(F.col("key_index") == i).select(key, "n", *columns)
            sizes[key] = found.get(i, 0)
        fitted = cls(specs, tables, sizes)
        fitted.stored = stored
        return fitted

    def lookup(self, df: DataFrame, key: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Rows with ``<key>__n``-free statistics columns ``<key>__mean_<value>`` added."""
        table = self.tables[key]
        renamed = table.select(
            key, "n", *[F.col(c).alias(f"{key}__{c}") for c in table.columns if c not in (key, "n")]
        )
        return lookup_join(df, renamed, key, self.sizes[key], broadcast_bytes=broadcast_bytes)

    def transform(
        self,
        df: DataFrame,
        kinds: tuple[str, ...] = ("mean", "std"),
        fill: float = -1.0,
        zscores: dict[str, tuple[str, str]] | None = None,
        broadcast_bytes: int = BROADCAST_BYTES,
    ) -> DataFrame:
        """Add ``<value>_to_<kind>_<key>`` ratios and the requested z-scores.

        Ratios of the values in ``FILLED_WITH_CONSTANT`` have ``fill`` where the
        divisor is zero or unknown; the others stay NULL for the median fill.
        ``zscores`` maps an output name to (value, key).
        """
        original = list(df.columns)
        for key in self.tables:
            df = self.lookup(df, key, broadcast_bytes)
        new: dict[str, Column] = {}
        for kind in kinds:
            for value, keys in self.specs.items():
                for key in keys:
                    quotient = ratio(F.col(value), F.col(f"{key}__{kind}_{value}"))
                    if value in FILLED_WITH_CONSTANT:
                        quotient = F.coalesce(quotient, F.lit(fill))
                    new[f"{value}_to_{kind}_{key}"] = quotient
        for name, (value, key) in (zscores or {}).items():
            new[name] = zscore(
                F.col(value).cast("double"), F.col(f"{key}__mean_{value}"), F.col(f"{key}__std_{value}")
            )
        return replace_columns(df, new).select(*original, *new)

    def save(self, path: str) -> None:
        self.stored.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, specs: dict[str, tuple[str, ...]]) -> GroupStats:
        keys = list(dict.fromkeys(k for ks in specs.values() for k in ks))
        if not keys:
            return cls({}, {}, {})
        return cls.from_table(spark.read.parquet(path), specs, keys)


def group_mean_std(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n, mean, std`` of one value."""
    number = F.col(value).cast("double")
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(number).alias("mean"), F.stddev_samp(number).alias("std")
    )
