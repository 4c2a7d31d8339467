"""Projections and filters: names, fills, dropped columns, keep-first."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import finite


def rename_columns(df: DataFrame) -> DataFrame:
    """``id-01`` becomes ``id_01``; other names are kept."""
    return df.toDF(*[c.replace("id-", "id_") if c.startswith("id-") else c for c in df.columns])


def columns_with_prefix(df: DataFrame, prefix: str = "V") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """One projection that swaps the given columns in place and adds new ones."""
    kept = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns]
    added = [new[c].alias(c) for c in new if c not in set(df.columns)]
    return df.select(*kept, *added)


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def fill_constant(
    df: DataFrame, text: str = "missing", number: float = -1, exclude: Iterable[str] = ()
) -> DataFrame:
    """NULL (and NaN) by type: strings get ``text``, numbers ``number``."""
    strings, numbers = string_columns(df, exclude), numeric_columns(df, exclude)
    if strings:
        df = df.na.fill(text, strings)
    if numbers:
        df = df.na.fill(number, numbers)
    return df


def fill_median(
    df: DataFrame,
    columns: list[str] | None = None,
    medians: Mapping[str, float | None] | None = None,
    text: str | None = "missing",
    exclude: Iterable[str] = (),
) -> DataFrame:
    """NULL numbers become their column's exact median, NULL strings ``text``."""
    from riskloom.operators.profile import exact_medians

    columns = columns if columns is not None else numeric_columns(df, exclude)
    if medians is None:
        medians = exact_medians(df, columns)
    known = {c: float(medians[c]) for c in columns if medians.get(c) is not None}
    filled = replace_columns(
        df, {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) for c, m in known.items()}
    )
    strings = string_columns(df, exclude)
    return filled.na.fill(text, strings) if text is not None and strings else filled


def fill_nonfinite_median(
    df: DataFrame,
    columns: list[str] | None = None,
    medians: Mapping[str, float | None] | None = None,
    default: float = -1.0,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """NaN, infinities and NULL become the median of the finite values.

    A column without any finite value becomes ``default``.
    """
    from riskloom.operators.profile import exact_medians

    columns = columns if columns is not None else numeric_columns(df, exclude)
    if medians is None:
        medians = exact_medians(df, columns)
    return replace_columns(
        df,
        {
            c: F.coalesce(finite(F.col(c)), F.lit(default if medians.get(c) is None else float(medians[c])))
            for c in columns
        },
    )


def fill_nonfinite(df: DataFrame, columns: Iterable[str], value: float = -1.0) -> DataFrame:
    """NaN, infinities and NULL become one constant."""
    return replace_columns(df, {c: F.coalesce(finite(F.col(c)), F.lit(value)) for c in columns})


def missing_share(df: DataFrame, column: str) -> Column:
    """Share of rows without a value: NULL, in a column of floats also NaN."""
    value = F.col(f"`{column}`")
    gone = value.isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        gone = gone | F.isnan(value)
    return F.avg(gone.cast("int"))


def sparse_columns(df: DataFrame, threshold: float = 0.9, exclude: Iterable[str] = ()) -> list[str]:
    """Columns whose share of missing values is above ``threshold``; one aggregate over all."""
    skip = set(exclude)
    names = [c for c in df.columns if c not in skip]
    shares = df.agg(*[missing_share(df, c).alias(str(i)) for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if (shares[i] or 0.0) > threshold]


def flat_columns(df: DataFrame, threshold: float = 1e-3, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns whose sample deviation is below ``threshold``."""
    names = numeric_columns(df, exclude)
    if not names:
        return []
    stds = df.agg(*[F.stddev_samp(finite(F.col(c))).alias(str(i)) for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if stds[i] is not None and stds[i] < threshold]


def drop_sparse(df: DataFrame, threshold: float = 0.9, exclude: Iterable[str] = ()) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold, exclude))


def drop_flat(df: DataFrame, threshold: float = 1e-3, exclude: Iterable[str] = ()) -> DataFrame:
    return df.drop(*flat_columns(df, threshold, exclude))


def conform(df: DataFrame, features: list[str], keep: Iterable[str] = (), default: float = -1.0) -> DataFrame:
    """Exactly ``keep`` + ``features`` in that order; absent features are ``default``."""
    present = set(df.columns)
    return df.select(
        *[F.col(c) for c in keep],
        *[F.col(c) if c in present else F.lit(default).alias(c) for c in features],
    )


def missing_features(df: DataFrame, features: DataFrame, name: str = "feature") -> DataFrame:
    """Required feature names that ``df`` does not have."""
    spark = df.sparkSession
    have = spark.createDataFrame([(c,) for c in df.columns], f"{name} string")
    return features.select(name).join(have, name, "left_anti")


def dedup_keep_first(df: DataFrame, key: str | list[str], order_by: list[str] | None = None) -> DataFrame:
    """The first row per key under a stated order.

    Keys alone are counted first; rows of keys that occur once pass through, and only
    those of repeated keys are reduced, with ``min_by``, which combines on the map
    side, so a key that holds a large share of the rows never meets in one task. Without ``order_by`` the
    file position is used where the reader added it, else all other columns.
    """
    from riskloom.sources.tables import ROW_ORDER

    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    if order_by is None:
        order_by = [ROW_ORDER] if ROW_ORDER in rest else rest
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    order = F.struct(*[F.col(f"`{c}`") for c in order_by])
    marked = df.withColumn("_keys", F.struct(*[F.col(f"`{c}`") for c in keys]))
    repeated = marked.groupBy("_keys").count().where(F.col("count") > 1).select("_keys")
    once = marked.join(repeated, "_keys", "left_anti").drop("_keys")
    first = marked.join(repeated, "_keys", "left_semi").groupBy(*keys).agg(F.min_by(row, order).alias("_first"))
    return once.select(*df.columns).union(
        first.select(*[F.col(c) if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns])
    )
