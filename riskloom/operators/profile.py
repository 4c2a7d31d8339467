"""Column profiles, value counts, exact medians and correlations.

Every function looks at all requested columns in the same pass; none starts a
job per column.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.scalars import finite
from riskloom.operators.clean import missing_share, numeric_columns


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``feature, n_rows, null_share, mean, std`` for numeric columns."""
    columns = columns or numeric_columns(df)
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[missing_share(df, c).alias(f"null_{i}") for i, c in enumerate(columns)],
        *[F.avg(finite(F.col(c))).alias(f"mean_{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(finite(F.col(c))).alias(f"std_{i}") for i, c in enumerate(columns)],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.col("n").alias("n_rows"),
                    F.col(f"null_{i}").alias("null_share"),
                    F.col(f"mean_{i}").alias("mean"),
                    F.col(f"std_{i}").alias("std"),
                )
                for i, c in enumerate(columns)
            ]
        )
    ).alias("r")
    return wide.select(rows).select("r.*")


def class_ratio(df: DataFrame, label: str = "isFraud") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(label)).alias("positive_ratio"))


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, value, n``: occurrences of each non-NULL value, as text.

    One scan; the counts combine on the map side before the shuffle.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy(F.col("p.feature").alias("feature"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _maybe_narrow(df: DataFrame, columns: list[str], limit: int) -> list[str]:
    """Columns that may have fewer than ``limit`` values, by a sketch.

    The sketch's deviation is 5 %, so twice the limit rules out only columns
    that are wide beyond doubt; the exact count decides on the rest.
    """
    if not columns:
        return []
    sizes = df.agg(*[F.approx_count_distinct(c).alias(str(i)) for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if sizes[i] <= 2 * limit]


def narrow_frequencies(df: DataFrame, columns: list[str] | None = None, limit: int = 50) -> DataFrame:
    """``feature, value, n`` of the columns with fewer than ``limit`` distinct values."""
    columns = columns or list(df.columns)
    maybe = _maybe_narrow(df, columns, limit)
    if not maybe:
        return df.sparkSession.createDataFrame([], "feature string, value string, n long")
    counts = value_frequencies(df, maybe)
    kept = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct")).where(F.col("n_distinct") < limit)
    return counts.join(F.broadcast(kept.select("feature")), "feature", "left_semi")


def distinct_counts(df: DataFrame, columns: list[str] | None = None, limit: int = 50) -> DataFrame:
    """``feature, n_distinct, categorical``; categorical columns have 1 to ``limit`` - 1 values.

    Every column is counted exactly, each value once per map task.
    """
    columns = columns or list(df.columns)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    counted = value_frequencies(df, columns).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return names.join(counted, "feature", "left").select(
        "feature", n.alias("n_distinct"), ((n > 0) & (n < limit)).alias("categorical")
    )


def exact_medians(df: DataFrame, columns: list[str] | None = None, bins: int = 2048) -> dict[str, float | None]:
    """Exact medians of the finite values (mean of the middle two), many columns at once.

    Each pass counts values by bin, combined on the map side, and goes on inside the
    bin that holds the middle, for all open columns together. A task sends at most
    ``bins`` rows a column, whatever the data. The range shrinks by ``bins`` each pass
    and its ends never share a bin, so every column ends at single values.
    """
    columns = columns or numeric_columns(df)
    if not columns:
        return {}
    values = df.select(*[finite(F.col(c)).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    ends = values.agg(
        *[f(f"v{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]
    ).first()
    result: dict[str, float | None] = {c: None for i, c in enumerate(columns) if not ends[f"n{i}"]}
    ranks = {i: ((n + 1) // 2, n // 2 + 1) for i in range(len(columns)) if (n := ends[f"n{i}"])}
    # per open column: least and largest value left, and how many values are below them
    open_ = {i: (ends[f"low{i}"], ends[f"high{i}"], 0) for i in ranks}
    while True:
        for i in [i for i, (low, high, _) in open_.items() if low == high]:
            result[columns[i]] = open_.pop(i)[0]
        if not open_:
            return result
        found: dict[int, dict[int, tuple]] = {}
        for r in _middle_bins(values, open_, ranks, bins).collect():
            for place, k in enumerate(ranks[r["i"]]):
                if r["below"] < k <= r["below"] + r["n"]:
                    found.setdefault(r["i"], {})[place] = (r["low"], r["high"], r["below"])
        for i, (first, second) in ((i, (f[0], f[1])) for i, f in found.items()):
            if first == second:
                open_[i] = first
            else:  # the middle two are the last of one bin and the first of the next
                result[columns[i]] = (first[1] + second[0]) / 2.0
                del open_[i]


def _middle_bins(values: DataFrame, open_: dict, ranks: dict, bins: int) -> DataFrame:
    """``i, low, high, n, below`` of the one or two bins of each open column that hold its middle."""

    def placed(i: int, low: float, high: float):
        # steps that keep the order of doubles: scaling, log1p by sign, a linear cut
        factor = 2.0**600 if max(abs(low), abs(high)) < 1e-150 else 1.0
        linear = low * high > 0 and max(abs(low), abs(high)) <= 2 * min(abs(low), abs(high))

        def at(v):
            scaled = v * F.lit(factor)
            return scaled if linear else F.signum(scaled) * F.log1p(F.abs(scaled))

        v, start = F.col(f"v{i}"), at(F.lit(low))
        width = at(F.lit(high)) - start
        bin_ = F.floor((at(v) - start) / width * F.lit(float(bins))).cast("int")
        return F.when(v.between(F.lit(low), F.lit(high)), F.struct(F.lit(i).alias("i"), bin_.alias("bin"), v.alias("v")))

    each = F.array_compact(F.array(*[placed(i, low, high) for i, (low, high, _) in open_.items()]))
    counted = (
        values.select(F.explode(each).alias("c"))
        .groupBy("c.i", "c.bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("c.v").alias("low"), F.max("c.v").alias("high"))
    )
    wanted = values.sparkSession.createDataFrame(
        [(i, below, *ranks[i]) for i, (_, _, below) in open_.items()], "i int, start long, k1 long, k2 long"
    )
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("bin"))
    ranked = counted.withColumn("upto", upto).join(F.broadcast(wanted), "i").withColumn("below", F.col("start") + F.col("upto") - F.col("n"))
    holds = [(F.col("below") < F.col(k)) & (F.col(k) <= F.col("below") + F.col("n")) for k in ("k1", "k2")]
    return ranked.where(holds[0] | holds[1]).select("i", "low", "high", "n", "below")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None):
    """Pearson correlations as a columns x columns array; NaN for constants.

    Rows with a NULL must be cleaned first.
    """
    columns = columns or numeric_columns(df)
    vectors = VectorAssembler(inputCols=columns, outputCol="_features").transform(df.select(*columns))
    return columns, Correlation.corr(vectors, "_features").head()[0].toArray()


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``feature_i, feature_j, position_i, position_j, r`` for i before j.

    NULL where a column is constant. The table has columns² / 2 rows, whatever
    the number of input rows.
    """
    columns, matrix = correlation_matrix(df, columns)
    rows = [
        (columns[i], columns[j], i, j, None if matrix[i, j] != matrix[i, j] else float(matrix[i, j]))
        for j in range(len(columns))
        for i in range(j)
    ]
    return df.sparkSession.createDataFrame(
        rows, "feature_i string, feature_j string, position_i int, position_j int, r double"
    )
