"""Exact ranks and running totals without a single-partition window.

Rows get a bucket that grows with the order key: the first digits of a hash, or the
range of a distributed sort. Bucket totals form a small table (at most
16**HASH_DIGITS rows, or one per range, for each group) whose running sum is
broadcast back; the ordered window then runs inside one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.session import materialise

HASH_DIGITS = 4


def hashed_rank(
    df: DataFrame,
    order_hash: str,
    groups: list[str] | None = None,
    rank: str = "rank",
    size: str = "group_size",
) -> DataFrame:
    """Add the 1-based ``rank`` of a hex hash, and the ``size``, within ``groups``.

    ``groups`` must have few combinations (a label): the bucket table has at most
    16**HASH_DIGITS rows for each. The hash spreads rows evenly over the buckets
    as long as it comes from a unique key, so no bucket is hot.
    """
    groups = groups or []
    bucketed = df.withColumn("_bucket", F.substring(order_hash, 1, HASH_DIGITS))
    counts = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    offsets = counts.select(
        *groups,
        "_bucket",
        (F.sum("_n").over(by_group.orderBy("_bucket")) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(by_group).alias(size),
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(order_hash)
    return (
        bucketed.join(F.broadcast(offsets), [*groups, "_bucket"])
        .withColumn(rank, F.col("_offset") + F.row_number().over(inside))
        .select(*df.columns, rank, size)
    )


def running_totals(
    df: DataFrame,
    score: str,
    values: list[str],
    groups: list[str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``upto_<value>`` (running sum by score, ties must be grouped before) and ``total_<value>``.

    The rows are sorted once over all tasks and written; a range of scores is a bucket.
    Equal scores never part, and no range depends on how scores are spread. The table of
    bucket totals has one row per range and group.
    """
    groups = groups or []
    in_order = materialise(df.orderBy(score).withColumn("_id", F.monotonically_increasing_id()))
    bucketed = in_order.withColumn("_bucket", F.shiftright(F.col("_id"), 33)).drop("_id")

    def order(column: str):
        return F.col(column).desc() if descending else F.col(column).asc()

    sums = bucketed.groupBy(*groups, "_bucket").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    offsets = sums.select(
        *groups,
        "_bucket",
        *[
            (F.sum(f"_sum_{v}").over(by_group.orderBy(order("_bucket"))) - F.col(f"_sum_{v}")).alias(f"_offset_{v}")
            for v in values
        ],
        *[F.sum(f"_sum_{v}").over(by_group).alias(f"total_{v}") for v in values],
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(order(score))
    return (
        bucketed.join(F.broadcast(offsets), [*groups, "_bucket"])
        .withColumns({f"upto_{v}": F.col(f"_offset_{v}") + F.sum(v).over(inside) for v in values})
        .select(*df.columns, *[f"upto_{v}" for v in values], *[f"total_{v}" for v in values])
    )


def sorted_position(df: DataFrame, order_by: list[str], name: str = "position") -> DataFrame:
    """0-based position of each row in the total order by ``order_by``, for any type.

    A distributed sort is written once; a row's id then holds its partition and
    its place in it, and the partition sizes give the offsets.
    """
    in_order = materialise(df.orderBy(*order_by).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_id"), 33)
    sizes = in_order.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", running.alias("_offset"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        in_order.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within)
        .select(*df.columns, name)
    )
