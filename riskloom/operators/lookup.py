"""Joining a fitted table back to rows, whichever values the rows crowd on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table of up to so many bytes is broadcast; measured, not estimated.
BROADCAST_BYTES = 64 << 20
#: A value held by one in so many rows is hot, so there are no more hot values than that.
HOT_SHARE = 1_000
#: Values the counter of hot values tracks at a time.
TRACKED = 16 * HOT_SHARE
SALTS = 4_096
_FIXED = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4}


def row_bytes(df: DataFrame) -> Column:
    """Bytes a row takes in memory: 8 a column and what texts and arrays hold."""
    parts = [F.lit(16)]
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(column), F.lit(0)) + 8)
        elif kind.startswith("array"):
            parts.append(F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * 8 + 16)
        else:
            parts.append(F.lit(_FIXED.get(kind, 8)))
    return sum(parts[1:], parts[0]).cast("long")


def table_bytes(df: DataFrame) -> int:
    """What ``df`` takes when it is broadcast, added up in one aggregate."""
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]


def hot_values(df: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """Values of ``key`` that at least one in ``share`` rows of ``df`` holds.

    One pass over the column with a mergeable counter of bounded size. Only values within
    its error of the share (about 1 in 10,000 rows) may be named or left out wrongly.
    """
    counted = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("v"))
    found = counted.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(v, {share}, {TRACKED})").alias("top")).first()
    return [e["item"] for e in found["top"] or [] if e["count"] * share >= found["n"]]


def split_join(df: DataFrame, table: DataFrame, key: str, hot: str) -> DataFrame:
    """Left join on a unique ``key``; rows of ``table`` with a true ``hot`` are broadcast, others shuffled.

    ``hot`` must hold for a bounded number of rows. Rows served by the broadcast, and rows
    without a key, are spread over salts in the shuffle.
    """
    columns = [c for c in table.columns if c not in (key, hot)]
    packed = F.struct(*[F.col(f"`{c}`") for c in columns])
    warm = table.where(F.col(hot)).select(key, packed.alias("_hot"))
    # zero, but not to the optimiser: it would move a constant out of the join keys, and the salts with it
    zero = F.pmod(F.hash(F.col(f"`{key}`")), F.lit(1)).alias("_salt")
    cold = table.where(~F.coalesce(F.col(hot), F.lit(False))).select(key, packed.alias("_cold"), zero)
    settled = F.col("_hot").isNotNull() | F.col(f"`{key}`").isNull()
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int") + 1
    joined = (
        df.join(F.broadcast(warm), key, "left")
        .withColumn("_salt", F.when(settled, spread).otherwise(F.lit(0)))
        .join(cold.hint("shuffle_merge"), [key, "_salt"], "left")
    )
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.coalesce(F.col(f"_hot.`{c}`"), F.col(f"_cold.`{c}`")).alias(c) for c in columns],
    )


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    key: str,
    size: int | None = None,
    weight: str | None = "n",
    broadcast_bytes: int = BROADCAST_BYTES,
    count_rows: bool = True,
) -> DataFrame:
    """Left join on a unique ``key``; ``size`` is ``table_bytes(table)`` where it is known already.

    Up to ``broadcast_bytes`` the table is broadcast and ``df`` does not move. Above it,
    the values that crowd ``df`` itself, and those that crowded the rows the table was
    fitted on (by ``weight``), are broadcast - some ``2 * HOT_SHARE`` rows at most -
    and only the others meet in a shuffle. A value never seen when the table was fitted
    needs a row there too: it is joined as known to be absent, so it stays spread. The
    rows of a stream cannot be counted ahead; it goes by the fitted weights alone, as does
    ``count_rows=False`` (where ``weight`` counts the rows of ``df`` itself).
    """
    columns = [c for c in table.columns if c not in (key, weight)]
    if (table_bytes(table) if size is None else size) <= broadcast_bytes:
        return df.join(F.broadcast(table.select(key, *columns)), key, "left")
    hot = F.lit(False)
    if weight is not None:
        total = table.agg(F.sum(weight)).first()[0] or 0
        hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    marked = table.select(key, *columns, F.coalesce(hot, F.lit(False)).alias("_is_hot"))
    if count_rows and not df.isStreaming:
        crowded = hot_values(df, key)
        if crowded:
            kind = table.schema[key].dataType.simpleString()
            named = df.sparkSession.createDataFrame([(v,) for v in crowded], f"{key} {df.schema[key].dataType.simpleString()}")
            named = named.select(F.col(key).cast(kind).alias(key), F.lit(True).alias("_crowded"))
            marked = marked.join(F.broadcast(named), key, "full").withColumn("_is_hot", F.coalesce("_crowded", "_is_hot")).drop("_crowded")
    return split_join(df, marked, key, "_is_hot")
