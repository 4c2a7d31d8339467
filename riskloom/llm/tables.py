"""Small helpers the operators share: reading, row-wise Arrow maps, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import materialise


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain_names(df: DataFrame, replaced: Iterable[str] = ()) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``df`` under names that clash with none of the operators' own and hold no dot.

    Returns it, the new name of each column, and the columns in order. Columns named in
    ``replaced``, which the operator makes itself, are left out.
    """
    columns = [c for c in df.columns if c not in set(replaced)]
    named = {c: f"_column_{i}" for i, c in enumerate(columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]), named, columns


def texts_of(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one by one, null as empty."""
    for value in column:
        text = value.as_py()
        yield "" if text is None else text


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``; no row moves between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node of the component of every node that has an edge.

    ``edges`` has long columns ``a`` and ``b``. Alternates two star steps: each node
    hangs its larger neighbours on the smallest one it sees, then itself and its
    smaller ones. Both are an aggregate with map-side combining and a join on the
    node, so a node with very many neighbours is split like any skewed join key.
    Every round is a written table; the rounds grow with the logarithm of the
    longest path. Returns ``node``, ``root`` (roots themselves are included).
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))

    edges = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(rounds):
        pairs = both(edges)
        large = pairs.join(least(pairs), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = least(large)
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        edges = materialise(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
