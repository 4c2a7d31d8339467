"""Exact k nearest neighbours and synthetic minority rows.

Rows that are equal are first folded into one (with their k+1 lowest ids), so a
large group of copies costs one row. The distinct rows are cut into cells: those of few
dimensions into the leaves of a tree of cuts, whose number grows with theirs, so that a
row visits about as many in a large table as in a small one; wider ones around pivot
rows, whose number grows with the root of theirs. A cell over a block's size is cut into
several. A block alone gives each row an upper bound on its k-th distance; the bounds of
the leaves, or the triangle inequality, then name the cells that can hold anything
closer, and the row visits only those. Nothing is dropped: a row for which no cell can
be ruled out visits all of them.

Where the bound rules out little (many dimensions), ``mode="hashed"`` compares rows that
share a bucket of Euclidean hash tables instead (Datar et al.): random projections cut
into stretches. It may miss a neighbour, never names a wrong distance.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.lookup import lookup_join
from riskloom.session import materialise

BLOCK_ROWS = 2_048
#: Dimensions up to which vectors are cut by a tree, sampled rows that stand for a leaf, leaves at most.
NARROW, LEAF_SAMPLE, LEAVES = 12, 16, 32_768
#: Hash tables, projections in each, stretch in typical k-th distances, rows that tell them.
TABLES, PROJECTIONS, STRETCH, SCALE_ROWS = 20, 8, 4.0, 1_024
#: Synthetic rows made from one minority row in one go.
DRAWS = 1_024
_SLACK = 1e-9

# Executors need no copy of this package: the batch functions travel with the job.
register_pickle_by_value(sys.modules[__name__])


def nearest_neighbors(
    df: DataFrame, key: str, vector: str, k: int = 5, block_rows: int = BLOCK_ROWS, seed: int = 42, mode: str = "exact"
) -> DataFrame:
    """``<key>, rank, neighbor_id, distance, neighbor_vector`` by Euclidean distance.

    Ties go to the lower id. ``vector`` is an array column, ``key`` a long.
    ``mode="hashed"`` looks in hash tables only; a row that meets fewer than ``k`` others
    there is searched for exactly, so every row has its ``k``.
    """
    points = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    groups = materialise(_distinct_points(points, k))
    n_points = groups.count()
    if mode == "hashed":
        near = _hashed_candidates(groups, _stretch(groups, n_points, k, seed), k, block_rows, seed)
        merged = materialise(_top_by(near, "gid", ["distance", "neighbor_gid"], k))
        enough = merged.groupBy("gid").count().where(F.col("count") >= min(k, n_points - 1)).select("gid")
        short = materialise(groups.join(enough, "gid", "left_anti").select("gid", "v"))
        if not short.isEmpty():
            found = _exact(groups, n_points, k, block_rows, seed, short)
            merged = materialise(merged.join(short.select("gid"), "gid", "left_anti").unionByName(found))
    elif mode == "exact":
        merged = _exact(groups, n_points, k, block_rows, seed)
    else:
        raise ValueError(f"unknown mode {mode}")
    return _expand(points, groups, merged, key, k)


def _exact(groups: DataFrame, n_points: int, k: int, block_rows: int, seed: int, asking: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest of every vector, or of those ``asking``."""
    spark = groups.sparkSession
    first = groups.select(F.size("v").alias("d")).first()
    narrow = first is not None and 0 < first["d"] <= NARROW
    cells = _tree(groups, n_points, first["d"], k, block_rows, seed) if narrow else _Pivots(_pivots(groups, n_points, block_rows, seed))
    placed = materialise(_place(groups, cells))
    held = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *cells.measures()).collect()
    cells.measure(held)
    blocks = {r["cell"]: max(1, math.ceil(r["n"] / block_rows)) for r in held}

    counts = spark.createDataFrame(list(blocks.items()), "cell int, blocks int")
    own = F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int").alias("block")
    blocked = placed.join(F.broadcast(counts), "cell").select("gid", "v", "cell", own)
    bounded = _own_block_bounds(blocked, k)
    if asking is not None:
        bounded = bounded.join(asking.select("gid"), "gid", "left_semi")
    nearest = _visit_blocks(materialise(bounded), blocked, cells, blocks, k, block_rows)
    return materialise(_top_by(nearest, "gid", ["distance", "neighbor_gid"], k))


def _stretch(groups: DataFrame, n_points: int, k: int, seed: int) -> float:
    """Length of a hash stretch: from the k-th distances within a sample of ``SCALE_ROWS`` rows.

    In d dimensions distances shrink with the d-th root of the number of rows, so the
    sample's are brought to the table's.
    """

    def scale(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["v"].to_numpy())
        d = _distances(v, v)
        np.fill_diagonal(d, np.inf)
        kth = np.partition(d, min(k, len(v) - 1) - 1, axis=1)[:, min(k, len(v) - 1) - 1]
        return pd.DataFrame({"kth": [float(np.median(kth))], "size": [float(v.shape[1])]})

    sample = groups.orderBy(F.xxhash64("gid", F.lit(seed + 1))).limit(SCALE_ROWS)
    if n_points < 2:
        return 1.0
    row = sample.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(scale, "kth double, size double").first()
    shrunk = (min(n_points, SCALE_ROWS) / n_points) ** (1.0 / max(1.0, row["size"]))
    return STRETCH * row["kth"] * shrunk or 1.0


def _hashed_candidates(groups: DataFrame, stretch: float, k: int, block_rows: int, seed: int) -> DataFrame:
    """``gid, neighbor_gid, distance``: the k nearest within each bucket, once each.

    Buckets are counted without the vectors; those of one row only are left before a vector
    moves. A bucket over ``block_rows`` rows meets part by part, each part in a task of its
    own; the rows of any other are sent to one task once.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            v = np.stack(batch["v"].to_numpy())
            draw = np.random.default_rng(seed)
            lines = draw.standard_normal((v.shape[1], TABLES * PROJECTIONS))
            cut = np.floor((v @ lines) / stretch + draw.random(TABLES * PROJECTIONS)).astype(np.int64)
            buckets = np.arange(TABLES, dtype=np.uint64)[None].repeat(len(v), axis=0)
            for part in cut.reshape(len(v), TABLES, PROJECTIONS).transpose(2, 0, 1).view(np.uint64):
                buckets = (buckets ^ part) * np.uint64(0x9E3779B97F4A7C15)
                buckets ^= buckets >> np.uint64(29)
            yield batch[["gid"]].assign(buckets=list(buckets.view(np.int64)))

    placed = groups.select("gid", "v").mapInPandas(hashed, "gid long, buckets array<bigint>")
    placed = materialise(placed.select("gid", F.explode("buckets").alias("bucket")))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
    shared = placed.join(sizes, "bucket").groupBy("gid").agg(F.collect_list(F.struct("bucket", "parts")).alias("in"))
    shared = materialise(groups.select("gid", "v").join(shared, "gid"))
    held = shared.select("gid", "v", F.explode("in").alias("in")).select("gid", "v", "in.bucket", "in.parts")
    search = _search(k)
    small = held.where("parts = 1").select("gid", "v", "bucket")
    small = small.groupBy("bucket").applyInPandas(lambda rows: search(rows, rows), FOUND)
    held = held.where("parts > 1")
    own = F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asking = held.select("gid", "v", "bucket", own.alias("part"), every.alias("other"))
    # new names for the same columns, so that both sides can meet
    again = [F.col(c).alias(c) for c in ("gid", "v", "bucket")]
    members = held.select(*again, every.alias("part"), own.alias("other"))
    place = ["bucket", "part", "other"]
    found = asking.groupBy(*place).cogroup(members.groupBy(*place)).applyInPandas(search, FOUND)
    return small.unionByName(found).groupBy("gid", "neighbor_gid").agg(F.first("distance").alias("distance"))


#: No vectors: candidates are many times the neighbours they leave, whose vectors are joined last.
FOUND = "gid long, neighbor_gid long, distance double"


def _search(k: int):
    """The k nearest of each asking row among the rows of one block, within its ``bound`` if it has one."""

    def search(ask: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if len(ask) == 0 or len(block) == 0:
            none = np.zeros(0, np.int64)
            return pd.DataFrame({"gid": none, "neighbor_gid": none, "distance": none * 1.0})
        gids, own = block["gid"].to_numpy(), ask["gid"].to_numpy()
        d = _distances(np.stack(ask["v"].to_numpy()), np.stack(block["v"].to_numpy()))
        reach = _reach(ask["bound"].to_numpy()) if "bound" in ask else None
        row, col, distance = _lowest(d, gids, own, k, reach)
        return pd.DataFrame({"gid": own[row], "neighbor_gid": gids[col], "distance": distance})

    return search


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """``n_exact, recall``: the share of exact neighbours that were found."""
    hit = exact.join(found.select(key, "neighbor_id", F.lit(1).alias("hit")), [key, "neighbor_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_exact"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def _distinct_points(points: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: lowest id as ``gid``, its k+1 lowest ids as ``ids``.

    The rank filter is applied before the shuffle too, so a vector shared by a
    third of all rows sends k+1 rows per task.
    """
    lowest = Window.partitionBy("v").orderBy("id")
    few = points.withColumn("_r", F.row_number().over(lowest)).where(F.col("_r") <= k + 1)
    ids = few.groupBy("v").agg(F.min("id").alias("gid"), F.sort_array(F.collect_list("id")).alias("ids"))
    copies = points.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return ids.join(copies, "v")


def _pivots(groups: DataFrame, n_points: int, block_rows: int, seed: int) -> np.ndarray:
    wanted = 1 if n_points <= block_rows else max(2, math.ceil(math.sqrt(n_points) / 4))
    order = F.xxhash64("gid", F.lit(seed))
    return np.array([r["v"] for r in groups.orderBy(order).limit(wanted).select("v").collect()], dtype=float)


@dataclass
class _Pivots:
    """Cells of the vectors nearest to each pivot."""

    centres: np.ndarray
    ids: np.ndarray | None = None
    radii: np.ndarray | None = None

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell, and its distance to the pivot."""
        d = _distances(v, self.centres)
        cell = d.argmin(axis=1)
        return cell, d[np.arange(len(cell)), cell]

    def measures(self) -> list[Column]:
        return [F.max("to_pivot").alias("radius")]

    def measure(self, held: list) -> None:
        held = sorted(held, key=lambda r: r["cell"])
        self.ids, self.radii = np.array([r["cell"] for r in held]), np.array([r["radius"] for r in held])

    def near(self, v: np.ndarray, reach: np.ndarray) -> list[list[int]]:
        """The cells that can hold a row within ``reach`` of each row."""
        gap = _distances(v, self.centres[self.ids]) - self.radii[None, :]
        return [self.ids[row].tolist() for row in gap <= reach[:, None]]


@dataclass
class _Tree:
    """Cells cut by a tree: a row goes left where ``v[axis] <= cut``. Leaves have axis -1 and are
    the cells, by their place. ``low`` and ``high`` bound the rows under a place."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    width: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, moving = np.zeros(len(v), int), np.arange(len(v))
        while len(moving := moving[self.axis[at[moving]] >= 0]):
            here = at[moving]
            at[moving] = np.where(v[moving, self.axis[here]] <= self.cut[here], self.left[here], self.right[here])
        return at, np.zeros(len(v))

    def measures(self) -> list[Column]:
        return [f(F.col("v")[i]).alias(f"{n}{i}") for i in range(self.width) for f, n in ((F.min, "low"), (F.max, "high"))]

    def measure(self, held: list) -> None:
        self.low, self.high = np.full((len(self.axis), self.width), np.inf), np.full((len(self.axis), self.width), -np.inf)
        for r in held:
            self.low[r["cell"]] = [r[f"low{i}"] for i in range(self.width)]
            self.high[r["cell"]] = [r[f"high{i}"] for i in range(self.width)]
        for at in np.flatnonzero(self.axis >= 0)[::-1]:  # children come after their parent
            both = [self.left[at], self.right[at]]
            self.low[at], self.high[at] = self.low[both].min(axis=0), self.high[both].max(axis=0)

    def near(self, v: np.ndarray, reach: np.ndarray) -> list[list[int]]:
        found, open_ = [[] for _ in v], [(0, np.arange(len(v)))]
        while open_:
            at, rows = open_.pop()
            x = v[rows]
            gap = np.maximum(np.maximum(self.low[at] - x, x - self.high[at]), 0.0)
            rows = rows[np.sqrt(np.einsum("ij,ij->i", gap, gap)) <= reach[rows]]
            if not len(rows):
                continue
            if self.axis[at] >= 0:
                open_ += [(self.left[at], rows), (self.right[at], rows)]
                continue
            for row in rows.tolist():
                found[row].append(int(at))
        return found


def _tree(groups: DataFrame, n_points: int, width: int, k: int, block_rows: int, seed: int) -> _Tree:
    """Cuts at the middle of the widest dimension of a sample, until a leaf stands for half a block.

    The sample grows with the table, ``LEAF_SAMPLE`` rows for each leaf; beyond ``LEAVES`` leaves
    these hold more rows, in several blocks. Sampled rows are rows of the table, so a leaf
    has more than ``k``, which give its rows a bound.
    """
    wanted = min(LEAVES, math.ceil(2 * n_points / block_rows)) * LEAF_SAMPLE
    parts = 1 << 40
    drawn = F.pmod(F.xxhash64("gid", F.lit(seed)), F.lit(parts)) < min(parts, parts * wanted // max(1, n_points))
    rows = groups.where(drawn).select(*[F.col("v")[i].alias(f"_{i}") for i in range(width)]).toPandas()
    axis, cut, left, right = [-1], [0.0], [-1], [-1]
    open_ = [(0, rows.to_numpy(dtype=float).reshape(-1, width))] if n_points > block_rows else []
    while open_:
        at, v = open_.pop()
        if len(v) <= LEAF_SAMPLE:
            continue
        for i in np.argsort(np.min(v, axis=0) - np.max(v, axis=0), kind="stable"):
            values = np.sort(v[:, i])
            # between equal values there is no cut
            steps = np.flatnonzero(values[:-1] < values[1:]) + 1
            steps = steps[(steps > k) & (steps < len(v) - k)]
            if not len(steps):
                continue
            middle = steps[np.abs(steps - len(v) // 2).argmin()]
            axis[at], cut[at], left[at], right[at] = int(i), values[middle - 1], len(axis), len(axis) + 1
            goes_left = v[:, i] <= cut[at]
            open_ += [(left[at], v[goes_left]), (right[at], v[~goes_left])]
            for column, empty in ((axis, -1), (cut, 0.0), (left, -1), (right, -1)):
                column += [empty, empty]
            break
    return _Tree(np.array(axis), np.array(cut), np.array(left), np.array(right), width)


def _place(groups: DataFrame, cells: _Pivots | _Tree) -> DataFrame:
    # Arrays only: a broadcast names its classes, and executors have no copy of this package.
    shared, kind = groups.sparkSession.sparkContext.broadcast(vars(cells)), type(cells)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            cell, to_pivot = kind(**shared.value).assign(np.stack(batch["v"].to_numpy()))
            yield batch[["gid", "v"]].assign(cell=cell.astype("int32"), to_pivot=to_pivot)

    return groups.select("gid", "v").mapInPandas(assign, "gid long, v array<double>, cell int, to_pivot double")


def _distances(a: np.ndarray, b: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """Pairwise distances by differences (exact zero for equal rows), in slices of ``cells`` numbers."""
    out = np.empty((len(a), len(b)))
    step = max(1, cells // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _reach(bound: np.ndarray) -> np.ndarray:
    """How far to look for rows within ``bound``, whatever the rounding."""
    return bound * (1 + _SLACK) + _SLACK


def _lowest(
    d: np.ndarray, gids: np.ndarray, own: np.ndarray, k: int, reach: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance of the k smallest (distance, gid) per row within ``reach``, itself excluded."""
    d = np.where(own[:, None] == gids[None, :], np.inf, d)
    limit = reach
    if reach is None or not np.isfinite(reach).all():
        take = min(k, d.shape[1])
        limit = np.partition(d, take - 1, axis=1)[:, take - 1]
        limit = limit if reach is None else np.minimum(limit, reach)
    row, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
    order = np.lexsort((gids[col], d[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], col[keep], d[row[keep], col[keep]]


def _own_block_bounds(blocked: DataFrame, k: int) -> DataFrame:
    """Upper bound of the k-th distance from the row's own block (infinite if it is too small)."""

    def bound(block: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(block["v"].to_numpy())
        d = _distances(v, v)
        np.fill_diagonal(d, np.inf)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if len(block) > k else np.full(len(block), np.inf)
        return block[["gid", "v", "cell", "block"]].assign(bound=kth)

    return blocked.groupBy("cell", "block").applyInPandas(
        bound, "gid long, v array<double>, cell int, block int, bound double"
    )


def _visit_blocks(
    bounded: DataFrame, blocked: DataFrame, cells: _Pivots | _Tree, blocks: dict[int, int], k: int, block_rows: int
) -> DataFrame:
    """The k nearest of each row, within its bound, in every block it has to visit.

    Visits to a block are cut into parts of bounded size, and the block is
    repeated for each part, so neither side of a task grows with the data.
    """
    spark = bounded.sparkSession
    shared, kind = spark.sparkContext.broadcast(vars(cells)), type(cells)

    def targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            near = kind(**shared.value).near(np.stack(batch["v"].to_numpy()), _reach(batch["bound"].to_numpy()))
            yield batch[["gid", "v", "bound"]].assign(cells=near)

    visits = materialise(bounded.mapInPandas(targets, "gid long, v array<double>, bound double, cells array<int>"))
    per_cell = visits.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()
    parts = [(r["cell"], blocks[r["cell"]], math.ceil(r["count"] / block_rows)) for r in per_cell]
    counts = F.broadcast(spark.createDataFrame(parts, "cell int, blocks int, parts int"))

    part = F.pmod(F.xxhash64("gid", F.lit(1)), F.col("parts")).cast("int").alias("part")
    asking = visits.select("gid", "v", "bound", F.explode("cells").alias("cell")).join(counts, "cell").select(
        "gid", "v", "bound", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part
    )
    members = blocked.join(counts, "cell").select(
        "gid", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )

    place = ["cell", "block", "part"]
    return (
        asking.groupBy(*place)
        .cogroup(members.groupBy(*place))
        .applyInPandas(_search(k), FOUND)
    )


def _top_by(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _expand(points: DataFrame, groups: DataFrame, merged: DataFrame, key: str, k: int) -> DataFrame:
    """From distinct vectors back to rows: copies of a row are its nearest."""
    entry = "struct<distance:double,id:bigint,v:array<double>>"
    named = groups.select(F.col("gid").alias("neighbor_gid"), F.col("ids").alias("nids"), "v")
    others = merged.join(named, "neighbor_gid").select("gid", F.explode("nids").alias("id"), "distance", "v")
    # At most k distinct neighbours with k+1 ids each.
    lists = others.groupBy("gid").agg(
        F.sort_array(F.collect_list(F.struct("distance", "id", "v"))).alias("others")
    )
    candidates = groups.join(lists, "gid", "left").select(
        "gid",
        "v",
        F.slice(
            F.concat(
                F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("distance"), i.alias("id"), F.col("v").alias("v"))),
                F.coalesce(F.col("others"), F.array().cast(f"array<{entry}>")),
            ),
            1,
            k + 1,
        ).alias("near"),
        "n",
    )
    # A row takes the list of its vector, without itself. A vector with a single
    # row is reached by its id alone; only vectors with copies are looked up by value.
    single = candidates.where(F.col("n") == 1).select(F.col("gid").alias("id"), "near")
    repeated = candidates.where(F.col("n") > 1).select("v", "n", "near")
    n_repeated = groups.where(F.col("n") > 1).count()
    copied_rows = lookup_join(points, repeated, "v", n_repeated << 12, count_rows=False)
    copied_rows = copied_rows.where(F.col("near").isNotNull()).select("id", "near")
    per_row = single.unionByName(copied_rows).select(
        "id", F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k).alias("near")
    )
    return per_row.select("id", F.posexplode("near").alias("pos", "e")).select(
        F.col("id").alias(key),
        (F.col("pos") + 1).alias("rank"),
        F.col("e.id").alias("neighbor_id"),
        F.col("e.distance").alias("distance"),
        F.col("e.v").alias("neighbor_vector"),
    )


def smote(
    df: DataFrame,
    key: str,
    vector: str,
    label: str = "isFraud",
    k: int = 5,
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
    mode: str = "exact",
) -> DataFrame:
    """All rows of ``df`` plus synthetic rows of the smaller class up to equal counts.

    A synthetic row lies between a minority row and one of its k nearest. Every
    minority row starts the same number of synthetic rows (the remainder goes to
    the first in hash order); neighbour and position come from hashes. Output:
    ``<key>, <vector>, <label>, synthetic, base_id, neighbor_id`` where synthetic
    rows have a NULL key.
    """
    from riskloom.functions.scalars import ordering_hash
    from riskloom.operators.ordering import hashed_rank

    rows = df.select(key, F.col(vector).cast("array<double>").alias(vector), F.col(label).cast("int").alias(label))
    original = rows.withColumns(
        {"synthetic": F.lit(0), "base_id": F.lit(None).cast("long"), "neighbor_id": F.lit(None).cast("long")}
    )
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if len(counts) < 2:
        return original
    minority = min(counts, key=lambda c: (counts[c], -c))
    n_min, wanted = counts[minority], max(counts.values()) - counts[minority]
    if wanted == 0 or n_min < 2:
        return original

    few = rows.where(F.col(label) == minority).select(key, vector)
    near = nearest_neighbors(few, key, vector, min(k, n_min - 1), block_rows, seed, mode)
    lists = near.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "neighbor_vector"))).alias("near")
    )
    ranked = hashed_rank(few.withColumn("_h", ordering_hash(F.col(key), seed)), "_h").select(key, vector, "rank")
    share, rest = divmod(wanted, n_min)
    copies = F.lit(share).cast("long") + (F.col("rank") <= rest).cast("long")
    draws = (
        ranked.join(lists, key)
        .where(copies > 0)
        # few rows may start very many: their draws are dealt out in short stretches first
        .withColumn("_copies", copies)
        .withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"), F.lit(DRAWS).cast("long"))))
        .repartition(key, "_from")
        .withColumn("draw", F.explode(F.sequence(F.col("_from"), F.least(F.col("_copies"), F.col("_from") + (DRAWS - 1)))))
        .withColumn("pick", F.get("near", F.pmod(F.xxhash64(key, "draw", F.lit(seed)), F.size("near")).cast("int")))
        .withColumn("u", F.pmod(F.xxhash64(key, "draw", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    )
    between = F.zip_with(vector, "pick.neighbor_vector", lambda a, b: a + F.col("u") * (b - a))
    synthetic = draws.select(
        F.lit(None).cast(rows.schema[key].dataType).alias(key),
        between.alias(vector),
        F.lit(minority).alias(label),
        F.lit(1).alias("synthetic"),
        F.col(key).cast("long").alias("base_id"),
        F.col("pick.neighbor_id").alias("neighbor_id"),
    )
    return original.unionByName(synthetic)
