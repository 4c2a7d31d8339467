"""Per-row feature attribution for tree ensembles, linear models and any model.

Tree attributions are path-dependent Shapley values (Lundberg et al.). Each leaf
adds, for feature i on its path, value * (o_i - z_i) * integral over t in [0,1] of
the product of (t*o_j + (1-t)*z_j) over the other features j, where o says whether
the row takes the path's branches on j and z is the share of training rows that
do. The integrand is a polynomial, so Gauss-Legendre nodes integrate it exactly.

A model stays a table of nodes. Each tree is unrolled in a task of its own into
chunks of leaves, and blocks of rows meet groups of chunks in a join; neither the
driver nor any task holds the whole model or more rows than a few blocks. The learners
split a feature at a few bounds only, so rows between the same bounds have the same
attributions, and those are worked out once for all of them.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.sampling import ranked_by_hash
from riskloom.session import checkpoint_dir, materialise

register_pickle_by_value(sys.modules[__name__])

#: Leaves of a chunk, chunks of a group, rows of a block, blocks that meet a group in one task.
LEAVES, CHUNKS, ROWS, BLOCKS = 256, 16, 512, 8
#: Nodes of a group of trees, and numbers of a slice of rows, that meet in one task of a walk.
NODES, NUMBERS = 1 << 18, 1 << 22
#: Numbers a task works on at a time: rows x leaves x features on the path.
CELLS = 1 << 20
#: Bounds of all features that a task looks rows up in; a model of more has its rows as they are.
BOUNDS = 1 << 18
#: Rows that a network scores at a time.
SCORED = 1_024
#: Attributions of different rows are broadcast up to this size.
SENT_BYTES = 1 << 25


def ensemble_nodes(model, spark: SparkSession) -> DataFrame:
    """The nodes of a fitted forest or boosted model, one row each.

    ``tree, id, left, right, feature, threshold, categories, n_categories, value,
    cover``. ``left`` is negative at leaves. Values add up over the trees: to the margin
    of a boosted model, to a forest's probability of the positive class. ``cover`` is
    the weight of the training rows that reach the node.
    """
    learner = getattr(model, "learner", model)
    boosted = isinstance(learner, GBTClassificationModel)
    if not boosted and not isinstance(learner, RandomForestClassificationModel):
        raise TypeError(f"no tree nodes for {type(learner).__name__}")
    path = f"{checkpoint_dir(spark)}/nodes-{uuid.uuid4().hex}"
    learner.save(path)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    # Impurity statistics hold weighted counts: per class, or (n, sum, sum of squares).
    stats, split = F.col("impurityStats"), F.col("split")
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    if boosted:
        scales = spark.createDataFrame([(i, float(w)) for i, w in enumerate(learner.treeWeights)], "tree int, scale double")
        nodes = nodes.join(F.broadcast(scales), "tree")
        value, cover = F.col("prediction") * F.col("scale"), stats[0]
    else:
        value, cover = stats[1] / total / F.lit(float(learner.getNumTrees)), total
    continuous = split["numCategories"] < 0
    return nodes.select(
        "tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        split["featureIndex"].alias("feature"),
        F.when(continuous, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(~continuous, split["leftCategoriesOrThreshold"]).alias("categories"),
        split["numCategories"].alias("n_categories"),
        value.alias("value"), cover.alias("cover"),
    )



def walk_trees(nodes: DataFrame, df: DataFrame, key: str, features: list[str], depth: int) -> DataFrame:
    """``<key>, margin``: the sum over the trees of the value of the leaf a row reaches.

    ``nodes`` as from ``ensemble_nodes``. Every row starts at every root and moves down
    the node table one level at a time; values above a threshold, nulls and NaN go right,
    as in the learners. Slices of rows and groups of trees are joined in the cells of a
    grid, so a row moves once for each group, however deep the trees are. A cell holds
    ``NODES`` nodes (or one tree) and ``NUMBERS`` values of rows.
    """
    width, key_type = len(features), df.schema[key].dataType.simpleString()
    blocks = _blocks(df, key, features)
    sizes = nodes.groupBy("tree").count().orderBy("tree").collect()
    members, held = [[]], 0
    for tree, n in sizes:
        if held and held + n > NODES:
            members, held = [*members, []], 0
        members[-1].append(tree)
        held += n
    group_of = {tree: g for g, trees in enumerate(members) for tree in trees}
    n_groups, n_blocks = len(members), blocks.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    n_slices = max(1, min(n_blocks, cores), math.ceil(n_blocks * ROWS * width / NUMBERS))
    named = df.sparkSession.createDataFrame(list(group_of.items()), "tree int, g int")
    columns = ["tree", "id", "left", "right", "feature", "threshold", "categories", "value"]
    slices = F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("s")
    tree_side = materialise(nodes.select(*columns)).join(F.broadcast(named), "tree").select("g", slices, *columns)
    groups = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("g")
    block_side = blocks.select(groups, F.pmod(F.xxhash64("block"), F.lit(n_slices)).cast("int").alias("s"), "block", "keys", "x")

    def meet(some: pa.Table, steps: pa.Table) -> pa.Table:
        kinds = pa.schema([
            ("block", pa.int64()), ("at", pa.int64()), ("k", some.schema.field("keys").type.value_type), ("margin", pa.float64())
        ])
        if not some.num_rows:
            return kinds.empty_table()
        keys = some.column("keys").combine_chunks()
        counts = keys.value_lengths().to_numpy()
        x = some.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        parts = [np.repeat(some.column("block").to_numpy(), counts), np.concatenate([np.arange(n) for n in counts])]
        return pa.Table.from_arrays(
            [*map(pa.array, parts), keys.flatten(), pa.array(_leaf_values(steps, x, depth))], schema=kinds
        )

    met = block_side.groupBy("g", "s").cogroup(tree_side.groupBy("g", "s"))
    ended = met.applyInArrow(meet, f"block long, at long, k {key_type}, margin double")
    if n_groups > 1:
        ended = ended.groupBy("block", "at").agg(F.first("k").alias("k"), F.sum("margin").alias("margin"))
    return ended.select(F.col("k").alias(key), "margin")


def _leaf_values(steps: pa.Table, x: np.ndarray, depth: int) -> np.ndarray:
    """For every row of ``x`` the sum of the values of the leaves it reaches in the trees of ``steps``."""
    steps = steps.sort_by([("tree", "ascending"), ("id", "ascending")])
    column = {c: steps.column(c).to_numpy() for c in ("tree", "id", "left", "right", "value")}
    feature = steps.column("feature").fill_null(0).to_numpy()
    threshold = steps.column("threshold").fill_null(np.nan).to_numpy()
    sets = steps.column("categories")
    by_set = np.flatnonzero(sets.is_valid().to_numpy())
    total = np.zeros(len(x))
    starts = np.flatnonzero(np.diff(column["tree"], prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(column["tree"])]):
        ids = column["id"][start:end]
        at, moving = np.full(len(x), start + np.searchsorted(ids, 0)), np.arange(len(x))
        for _ in range(depth + 1):
            moving = moving[column["left"][at[moving]] >= 0]
            if not len(moving):
                break
            here = at[moving]
            seen = x[moving, feature[here]]
            goes_left = seen <= threshold[here]
            for node in np.intersect1d(by_set, here):
                rows = here == node
                goes_left[rows] = np.isin(seen[rows], sets[int(node)].as_py())
            child = np.where(goes_left, column["left"][here], column["right"][here])
            at[moving] = start + np.searchsorted(ids, child)
        total += column["value"][at]
    return total


def _unroll(nodes: pd.DataFrame) -> Iterator[dict]:
    """Leaf paths of one tree in chunks of equal length: per feature the rows that stay and their share."""
    by_id = nodes.set_index("id")
    column = {c: dict(zip(by_id.index, by_id[c])) for c in by_id.columns}
    left, right, cover = column["left"], column["right"], column["cover"]
    open_: dict[int, list] = {}
    stack = [(0, {})]
    while stack:
        at, held = stack.pop()
        if left[at] < 0:
            waiting = open_.setdefault(len(held), [])
            waiting.append((column["value"][at], held))
            if len(waiting) == LEAVES:
                yield _chunk(open_.pop(len(held)))
            continue
        feature, categories = int(column["feature"][at]), column["categories"][at]
        low, high, allowed, share = held.get(feature, (-math.inf, math.inf, None, 1.0))
        for child, goes_left in ((left[at], True), (right[at], False)):
            part = share * cover[child] / cover[at]
            if categories is not None:
                named = {float(v) for v in categories}
                every = set(map(float, range(int(column["n_categories"][at])))) if allowed is None else set(allowed)
                limits = (low, high, sorted(every & named if goes_left else every - named), part)
            elif goes_left:
                limits = (low, min(high, column["threshold"][at]), allowed, part)
            else:
                limits = (max(low, column["threshold"][at]), high, allowed, part)
            stack.append((child, {**held, feature: limits}))
    for waiting in open_.values():
        yield _chunk(waiting)


def _chunk(leaves: list[tuple[float, dict]]) -> dict:
    paths = [(value, sorted(held.items())) for value, held in leaves]
    flat = [(f, *limits) for _, path in paths for f, limits in path]
    return {
        "width": len(paths[0][1]),
        "value": [v for v, _ in paths],
        "feature": [f for f, *_ in flat],
        "low": [x[1] for x in flat],
        "high": [x[2] for x in flat],
        "allowed": [x[3] for x in flat],
        "share": [x[4] for x in flat],
        "expected": sum(v * math.prod(limits[3] for _, limits in path) for v, path in paths),
    }


CHUNK = (
    "width int, value array<double>, feature array<int>, low array<double>, high array<double>, "
    "allowed array<array<double>>, share array<double>, expected double"
)


def leaf_chunks(nodes: DataFrame) -> DataFrame:
    """All leaf paths of an ensemble, ``LEAVES`` to a row at most; one tree is unrolled at a time."""

    def run(tree: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_unroll(tree)))

    return nodes.groupBy("tree").applyInPandas(run, CHUNK)


def path_attributions(x: np.ndarray, chunk: Mapping) -> np.ndarray:
    """Rows x features attributions that the leaves of one chunk add."""
    phi, width = np.zeros(x.shape), int(chunk["width"])
    if not width:
        return phi
    value = np.array(chunk["value"])
    shape = (len(value), width)
    feature = np.array(chunk["feature"], dtype=int).reshape(shape)
    low, high, share = (np.array(chunk[c], dtype=float).reshape(shape) for c in ("low", "high", "share"))
    t, w = np.polynomial.legendre.leggauss(width // 2 + 1)
    t, w = (t + 1) / 2, w / 2
    order = np.argsort(feature, axis=None, kind="stable")
    named, starts = np.unique(feature.ravel()[order], return_index=True)
    rows = max(1, CELLS // feature.size)
    for start in range(0, len(x), rows):
        columns = x[start : start + rows][:, feature]
        on_path = (columns > low) & (columns <= high)
        on_path |= np.isnan(columns) & (high == np.inf)
        for i, allowed in enumerate(chunk["allowed"]):
            if allowed is not None:
                on_path[:, i // width, i % width] = np.isin(columns[:, i // width, i % width], allowed)
        weight = np.zeros(columns.shape)
        for at, part in zip(t, w):
            factors = np.where(on_path, at + (1 - at) * share, (1 - at) * share)
            weight += part * factors.prod(axis=2, keepdims=True) / factors
        added = (value[:, None] * (on_path - share) * weight).reshape(len(columns), -1)[:, order]
        phi[start : start + rows, named] += np.add.reduceat(added, starts, axis=1)
    return phi


def _blocks(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """``block``, ``keys``, ``x`` (row by row): up to ``ROWS`` rows that already lie together."""
    width, key_type = len(features), df.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = np.column_stack([part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)]).ravel()
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                xs = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float64()))
                yield pa.RecordBatch.from_arrays([keys, xs], ["keys", "x"])

    rows = df.select(F.col(key), *[F.col(c).cast("double") for c in features])
    packed = rows.mapInArrow(pack, f"keys array<{key_type}>, x array<double>")
    return materialise(packed.withColumn("block", F.monotonically_increasing_id()))


def _snapped(df: DataFrame, key: str, features: list[str], nodes: DataFrame) -> DataFrame:
    """``<key>, x``: the values a model sees. Each is moved up to the next bound of its feature, past the
    last one to infinity, as are NaN and null, which go the same way; categories stay."""
    split = nodes.where(F.col("left") >= 0).select("feature", "threshold", "n_categories").distinct()
    width, key_type = len(features), df.schema[key].dataType.simpleString()
    raw = df.select(F.col(key), *[F.col(c).cast("double") for c in features])
    if split.count() > BOUNDS:
        return materialise(raw.select(key, F.array(*features).alias("x")))
    found = split.groupBy("feature").agg(F.array_sort(F.collect_list("threshold")).alias("bounds")).collect()
    # a feature split by categories has no threshold; one never split has one value
    bounds = {r["feature"]: np.array(r["bounds"], dtype=float) for r in found}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.full((batch.num_rows, width), math.inf)
            for i, edges in bounds.items():
                values = batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float)
                x[:, i] = np.append(edges, math.inf)[np.searchsorted(edges, values)] if len(edges) else values
            ends = pa.array(np.arange(batch.num_rows + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], [key, "x"])

    return materialise(raw.mapInArrow(run, f"`{key}` {key_type}, x array<double>"))


def tree_vectors(model, df: DataFrame, key: str, features: list[str]) -> tuple[DataFrame, float]:
    """``<key>, phi`` (an array, one value a feature) for every row, and the base value.

    Rows between the same bounds of every feature are one row of the grid, and get its
    values by a join. So the work of a model of few features ends at a size set by its bins.
    """
    nodes = materialise(ensemble_nodes(model, df.sparkSession))
    rows = _snapped(df, key, features, nodes)
    different = materialise(rows.select("x").distinct())
    seen = different.select(F.col("x").alias("_x"), *[F.col("x")[i].alias(f"_{i}") for i in range(len(features))])
    each, expected = _grid_vectors(nodes, seen, "_x", [f"_{i}" for i in range(len(features))])
    each = materialise(each)
    small = each.count() * (16 * len(features) + 64) <= SENT_BYTES
    each = F.broadcast(each) if small else each.hint("shuffle_hash")
    return rows.join(each, F.col("x") == F.col("_x")).select(key, "phi"), expected


def _grid_vectors(nodes: DataFrame, df: DataFrame, key: str, features: list[str]) -> tuple[DataFrame, float]:
    """``<key>, phi`` of every row of ``df``, and the base value.

    Blocks of rows and groups of chunks are each sent to the cells of a grid, so that
    every block meets every group once and a cell holds ``BLOCKS`` blocks and ``CHUNKS``
    chunks on average. What the groups add to a row is summed before and after the shuffle.
    """
    width, key_type = len(features), df.schema[key].dataType.simpleString()
    chunks = materialise(leaf_chunks(nodes))
    blocks = _blocks(df, key, features)
    n_chunks, expected = chunks.agg(F.count("*"), F.sum("expected")).first()
    n_groups = max(1, math.ceil(n_chunks / CHUNKS))
    n_slices = max(1, math.ceil(blocks.count() / BLOCKS))
    contents = [F.col(c) for c in chunks.columns if c != "expected"]
    group = F.pmod(F.xxhash64("value", "feature", "low"), F.lit(n_groups)).cast("int")
    slices = F.sequence(F.lit(0), F.lit(n_slices - 1))
    chunk_side = chunks.select(group.alias("g"), F.explode(slices).alias("s"), *contents)
    slice_ = F.pmod(F.xxhash64("block"), F.lit(n_slices)).cast("int")
    groups = F.sequence(F.lit(0), F.lit(n_groups - 1))
    block_side = blocks.select(F.explode(groups).alias("g"), slice_.alias("s"), "block", "keys", "x")

    def meet(some: pa.Table, paths: pa.Table) -> pa.Table:
        chunks_here = paths.to_pylist()
        out = []
        for block, keys, x in zip(*(some.column(c) for c in ("block", "keys", "x"))):
            matrix = x.values.to_numpy().reshape(-1, width)
            phi = sum((path_attributions(matrix, c) for c in chunks_here), np.zeros(matrix.shape))
            ends = pa.array(np.arange(len(matrix) + 1) * width, pa.int32())
            numbers = [pa.array(np.full(len(matrix), block.as_py())), pa.array(np.arange(len(matrix)))]
            values = pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))
            out.append(pa.Table.from_arrays([*numbers, keys.values, values], ["block", "at", "k", "phi"]))
        kinds = [("block", pa.int64()), ("at", pa.int64()), ("k", some.schema.field("keys").type.value_type), ("phi", pa.list_(pa.float64()))]
        return pa.concat_tables([t.cast(pa.schema(kinds)) for t in out]) if out else pa.schema(kinds).empty_table()

    met = block_side.groupBy("g", "s").cogroup(chunk_side.groupBy("g", "s"))
    parts = met.applyInArrow(meet, f"block long, at long, k {key_type}, phi array<double>")
    if n_groups > 1:
        summed = Summarizer.sum(array_to_vector(F.col("phi")))
        parts = parts.groupBy("block", "at").agg(F.first("k").alias("k"), vector_to_array(summed).alias("phi"))
    return parts.select(F.col("k").alias(key), "phi"), float(expected or 0.0)


def to_long(vectors: DataFrame, key: str, features: list[str], model: str) -> DataFrame:
    """Long ``model, <key>, feature, shap_value`` of ``<key>, phi`` rows."""
    names = F.array(*[F.lit(f) for f in features])
    return vectors.select(key, F.posexplode("phi").alias("position", "shap_value")).select(
        F.lit(model).alias("model"), key, F.get(names, F.col("position")).alias("feature"), "shap_value"
    )


def summarise(vectors: DataFrame, features: list[str], model: str) -> DataFrame:
    """``model, feature, mean_abs, mean_signed, n``: vectors are added up, not exploded."""
    both = Summarizer.metrics("normL1", "mean", "count").summary(array_to_vector(F.col("phi")))
    # a group, not a global aggregate: that of no rows has no sums to read
    row = vectors.groupBy(F.lit(1)).agg(both.alias("s")).select(
        vector_to_array("s.normL1").alias("total"), vector_to_array("s.mean").alias("mean"), F.col("s.count").alias("n")
    )
    lines = F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.col("total")[i] / F.col("n")).alias("mean_abs"), F.col("mean")[i].alias("mean_signed"), "n")
        for i, f in enumerate(features)
    ])
    return row.select(F.lit(model).alias("model"), F.explode(lines).alias("l")).select("model", "l.*")


def tree_attribution(
    model, df: DataFrame, key: str, features: list[str], name: str | None = None
) -> tuple[DataFrame, float]:
    """Long ``model, <key>, feature, shap_value`` for every row, and the base value.

    ``model`` is a trained preset or a fitted MLlib ensemble whose inputs are
    ``features`` in that order. A boosted model is explained on its margin, a forest on
    the probability of the positive class.
    """
    label = name or getattr(model, "name", type(model).__name__)
    vectors, expected = tree_vectors(model, df, key, features)
    return to_long(vectors, key, features, label), expected


def linear_vectors(df: DataFrame, key: str, features: list[str], coefficients: list[float]) -> DataFrame:
    """``<key>, phi`` with ``coefficient * (x - mean)`` per feature, as column expressions."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    parts = zip(features, coefficients, means, strict=True)
    values = [(F.col(c).cast("double") - F.lit(m)) * F.lit(float(w)) for c, w, m in parts]
    return df.select(key, F.array(*values).alias("phi"))


def linear_attribution(
    df: DataFrame, key: str, features: list[str], coefficients: list[float], name: str = "linear"
) -> DataFrame:
    """``coefficient * (x - mean)`` per feature; long rows."""
    return to_long(linear_vectors(df, key, features, coefficients), key, features, name)


def drawn_vectors(
    model, df: DataFrame, key: str, features: list[str], background: DataFrame, draws: int = 8, seed: int = 42
) -> DataFrame:
    """``<key>, draw, phi, base``: what every draw says of a model of any kind.

    A draw takes one row of the whole ``background``, met by its rank in hash order, and
    an order of the features with its reverse. Along both, features are switched one by
    one from the background's values to the row's; ``phi`` is the mean change of the
    probability at each switch. ``base`` is the probability of the background row, so
    ``phi`` adds up to the row's own probability less ``base``. Orders and choices come
    from hashes of ``key``, which must name one row. A network's rows are switched and
    scored by the block, where they lie; any other model is asked as a whole.
    """
    d = len(features)
    ranked = ranked_by_hash(background.select(key, *features), key, seed)
    ranked = materialise(ranked.select(F.array(*[F.col(c).cast("double") for c in features]).alias("b"), F.col("rank").alias("r")))
    size = ranked.count()
    if not size:
        raise ValueError("the background has no row")
    drawn = df.select(
        F.col(key).alias("k"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"),
    )
    chosen = F.pmod(F.xxhash64("k", "draw", F.lit(seed)), F.lit(size)) + 1
    hashes = [F.xxhash64("k", "draw", F.lit(i), F.lit(seed)) for i in range(d)]
    order = F.transform(
        F.array_sort(F.array(*[F.struct(h.alias("h"), F.lit(i).alias("i")) for i, h in enumerate(hashes)])), lambda e: e["i"]
    )
    # Written as parquet the background looks small; broadcast, all its rows would pass through the driver.
    paired = drawn.withColumn("r", chosen).join(ranked.hint("merge"), "r")
    layers = _layers(model, features)
    if layers is not None:
        found = _network_draws(paired.select("k", "draw", "x", "b", F.array(*hashes).alias("h")), layers)
        return found.withColumnRenamed("k", key).repartition(key)
    met = paired.select("k", "draw", "x", "b", order.alias("ahead"))
    # Rows of one key stay together from here on: the scores of a draw meet without another shuffle.
    met = met.repartition("k")
    ways = F.array(*[F.struct(F.lit(i).alias("way"), o.alias("order")) for i, o in enumerate((F.col("ahead"), F.reverse("ahead")))])
    steps = met.select("k", "draw", "x", "b", F.explode(ways).alias("w")).select(
        "k", "draw", "x", "b", "w.way", "w.order", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("step")
    )
    switched = F.slice("order", F.lit(1), F.col("step"))
    mixed = steps.select(
        "k", "draw", "way", "order", "step",
        *[F.when(F.array_contains(switched, F.lit(i)), F.col("x")[i]).otherwise(F.col("b")[i]).alias(c) for i, c in enumerate(features)],
    )
    scored = model.transform(mixed).select("k", "draw", "way", "order", "step", vector_to_array(F.col("probability"))[1].alias("p"))
    one_way = scored.groupBy("k", "draw", "way").agg(
        F.first("order").alias("order"),
        F.transform(F.array_sort(F.collect_list(F.struct("step", "p"))), lambda e: e["p"]).alias("p"),
    )
    switched_at = [F.array_position("order", F.lit(i)).cast("int") for i in range(d)]
    gained = F.array(*[F.get("p", at) - F.get("p", at - 1) for at in switched_at])
    ends = one_way.select("k", "draw", gained.alias("phi"), F.get("p", F.lit(0)).alias("base"))
    both = ends.groupBy("k", "draw").agg(F.collect_list("phi").alias("ways"), F.first("base").alias("base"))
    mean = F.transform(F.arrays_zip(F.col("ways")[0].alias("a"), F.col("ways")[1].alias("b")), lambda e: (e["a"] + e["b"]) / 2)
    return both.select(F.col("k").alias(key), "draw", mean.alias("phi"), "base")


def _layers(model, features: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Weights and intercepts of each layer of a network whose inputs are ``features``; None for any other model."""
    learner = getattr(model, "learner", None)
    if not isinstance(learner, MultilayerPerceptronClassificationModel) or list(model.features) != list(features):
        return None
    sizes, weights, layers = learner.getLayers(), learner.weights.toArray(), []
    for n, m in zip(sizes, sizes[1:]):
        layers.append((weights[: n * m].reshape(n, m), weights[n * m : n * m + m]))
        weights = weights[n * m + m :]
    return layers


def _network_probability(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """The probability of the positive class: sigmoid layers, then the share of the exponentials."""
    out = np.empty(len(x))
    for start in range(0, len(x), SCORED):
        h = x[start : start + SCORED]
        for w, b in layers[:-1]:
            h = h @ w
            h += b
            np.negative(h, out=h)
            np.exp(h, out=h)
            h += 1.0
            np.reciprocal(h, out=h)
        w, b = layers[-1]
        h = h @ w + b
        h = np.exp(h - h.max(axis=1, keepdims=True))
        out[start : start + SCORED] = h[:, 1] / h.sum(axis=1)
    return out


def _network_draws(pairs: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``k, draw, phi, base`` of rows ``x`` and their background rows ``b``; ``h`` gives the order of the features.

    The steps of both ways start at ``b`` and end at ``x``; these are scored once a draw.
    """
    d = layers[0][0].shape[0]
    shared = pairs.sparkSession.sparkContext.broadcast(layers)

    def matrix(column: pa.Array, kind: type = float) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, b = matrix(batch.column(2)), matrix(batch.column(3))
            if np.isnan(x).any() or np.isnan(b).any():
                raise ValueError("a network cannot score null or NaN")
            at = matrix(batch.column(4), np.int64).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            start, end = _network_probability(shared.value, b), _network_probability(shared.value, x)
            phi, rows = np.zeros(x.shape), np.arange(len(x))[:, None]
            for place in (at, d - 1 - at):
                p = [_network_probability(shared.value, np.where(place < step, x, b)) for step in range(1, d)]
                p = np.column_stack([start, *p, end])
                phi += (p[rows, place + 1] - p[rows, place]) / 2
            ends = pa.array(np.arange(len(x) + 1) * d, pa.int32())
            values = pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values, pa.array(start)], ["k", "draw", "phi", "base"])

    key_type = pairs.schema["k"].dataType.simpleString()
    return pairs.mapInArrow(run, f"k {key_type}, draw int, phi array<double>, base double")


def permutation_vectors(
    model, df: DataFrame, key: str, features: list[str], background: DataFrame, draws: int = 8, seed: int = 42
) -> DataFrame:
    """``<key>, phi, std_error, base``: means over the draws, and how sure they are.

    ``std_error`` is the deviation of a feature's value over the draws by the root of their
    number (null for one draw). ``phi`` adds up to the row's probability less ``base``,
    the mean probability of its background rows.
    """
    each = drawn_vectors(model, df, key, features, background, draws, seed)
    # Column by column: a summary of vectors sorts its rows once a task meets many keys.
    values = [F.col("phi")[i] for i in range(len(features))]
    error = F.array(*[F.stddev_samp(v) / F.lit(math.sqrt(draws)) for v in values]) if draws > 1 else F.lit(None).cast("array<double>")
    means = F.array(*[F.avg(v) for v in values])
    return each.groupBy(key).agg(means.alias("phi"), error.alias("std_error"), F.avg("base").alias("base")).select(key, "phi", "std_error", "base")


def permutation_attribution(
    model,
    df: DataFrame,
    key: str,
    features: list[str],
    background: DataFrame,
    draws: int = 8,
    seed: int = 42,
    name: str | None = None,
) -> DataFrame:
    """Long ``model, <key>, feature, shap_value, std_error`` of a model of any kind."""
    vectors = permutation_vectors(model, df, key, features, background, draws, seed)
    names = F.array(*[F.lit(f) for f in features])
    return vectors.select(key, "std_error", F.posexplode("phi").alias("position", "shap_value")).select(
        F.lit(name or getattr(model, "name", "model")).alias("model"),
        key,
        F.get(names, F.col("position")).alias("feature"),
        "shap_value",
        F.get("std_error", F.col("position")).alias("std_error"),
    )


def model_vectors(
    model, df: DataFrame, key: str, features: list[str], background: DataFrame | None = None, draws: int = 8, seed: int = 42
) -> DataFrame:
    """``<key>, phi`` of any model by the way that suits its kind.

    Ensembles of trees exactly (margin or probability), logistic regressions exactly on
    their margin, everything else (networks, calibrated machines) by drawn orders on the
    probability, against ``background`` (``df`` itself if there is none).
    """
    learner = getattr(model, "learner", model)
    if isinstance(learner, (GBTClassificationModel, RandomForestClassificationModel)):
        return tree_vectors(model, df, key, features)[0]
    if isinstance(learner, LogisticRegressionModel):
        return linear_vectors(df, key, features, list(learner.coefficients))
    return permutation_vectors(model, df, key, features, df if background is None else background, draws, seed).select(key, "phi")


def explain_models(
    models: Mapping[str, object],
    df: DataFrame,
    key: str,
    features: list[str],
    background: DataFrame | None = None,
    draws: int = 8,
    seed: int = 42,
    rows: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Mean attributions of any mix of models, and on request every row's.

    Returns ``model, feature, mean_abs, mean_signed, n``, and with ``rows`` the long
    ``model, <key>, feature, shap_value``; without it no row x feature table is written.
    """
    summaries, longs = [], []
    for name, model in models.items():
        vectors = model_vectors(model, df, key, features, background, draws, seed)
        if rows:
            vectors = materialise(vectors)
            longs.append(to_long(vectors, key, features, name))
        summaries.append(summarise(vectors, features, name))
    summary = materialise(_union(summaries))
    return summary, _union(longs) if rows else None


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
