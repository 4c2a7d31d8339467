"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.tables import map_rows
from riskloom.session import materialise

#: Neighbours kept for a node, projections that start the graph, rows compared at once.
NEIGHBOURS, PROJECTIONS, BLOCK = 24, 8, 2048
#: Proposals a group makes to each member; rounds of neighbours of neighbours at most, and the
#: share by which a round must bring the neighbours nearer for another to follow.
PROPOSALS, DESCENTS, GAIN = 12, 10, 0.01
#: Nodes a query keeps, opens in a round, and must have opened at the end; rounds at most.
BEAM, OPEN, SETTLED, SEARCHES = 96, 48, 32, 6
LIST = "node long, ids array<bigint>, sims array<float>"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id``, ``vector`` (doubles), ``code`` (bytes) and ``copy`` of the rows that take part.

    Those are rows with an id and a vector of the commonest length, without nulls or
    non-finite components, and not zero. ``code`` is the unit vector in single precision, for
    finding candidates only; ``copy`` is the same for exact copies.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.where("vec_id is not null and vector is not null and size(vector) > 0")
    rows = rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (sizes["n"] if sizes else 0))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        code = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        copies = [md5(np.asarray(v).tobytes()).digest() for v in batch.column(1).to_numpy(zero_copy_only=False)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(copies, pa.binary())],
            ["vec_id", "vector", "code", "copy"],
        )

    return map_rows(rows, run, "vec_id long, vector array<double>, code binary, copy binary")


def unpack(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of codes, in double precision."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(np.float64)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def lists(nodes: list, ids: list, sims: list) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(nodes, np.int64)),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int64))),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sims).astype(np.float32))),
        ],
        ["node", "ids", "sims"],
    )


def grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows of a sorted partition by their first column, at most ``most`` at a time."""
    held, last = [], None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)] if len(keys) else [0]
        for a, b in zip(cuts, cuts[1:]):
            if held and (keys[a] != last or sum(map(len, held)) >= most):
                yield pa.Table.from_batches(held)
                held = []
            last = keys[a]
            for c in range(a, b, most):
                if held and c > a:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(c, min(most, b - c)))
    if held:
        yield pa.Table.from_batches(held)


def best_of(ids: np.ndarray, x: np.ndarray, floor: np.ndarray, most: int) -> tuple[list, list, list]:
    """For each row of ``x``, up to ``most`` of the other rows nearest to it above its floor.

    Similarities are cosines less one, worked out in double precision: as numbers near
    zero they tell near copies apart in single precision too.
    """
    sims = x @ x.T - 1
    sims[ids[:, None] == ids[None]] = -4
    k = min(most, len(ids) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sims, top, axis=1)
    nodes, found, held = [], [], []
    for i in range(len(ids)):
        good = value[i] > floor[i]
        if good.any():
            nodes.append(ids[i])
            found.append(ids[top[i][good]])
            held.append(value[i][good])
    return nodes, found, held


def keep_best(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest of all lists of a node; lists of a node are read one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, float] = {}
        last, out = None, ([], [], [])

        def close() -> None:
            top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:most]
            out[0].append(last)
            out[1].append(np.array([t[0] for t in top]))
            out[2].append(np.array([t[1] for t in top]))

        for batch in batches:
            for node, ids, sims in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if node != last:
                    if last is not None:
                        close()
                    last, best = node, {}
                best.update(zip(ids.values.to_pylist(), sims.values.to_pylist()))
                if len(best) > 8 * most:
                    best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:most])
            if len(out[0]) > 2000:
                yield lists(*out)
                out = ([], [], [])
        if last is not None:
            close()
        if out[0]:
            yield lists(*out)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, LIST)


def first_graph(nodes: DataFrame, most: int, seed: int = 11) -> DataFrame:
    """A rough graph: nodes sorted by the signs of random projections, near ones compared.

    Blocks are cut from the sorted rows, so none is larger than ``BLOCK`` however
    alike the vectors are.
    """

    def coded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = unpack(batch.column(1))
        plane = np.random.default_rng(seed).standard_normal((PROJECTIONS, x.shape[1], 32))
        for t in range(PROJECTIONS):
            bits = (x @ plane[t] > 0).astype(np.int64)
            key = (np.int64(t) << 32) | (bits << np.arange(31, -1, -1)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], ["key", "node", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tabled = (
            pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy() >> 32), *b.columns[1:]], ["t", "node", "code"])
            for b in batches
            if b.num_rows
        )
        for block in grouped(tabled, BLOCK):
            if len(block) > 1:
                ids, x = block.column(1).to_numpy(), unpack(block.column(2).combine_chunks())
                found = best_of(ids, x, np.full(len(ids), -3.0), most)
                if found[0]:
                    yield lists(*found)

    keys = map_rows(nodes.select("node", "code"), coded, "key long, node long, code binary")
    dealt = materialise(keys)
    return keep_best(dealt.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, LIST), most)


def descend(graph: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """One round: nodes that share a neighbour are compared, better ones taken up.

    Every node goes to each of its neighbours with its code and the least similarity
    it keeps; there, the nodes that came meet. A neighbour of very many is met in
    blocks of ``BLOCK``.
    """
    own = graph.join(nodes.select("node", "code"), "node")
    sent = own.select(
        F.explode(F.array_append("ids", F.col("node"))).alias("at"), "node", "code",
        F.when(F.size("sims") >= most, F.array_min("sims")).otherwise(F.lit(-3.0)).cast("float").alias("floor"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for group in grouped(batches, BLOCK):
            if len(group) > 1:
                ids, x = group.column(1).to_numpy(), unpack(group.column(2).combine_chunks())
                for side, found in zip(out, best_of(ids, x, group.column(3).to_numpy(), PROPOSALS)):
                    side += found
            if len(out[0]) > 5000:
                yield lists(*out)
                out = ([], [], [])
        if out[0]:
            yield lists(*out)

    met = sent.repartition("at").sortWithinPartitions("at").mapInArrow(run, LIST)
    return keep_best(graph.union(met), most)


def build_graph(nodes: DataFrame, most: int = NEIGHBOURS, descents: int = DESCENTS) -> DataFrame:
    """``node``, ``ids``, ``sims``: the neighbours found for every node, nearest first.

    Rounds go on until one changes little: fewer lists than a hundredth get longer, and the
    root distances of all neighbours fall by less than ``GAIN`` together.
    """
    far = F.aggregate("sims", F.lit(0.0), lambda total, s: total + F.sqrt(F.greatest(-s.cast("double"), F.lit(0.0))))
    told = [F.sum(F.size("ids")), F.sum(far)]
    graph = materialise(first_graph(nodes, most))
    links, before = graph.agg(*told).first()
    for _ in range(descents):
        graph = materialise(descend(graph, nodes, most))
        more, after = graph.agg(*told).first()
        if not more or (more <= 1.01 * links and after >= (1 - GAIN) * before * more / links):
            break
        links, before = more, after
    return graph


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes nearest to each query node by greedy search: ``q``, ``ids``.

    A query starts at its own node and, round by round, opens the nearest nodes it has
    not opened: their neighbours either way are compared and the best kept. It ends
    when the nearest it knows are all open. ``queries`` has ``q``, a node.
    """
    edges = graph.select("node", F.explode("ids").alias("to"))
    edges = materialise(edges.union(edges.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct())
    codes = nodes.select("node", "code")
    targets = materialise(queries.join(codes.withColumnRenamed("node", "q"), "q"))
    pool = materialise(targets.select(F.col("q").alias("node"), F.array("q").alias("ids"), F.array(F.lit(0.0).cast("float")).alias("sims")))
    opened = None

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sims = (np.einsum("ij,ij->i", unpack(batch.column(1)), unpack(batch.column(3))) - 1).astype(np.float32)
        ends = pa.array(np.arange(batch.num_rows + 1), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(ends, batch.column(2)), pa.ListArray.from_arrays(ends, pa.array(sims))],
            ["node", "ids", "sims"],
        )

    for _ in range(SEARCHES):
        ranked = pool.select(F.col("node").alias("q"), F.posexplode("ids").alias("rank", "at"))
        if opened is not None:
            ranked = ranked.join(opened, ["q", "at"], "left_anti")
        ranked = materialise(ranked)
        if ranked.where(F.col("rank") < SETTLED).isEmpty():
            break
        order = Window.partitionBy("q").orderBy("rank")
        front = materialise(ranked.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= OPEN).select("q", "at"))
        opened = front if opened is None else materialise(opened.union(front))
        reached = front.join(edges, F.col("at") == F.col("node")).select("q", F.col("to").alias("cand")).distinct()
        pairs = reached.join(targets, "q").select("q", F.col("code").alias("qcode"), "cand")
        pairs = pairs.join(codes.withColumnRenamed("node", "cand"), "cand").select("q", "qcode", "cand", "code")
        pool = materialise(keep_best(pool.union(map_rows(pairs, score, LIST)), BEAM))
    return pool.select(F.col("node").alias("q"), F.slice("ids", 1, SETTLED).alias("ids"))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows found for every row of ``vectors`` whose id is in ``queries``.

    Returns ``query_id``, ``rank``, ``vec_id``, ``score``: cosines of the original vectors in double
    precision, ties to the smaller id, the query itself left out. Exact copies are one
    node of the graph; each brings its ``k + 1`` smallest ids. A repeated id counts
    once, with its least vector. Rows that can have no cosine take no part; with fewer
    than ``k`` others all come out.
    """
    rows = usable(vectors, id_column, vector_column)
    rows = materialise(rows.groupBy("vec_id").agg(F.min(F.struct("vector", "code", "copy")).alias("v")).select("vec_id", "v.*"))
    nodes = materialise(rows.groupBy("copy").agg(F.min(F.struct("vec_id", "code")).alias("v")).select("copy", F.col("v.vec_id").alias("node"), "v.code"))
    named = materialise(rows.select("vec_id", "copy").join(nodes.select("copy", "node"), "copy").select("vec_id", "node"))
    graph = build_graph(nodes)
    asked = materialise(named.join(queries.select(F.col(queries.columns[0]).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi"))
    found = search(asked.select(F.col("node").alias("q")).distinct(), graph, nodes)

    # of copies, few ids can be among the nearest; ranked by part first, so that no task gets all
    part = Window.partitionBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    some = named.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    whole = Window.partitionBy("node").orderBy("vec_id")
    members = materialise(some.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1).select("node", "vec_id"))

    def exact(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = (np.stack(batch.column(i).to_numpy(zero_copy_only=False)) for i in (1, 3))
        dot = np.einsum("ij,ij->i", a, b)
        score = dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], ["q", "node", "score"])

    originals = rows.select(F.col("vec_id").alias("node"), "vector")
    pairs = found.select("q", F.explode("ids").alias("node"))
    pairs = pairs.join(originals.select(F.col("node").alias("q"), F.col("vector").alias("x")), "q")
    pairs = pairs.join(originals, "node").select("q", "x", "node", F.col("vector").alias("y"))
    scored = materialise(map_rows(pairs, exact, "q long, node long, score double"))
    # a query node's nearest k + 1 rows serve every copy of it
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = scored.join(members, "node").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    top = materialise(top.select("q", "vec_id", "score"))
    each = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(top, "q").where("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
