"""Near-duplicate groups by minima of universal hashes, banding and star components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.simhash import PARITY_WORDS, parities
from riskloom.llm.tables import connected, map_rows
from riskloom.session import materialise

#: Words in a shingle; bands, minima in each and hashes in all (the last one is in no band).
WIDTH, BANDS, BAND_ROWS, HASHES = 4, 51, 5, 256
#: Minima two signatures may differ in, as seen by two bits of each. Sets of similarity 0.8
#: differ in 38 of 256 on average, in more than 76 with a probability of about 1e-9.
MOST_APART = 76
#: Rounds of links to one member of each band before all open pairs; nodes of one side of a task's pairs.
ROUNDS, CELL = 2, 2048
_DRAW = np.random.default_rng(11)
FACTOR = _DRAW.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFT = _DRAW.integers(0, 1 << 32, HASHES, dtype=np.uint32)
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer words make one, none none."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    mixed = np.full(n, min(len(words), width), np.uint64)
    for j in range(min(width, len(words))):
        mixed = (mixed ^ hashes[j : j + n]) * ODD
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minima(held: np.ndarray) -> np.ndarray:
    """Least value of each universal hash (a x + b modulo 2^32) over a set."""
    x = (held >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(x), 512):
        part = x[start : start + 512, None] * FACTOR
        part += SHIFT
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band, joined from its minima."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * ODD
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """Two bits of every minimum, first all low ones, then all high ones, in 64-bit words."""
    two = (least * np.uint32(0x9E3779B1)) >> np.uint32(30)
    return np.packbits(np.r_[two & 1, two >> 1].astype(np.uint8), bitorder="little").view(np.int64)


def apart(x: str, y: str) -> Column:
    """Minima in which the signatures ``x`` and ``y`` are seen to differ."""
    half = HASHES // 64
    differ = [
        F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i]).bitwiseOR(F.col(x)[i + half].bitwiseXOR(F.col(y)[i + half])))
        for i in range(half)
    ]
    return sum(differ[1:], differ[0])


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``node`` (hash of the set, null if empty), ``n``, ``keys``, ``sign`` and ``odd`` of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes, sizes, keys, signs, odd = [], [], [], [], []
        for value in batch.column(1):
            held = shingles(value.as_py())
            least = minima(held)
            nodes.append(node_of(held) if len(held) else None)
            sizes.append(len(held))
            keys.append(band_keys(least) if len(held) else [])
            signs.append(signature(least))
            odd.append(parities(held))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(x, longs) for x in (keys, signs, odd))],
            ["doc_id", "node", "n", "keys", "sign", "odd"],
        )

    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    return map_rows(rows, run, "doc_id long, node long, n long, keys array<bigint>, sign array<bigint>, odd array<bigint>")


def node_of(held: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(held.tobytes())).view(np.int64))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and ``held`` (its whole set) for the nodes of ``wanted``, one row each."""
    bits = wanted.sparkSession.sparkContext.broadcast(_map_of(wanted))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes, sets = [], []
        for value in batch.column(0):
            held = shingles(value.as_py())
            if len(held):
                node = node_of(held)
                at = (node & (1 << 64) - 1) >> 40
                if bits.value[at >> 3] >> (at & 7) & 1:
                    nodes.append(node)
                    sets.append(held.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "held"]
        )

    rows = docs.select(F.col("`text`").alias("text"))
    return map_rows(rows, run, "node long, held array<bigint>").dropDuplicates(["node"])


def _map_of(wanted: DataFrame) -> np.ndarray:
    """2 MB of bits, one set for the first 24 bits of each node: which texts may be wanted."""
    at = F.shiftrightunsigned("node", 40)
    one = F.expr("shiftleft(1, cast(at & 7 as int))")
    found = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 3).alias("byte")).agg(F.bit_or(one).alias("bits")).toArrow()
    known = np.zeros(1 << 21, np.uint8)
    known[found.column("byte").to_numpy()] = found.column("bits").to_numpy()
    return known


def alike(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose whole sets share ``least`` percent of their union.

    Only sets on a pair are shuffled where their number is small.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    used = sets.join(ends, "node", "left_semi")
    both = pairs.join(used.select(F.col("node").alias("a"), F.col("held").alias("x")), "a")
    both = both.join(used.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(100 * shared >= least * (F.size("x") + F.size("y") - shared)).select("a", "b")


def may_be_alike(least: int) -> Column:
    """What sizes, parities and signatures of ``x`` and ``y`` tell of a pair.

    Alike sets have sizes in that ratio and differ in (100 - least) / (100 + least) of both
    at most, which their parities never exceed: neither rules out an alike pair.
    """
    smaller, larger = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    odd = sum((F.bit_count(F.col("x.odd")[i].bitwiseXOR(F.col("y.odd")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    few = odd * (100 + least) <= (100 - least) * (F.col("x.n") + F.col("y.n"))
    return (100 * smaller >= least * larger) & few & (apart("x.sign", "y.sign") <= MOST_APART)


def central_codes(members: DataFrame) -> DataFrame:
    """``node`` and a ``code`` that is largest for nodes that meet most others in their bands.

    Edited copies of one text share more bands with it than with each other, so the text
    is likely to lead them.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    met = members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("met"))
    many = F.least(F.col("met"), F.lit((1 << 30) - 1))
    return met.select("node", F.shiftleft(many, 33).bitwiseOR(F.shiftrightunsigned(F.xxhash64("node"), 31)).alias("code"))


def led_pairs(members: DataFrame, traits: DataFrame, draw: int, least: int) -> DataFrame:
    """For each node the likeliest partner among the leaders of its open keys.

    A key is led by its member of largest code in the first round, and of largest hash in
    the others. The aggregate that finds it holds one long a key and is combined before
    the shuffle.
    """
    code = F.col("code") if draw == 0 else F.xxhash64("node", F.lit(draw))
    coded = members.select("key", "node", "root", code.alias("code"))
    open_keys = coded.groupBy("key").agg(F.max("code").alias("lead"), F.min("root").alias("low"), F.max("root").alias("high"))
    open_keys = open_keys.where("low < high").select("key", "lead")
    leads = traits.select(code.alias("lead"), F.struct("node", "n", "sign", "odd", "root").alias("y"))
    pairs = coded.join(open_keys, "key").where("code <> lead").select("node", "lead").distinct()
    both = pairs.join(traits.select("node", F.struct("n", "sign", "odd", "root").alias("x")), "node").join(leads, "lead")
    both = both.where((F.col("x.root") != F.col("y.root")) & may_be_alike(least))
    likely = F.min(F.struct(apart("x.sign", "y.sign").alias("apart"), F.col("y.node").alias("lead"))).alias("best")
    best = both.groupBy("node").agg(likely).select("node", F.col("best.lead").alias("lead"))
    return best.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def open_pairs(members: DataFrame, traits: DataFrame, least: int) -> DataFrame:
    """Every pair of a key that is of different components and may be alike.

    A key of more than ``CELL`` nodes is cut by the other bands first: two alike sets that
    meet there share a second band with a probability of 1 - 3e-9. What is still large meets
    in several tasks, one side dealt out to them and the other sent to each, so no pair is
    lost and no task holds a key.
    """
    open_keys = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
    open_keys = materialise(open_keys.where("low < high").select("key", "size"))
    held = members.join(open_keys, "key").select("key", "node", "size")
    crowded = materialise(held.where(F.col("size") > CELL).select("key", "node"))
    held = held.where(F.col("size") <= CELL).select("key", "node")
    if not crowded.isEmpty():
        others = members.select("node", F.col("key").alias("other"))
        finer = crowded.join(others, "node").where("key <> other")
        finer = finer.select(F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"), "node").distinct()
        held = held.union(finer)
    held = held.join(traits.drop("code"), "node")
    sizes = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
    sizes = sizes.where("low < high").select("key", F.ceil(F.col("size") / CELL).cast("long").alias("cells"))
    held = materialise(held.join(sizes, "key"))
    x = held.withColumn("cell", F.pmod(F.xxhash64("node"), "cells")).alias("x")
    y = held.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).alias("y")
    pairs = x.join(
        y.hint("merge"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.cell") == F.col("y.cell"))
        & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & may_be_alike(least),
    )
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, least: int = 80) -> DataFrame:
    """Near-duplicate group of every row of ``docs``.

    Two texts are linked if their sets of distinct four-word shingles share ``least``
    percent of their union or more; a group is all that links reach. Returns ``doc_id``,
    ``n_shingles``, ``component_id`` (smallest ``doc_id`` of the group) and ``kept`` (the
    row has that id).

    Texts of one set are one node. Nodes meet if they share a band of minima: at a
    similarity of 0.8 they share none with a probability of 1.6e-9. Links that save
    most others come first: in each round every node tries its likeliest partner among
    the leaders of its bands. Then every pair still in different components is tried whose
    sizes, parities and signatures allow it. A link counts only if the whole sets agree.

    Words are lower-cased in A-Z. Texts without words (null, empty, white space) are
    linked with nothing, each its own group. Null ids name no group: ``component_id`` is
    null where a group has no other, and such a row is kept then only. Repeated rows come
    out as often as they came in. Other columns are not looked at; an empty table gives no
    row.
    """
    marks = materialise(sketches(docs))
    nodes = marks.where("n > 0")
    named = materialise(nodes.groupBy("node").agg(F.min("doc_id").alias("first")))
    held = materialise(nodes.select("node", "n", "keys", "sign", "odd").dropDuplicates(["node"]))
    keyed = held.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    meeting = materialise(keyed.join(shared, "key", "left_semi").select("key", "node"))
    met = meeting.select("node").distinct()
    held = materialise(held.join(met, "node", "left_semi").select("node", "n", "sign", "odd"))
    if held.isEmpty():
        return _grouped(marks, named.select("node", F.col("first").alias("component_id")))
    sets = materialise(sets_of(docs, held))
    codes = materialise(central_codes(meeting))
    held, meeting = materialise(held.join(codes, "node")), materialise(meeting.join(codes, "node"))
    roots = links = None
    for draw in range(ROUNDS + 1):
        if roots is None:
            traits, members = held.withColumn("root", F.col("node")), meeting.withColumn("root", F.col("node"))
        else:
            traits, members = with_roots(held, roots), with_roots(meeting, roots)
        traits, members = materialise(traits), materialise(members)
        if draw < ROUNDS:
            pairs = led_pairs(members, traits, draw, least)
        else:
            pairs = open_pairs(members, traits, least)
        pairs = materialise(pairs)
        if pairs.isEmpty():
            if draw == ROUNDS:
                break
            continue
        found = materialise(alike(pairs, sets, least))
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            roots = materialise(connected(links))
    if roots is None:
        return _grouped(marks, named.select("node", F.col("first").alias("component_id")))
    rooted = with_roots(named, roots)
    least_id = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return _grouped(marks, rooted.join(least_id, "root").select("node", "component_id"))


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their node, the node itself where it has no link."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _grouped(marks: DataFrame, groups: DataFrame) -> DataFrame:
    rows = marks.select("doc_id", "node", "n").join(groups, "node", "left")
    group = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
