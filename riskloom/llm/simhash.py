"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import connected, map_rows, plain_names
from riskloom.session import materialise

BITS = 64
FANOUT = 8


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of the word shingles of one text, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space. Fewer words than
    ``width`` give one shingle, no word gives zero. A bit is set if more than half
    of the shingle hashes (XXH64, seed 42) set it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, n, 65536):
        part = hashes[start : start + 65536].view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and signed 64-bit ``fp`` of every row; null text counts as empty."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.fromiter(
            (fingerprint(t.as_py() or "", width) for t in batch.column(1)), np.uint64, batch.num_rows
        )
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_rows(rows, run, "doc_id long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def settle(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest label reachable over the edges ``a``-``b``, by label spreading and jumps."""
    label = label.copy()
    while len(a):
        la, lb = label[a], label[b]
        differs = la != lb
        if not differs.any():
            break
        la, lb = la[differs], lb[differs]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        parent = np.arange(n)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]
    return label


class GrayIndex:
    """Groups of fingerprints in Gray order with the bits that all below them share.

    ``keys`` sets fingerprints apart: only those of one key are compared. Level 0
    holds the fingerprints, each upper node up to eight nodes of the level below.
    """

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        self.order = order = np.lexsort((gray_rank(fps), keys))
        self.keys, self.fps = keys[order], fps[order]
        self.levels = []
        group = np.unique(self.keys, return_inverse=True)[1]
        first = np.arange(len(fps))
        conj = disj = self.fps
        size = np.ones(len(fps), np.int64)
        self.levels.append((first, size, conj, disj, group))
        while len(group) and np.bincount(group).max() > 1:
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            within = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
            first = np.flatnonzero(within % FANOUT == 0)
            conj, disj = np.bitwise_and.reduceat(conj, first), np.bitwise_or.reduceat(disj, first)
            size = np.diff(np.r_[first, len(group)])
            group = group[first]
            self.levels.append((first, size, conj, disj, group))

    def components(self, bits: int, known: np.ndarray | None = None, pairs: list | None = None) -> np.ndarray:
        """Label of each fingerprint (in index order): linked ones share it.

        ``known`` are labels found before. ``pairs`` collects the pairs that joined
        labels, at most 200,000 beyond a joining of all that share one.

        Differences add up on the bits two nodes fix. Too many rule the pair out;
        so few that even all free bits keep the bound link it whole; and two nodes
        already in one component need no look.
        """
        n = len(self.fps)
        near = np.bitwise_count(self.fps[1:] ^ self.fps[:-1]) <= bits
        near &= self.keys[1:] == self.keys[:-1]
        near = np.flatnonzero(near)
        label = settle(n, near, near + 1, np.arange(n) if known is None else known)
        if pairs is not None:
            pairs.append((near, near + 1))
        top = len(self.levels) - 1
        if top <= 0:
            return label
        spans = self._spans()
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        found_a, found_b = [], []
        held = 0
        while stack:
            level, a, b = stack.pop()
            if len(a) > 16384:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            low, high = self._bounds(level, label, spans)
            alike = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            a, b = a[~alike], b[~alike]
            _, _, conj, disj, _ = self.levels[level]
            fixed = ~(conj ^ disj)
            shared = fixed[a] & fixed[b]
            apart = np.bitwise_count((conj[a] ^ conj[b]) & shared)
            free = np.bitwise_count(~shared)
            whole = apart.astype(np.int64) + free <= bits
            start, stop = spans[level]
            if whole.any():
                x, y = a[whole], b[whole]
                inner = np.unique(np.r_[x, y])
                length = stop[inner] - start[inner]
                into = np.repeat(start[inner], length)
                found_a += [start[x], into]
                found_b += [start[y], into + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
                held += len(into) + len(x)
            deeper = (apart <= bits) & ~whole
            a, b = a[deeper], b[deeper]
            if level and len(a):
                first, size, *_ = self.levels[level]
                i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
                ok = (i[None] < size[a][:, None]) & (j[None] < size[b][:, None])
                ok &= (a != b)[:, None] | (i <= j)[None]
                ca, cb = (first[a][:, None] + i[None])[ok], (first[b][:, None] + j[None])[ok]
                if level == 1:
                    ca, cb = ca[ca != cb], cb[ca != cb]
                stack.append((level - 1, ca, cb))
            if found_a and (held > 200_000 or not stack):
                at, to = np.concatenate(found_a), np.concatenate(found_b)
                if pairs is not None:
                    pairs.append((at, to))
                label = settle(n, at, to, label)
                found_a, found_b, held = [], [], 0
        return label

    def forest(self, bits: int, step: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs that connect each component, closer pairs before farther ones."""
        n = len(self.fps)
        label, tree = np.arange(n), []
        for limit in range(bits % step, bits + 1, step):
            pairs: list = []
            after = self.components(limit, label, pairs)
            at, to = (np.concatenate(side) for side in zip(*pairs))
            new = label[at] != label[to]
            at, to = at[new], to[new]
            root = dict(zip(label[at].tolist(), label[at].tolist())) | dict(zip(label[to].tolist(), label[to].tolist()))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            near = np.argsort(np.bitwise_count(self.fps[at] ^ self.fps[to]), kind="stable")
            for x, y in zip(at[near].tolist(), to[near].tolist()):
                u, v = top(int(label[x])), top(int(label[y]))
                if u != v:
                    root[u] = v
                    tree.append((x, y))
            label = after
        found = np.array(tree, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def hub(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the member nearest to each key's majority bits with that key's other members."""
        starts = np.flatnonzero(np.r_[True, self.keys[1:] != self.keys[:-1]]) if len(self.keys) else np.zeros(0, int)
        size = np.diff(np.r_[starts, len(self.keys)])
        ones = np.add.reduceat(np.unpackbits(self.fps.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32), starts)
        middle = np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64).ravel()
        group = np.repeat(np.arange(len(starts)), size)
        off = np.bitwise_count(self.fps ^ middle[group])
        first = np.lexsort((self.fps, off, group))[starts]
        at, to = np.arange(len(group)), first[group]
        close = (at != to) & (np.bitwise_count(self.fps[at] ^ self.fps[to]) <= bits)
        return at[close], to[close]

    def _spans(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """First and one past the last fingerprint below each node, by level."""
        start = np.arange(len(self.fps))
        spans = [(start, start + 1)]
        for first, *_ in self.levels[1:]:
            start, stop = spans[-1]
            spans.append((start[first], np.r_[start[first][1:], len(self.fps)]))
        return spans

    def _bounds(self, level: int, label: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray]:
        start = spans[level][0]
        return np.minimum.reduceat(label, start), np.maximum.reduceat(label, start)


def _parts(bits: int, width: int) -> list[tuple[int, int]]:
    """(offset, length) of ``bits`` parts that cover ``width`` bits."""
    edges = [round(i * width / bits) for i in range(bits + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def links(fps: DataFrame, bits: int = 3, split_rows: int = 4096, depth: int = 2) -> DataFrame:
    """Edges ``a``-``b`` that connect all distinct fingerprints ``bits`` or fewer bits apart.

    Two such fingerprints agree in at least one of ``bits + 1`` parts, so each part's
    value names a group and every link lies within some group. A group of over
    ``split_rows`` is cut again by parts of its remaining bits, ``depth`` times at
    most; no link is lost, as the differences still miss one of those parts. Within a
    group the Gray-order index links; a task returns one edge for each fingerprint
    and group at most, not pairs.
    """

    def part_of(column: str, offset: int, length: int):
        return F.shiftrightunsigned(F.col(column), offset).bitwiseAND((1 << length) - 1)

    parts = _parts(bits + 1, BITS)
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).cast("long").alias("key"), part_of("fp", o, n).alias("value"),
                               F.lit(i).alias("outer")) for i, (o, n) in enumerate(parts)])
        ).alias("p"),
    ).select("fp", F.xxhash64("p.key", "p.value").alias("key"), F.col("p.outer").alias("used"))
    done = None
    for level in range(depth):
        keyed = materialise(keyed)
        crowded = materialise(keyed.groupBy("key").count().where(F.col("count") > split_rows).select("key"))
        if crowded.isEmpty():
            break
        light = keyed.join(crowded, "key", "left_anti").select("fp", "key")
        done = light if done is None else done.union(light)
        heavy = keyed.join(crowded, "key")
        pieces = []
        for used in range((bits + 1) ** (level + 1)):
            rest = _free_bits(used, level + 1, bits)
            for i, (o, n) in enumerate(_parts(bits + 1, len(rest))):
                value = F.lit(0).cast("long")
                for k, bit in enumerate(rest[o : o + n]):
                    value = value.bitwiseOR(F.shiftleft(part_of("fp", bit, 1), k))
                pieces.append((used, i, value))
        chosen = F.array(*[F.struct(F.lit(used).alias("from"), F.lit(used * (bits + 1) + i).alias("used"),
                                    value.alias("value")) for used, i, value in pieces])
        keyed = (
            heavy.select("fp", "key", F.col("used").alias("was"), F.explode(F.filter(chosen, lambda x: x["from"] == F.col("used"))).alias("p"))
            .select("fp", F.xxhash64("key", "p.used", "p.value").alias("key"), F.col("p.used").alias("used"))
        )
    rows = keyed.select("fp", "key") if done is None else done.union(keyed.select("fp", "key"))

    return index_links(rows, bits)


def _free_bits(used: int, levels: int, bits: int) -> list[int]:
    """Bits not yet fixed by the parts chosen so far (their numbers packed in ``used``)."""
    choices = []
    for _ in range(levels):
        used, last = divmod(used, bits + 1)
        choices.append(last)
    free = list(range(BITS))
    for choice in reversed(choices):
        o, n = _parts(bits + 1, len(free))[choice]
        free = free[:o] + free[o + n :]
    return free


def near_groups(prints: DataFrame, bits: int = 3) -> DataFrame:
    """``prints`` (``doc_id``, ``fp``) with ``component_id``, the smallest id reachable.

    Copies share a fingerprint and fold into one node first. Rows with a null id
    belong to groups like others but never name one; a group of such rows only has a
    null ``component_id``. Repeated rows come out as often as they came in.
    """
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(nodes.select("fp"), bits))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = materialise(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp")


def simhash_groups(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """Fingerprint and near-duplicate group of every row of ``docs``.

    Returns ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``. Extra
    columns of ``docs`` are not looked at; an empty table gives an empty result.
    """
    grouped = near_groups(materialise(fingerprints(docs, width)), bits)
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Of the pipeline's near-duplicate groups: min-wise bands, values in each, and words in a shingle.
BANDS, BAND_ROWS, SHINGLE = 12, 4, 5
#: 64-bit words of parities that rule pairs out, and nodes of one band key on one side of a task's pairs.
PARITY_WORDS, CELL = 16, 2048


def shingles(text: str) -> np.ndarray:
    """Hashes of the distinct five-word shingles of a text; fewer words make one."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    mixed = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for j in range(min(SHINGLE, len(words))):
        mixed = (mixed ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def band_keys(mixed: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set of shingle hashes.

    A key joins ``BAND_ROWS`` min-wise hashes. Sets of similarity 0.8 share a key with
    probability 0.998; at 0.4 it is 0.27.
    """
    draw = np.random.default_rng(5)
    factor = draw.integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(mixed), 4096):
        part = mixed[start : start + 4096, None] * factor[None]
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, part.min(axis=0), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for j, column in enumerate(least.reshape(BANDS, BAND_ROWS).T):
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)
    return (keys ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def set_print(mixed: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, each counted once."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(mixed), 65536):
        part = mixed[start : start + 65536].view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(mixed), bitorder="little").view(np.uint64)[0])


def parities(mixed: np.ndarray) -> np.ndarray:
    """``PARITY_WORDS`` words of bits, each the parity of the hashes that fall on it.

    Two sets' parities differ in no more bits than the sets have members of only one.
    """
    odd = np.bincount((mixed >> np.uint64(17)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``node`` (hash of the shingle set), its ``size``, ``fp``, ``odd`` and ``keys`` of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes, sizes, prints, odd, keys = [], [], [], [], []
        for t in batch.column(2):
            held = shingles(t.as_py() or "")
            nodes.append(xxhash.xxh64_intdigest(held.tobytes()))
            sizes.append(len(held))
            prints.append(set_print(held))
            odd.append(parities(held))
            keys.append(band_keys(held))
        nodes, prints = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints))
        odd, keys = (pa.array(x, pa.list_(pa.int64())) for x in (odd, keys))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], nodes, pa.array(sizes, pa.int64()), prints, odd, keys],
            ["doc_id", "text_hash", "node", "size", "fp", "odd", "keys"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(rows, run, "doc_id long, text_hash long, node long, size long, fp long, odd array<bigint>, keys array<bigint>")


def index_links(rows: DataFrame, bits: int, closest: bool = False, node: str = "fp") -> DataFrame:
    """Edges that connect the fingerprints of each ``key`` of ``rows`` ``bits`` or fewer apart.

    An edge names its ends by their ``node``. ``closest`` returns linked pairs, the closer ones first choice, and those with the
    middle of each key's fingerprints; otherwise each fingerprint comes with the first
    of its component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        index = GrayIndex(table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64))
        name = table.column("name").to_numpy()[index.order]
        if closest:
            at, to = (np.concatenate(sides) for sides in zip(index.forest(bits), index.hub(bits)))
        else:
            to = index.components(bits)
            at = np.flatnonzero(to != np.arange(len(to)))
            to = to[at]
        for start in range(0, len(at), 100_000):
            part = slice(start, start + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(name[at[part]]), pa.array(name[to[part]])], ["a", "b"])

    return rows.select("key", "fp", F.col(node).alias("name")).repartition("key").mapInArrow(run, "a long, b long")


def open_links(nodes: DataFrame, traits: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs of a ``key`` of ``nodes`` that are of different components in ``roots`` and may be ``least`` alike.

    ``traits`` has ``size`` and ``odd`` of each node. Keys whose nodes are all in one
    component are left out before the shuffle. No pair that is ``least`` alike is: sets
    that alike have sizes in that ratio at least, and differ in no more than
    (1 - least) / (1 + least) of both sizes, which their parities never exceed. A key
    of over ``CELL`` nodes meets in several tasks: its one side is dealt out to them, the
    other sent to each.
    """
    marked = nodes.join(roots, "node", "left")
    marked = materialise(marked.select("key", "node", F.coalesce("root", "node").alias("root")))
    spread = marked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    spread = spread.where("low < high").select("key", F.ceil(F.col("n") / CELL).cast("long").alias("cells"))
    held = marked.join(spread, "key").join(traits, "node")
    held = materialise(held.select("key", "cells", "node", "root", "size", "odd"))
    x = held.withColumn("cell", F.pmod(F.xxhash64("node"), "cells")).alias("x")
    y = held.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).alias("y")
    apart = sum((F.bit_count(F.col("x.odd")[i].bitwiseXOR(F.col("y.odd")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    both = F.col("x.size") + F.col("y.size")
    pairs = x.join(
        y.hint("merge"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.cell") == F.col("y.cell"))
        & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
        & (F.least("x.size", "y.size") >= least * F.greatest("x.size", "y.size") - 1e-6)
        & (apart <= (1 - least) / (1 + least) * both + 1e-6),
    )
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def alike(docs: DataFrame, named: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Those of ``edges`` whose texts' shingle sets have a similarity of ``least`` or more.

    ``named`` gives each node the id and text hash of one of its documents.
    Only documents on an edge have their shingles worked out.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = pa.array([shingles(t.as_py() or "").view(np.int64) for t in batch.column(2)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], ["doc_id", "text_hash", "set"])

    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    wanted = materialise(ends.join(named, "node").select("node", "who.doc_id", "who.text_hash"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.withColumn("key", F.struct("doc_id", "text_hash"))
    keys = wanted.select(F.struct("doc_id", "text_hash").alias("key"))
    texts = rows.join(keys, "key", "left_semi").select("doc_id", "text_hash", "text")
    sets = map_rows(texts, run, "doc_id long, text_hash long, set array<bigint>")
    sets = sets.select(F.struct("doc_id", "text_hash").alias("key"), "set")
    by_node = wanted.select("node", F.struct("doc_id", "text_hash").alias("key")).join(sets, "key").dropDuplicates(["node"])
    by_node = materialise(by_node.select("node", "set"))
    both = edges.join(by_node.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = both.join(by_node.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= least * (F.size("x") + F.size("y") - shared)).select("a", "b")


def near_dedup(docs: DataFrame, bits: int = 16, least: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group of ``docs``: the one of smallest id.

    Groups to compare come from min-wise band keys of the texts' sets of five-word
    shingles, and fingerprints of the same sets order each group. First come pairs that
    span it, ``bits`` or fewer apart in the Gray-order index, and those with its middle,
    which settle groups of copies in pairs linear in their size. Then comes every pair
    of a group that these left in different components, however many bits apart, but
    those whose sizes or parities rule ``least`` out; so ``bits`` changes the time taken
    and never a link, and no link hides behind a pair that failed. A pair counts if its
    shingle sets are ``least`` alike or more. Texts of
    one shingle set are one node, however many; those that only share a fingerprint are
    nodes of their own. Ties of id go to the smaller text hash, and of repeated rows one
    stays; null ids are the largest. Documents without a word are copies of each other.
    """
    every, names, columns = plain_names(docs)
    docs = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))
    marks = materialise(sketches(docs))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    named = materialise(marks.groupBy("node").agg(F.min(who).alias("who")))
    traits = marks.select("node", "size", "odd").dropDuplicates(["node"])
    nodes = materialise(marks.select("node", "fp", F.explode("keys").alias("key")).dropDuplicates(["node", "key"]))
    # most keys are of one node and have nothing to link
    spread = nodes.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    nodes = materialise(nodes.join(spread.select("key"), "key", "left_semi").select("node", "fp", "key"))
    edges = index_links(nodes, bits, closest=True, node="node")
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    linked = materialise(alike(docs, named, edges, least))
    rest = materialise(open_links(nodes, traits, connected(linked), least).join(edges, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        linked = linked.union(alike(docs, named, rest, least))
    roots = connected(linked)
    keep = named.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    keep = materialise(keep.agg(F.min("who").alias("who")).select(F.struct("who.doc_id", "who.text_hash").alias("__key")))
    key = F.struct(F.col(names["doc_id"]).cast("long").alias("doc_id"), F.xxhash64(names["text"]).alias("text_hash"))
    stays = every.withColumn("__key", key).join(keep, "__key", "left_semi")
    return stays.dropDuplicates(["__key"]).select(*every.columns).toDF(*columns)
