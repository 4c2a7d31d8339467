"""Repeated passages by merging the Burrows-Wheeler transforms of text shards.

A string of ``width`` bytes that occurs twice has the same anchor in both places: the
k-byte word of smallest hash in it. So texts are cut into the stretches around their
anchors, stretches of one anchor go to one task, and only there suffixes are ordered:
each shard of stretches has its transform built once, and shards are merged by
refining how they interleave. Suffixes of different anchors are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import map_rows
from riskloom.session import materialise

WIDTH = 100
#: Bytes of an anchor word; stretches are up to 2 * WIDTH - WORD bytes long.
WORD = 24
#: Bytes of stretches that make a shard, and shards that one merge takes.
SHARD_BYTES, MERGE_SHARDS = 1 << 18, 16
STEP = 8
#: Windows looked at together; a longer text is taken in such pieces.
PIECE = 1 << 23
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``WORD`` bytes at each place of ``raw``, by doubling spans."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _M1
    h ^= h >> np.uint64(31)
    span = {}
    size = 1
    while size <= WORD:
        span[size] = h
        if 2 * size <= WORD:
            h = h[:-size] * _M2 + (h[size:] ^ (h[size:] >> np.uint64(29))) * _M1
        size *= 2
    out, at = None, 0
    n = len(raw) - WORD + 1
    for size in sorted(span, reverse=True):
        if WORD & size:
            part = span[size][at : at + n]
            out = part if out is None else out * _M2 + (part ^ (part >> np.uint64(29)))
            at += size
    return out ^ (out >> np.uint64(32))


def anchors(raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last, at) of the anchors of ``width`` bytes or more, fewer than 2^24.

    Windows ``first`` to ``last`` have their smallest word hash at ``at``, the first of
    equals.
    """
    hashes = word_hashes(raw)
    order = (hashes & ~np.uint64(0xFFFFFF)) | (np.arange(len(hashes), dtype=np.uint64) & np.uint64(0xFFFFFF))
    span = width - WORD + 1
    least, size = order, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(raw) - width + 1
    least = np.minimum(least[:n], least[span - size : span - size + n])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], n] - 1
    at = first + ((least[first] - first.astype(np.uint64)) & np.uint64(0xFFFFFF)).astype(np.int64)
    return hashes[at], first, last, at


def stretch_hashes(raw: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes ``first`` to ``stop``."""
    data = raw.tobytes()
    made = (blake2b(data[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), stop.tolist()))
    return np.frombuffer(b"".join(made), np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """``who`` (id and 32 bits of the text's hash) and ``text`` of every row."""
    text_hash = F.xxhash64("text").bitwiseAND(0xFFFFFFFF)
    return docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash")).alias("who"), "text")


MARKS = "key long, seg long, doc_id long, place long, shape int"


def mark_rows(key, seg, doc_id, place, shape) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    columns = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip((key, seg, doc_id, place, shape), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["key", "seg", "doc_id", "place", "shape"])


def anchored(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each anchor: ``key``, ``seg`` (hash of its stretch), ``doc_id``, ``place``, ``shape``.

    ``place`` is the text's hash and, in the lower 31 bits, the stretch's start. ``shape``
    holds its size and, in the lower 12 bits, the anchor's place in it. Of equal
    stretches of a batch only the first is sent on. The others are repeats whatever else
    there is: they come as spans, joined where they touch, with a zero ``shape`` and
    their end as ``seg``. Texts under ``width`` bytes have no anchor.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).field(0)
        hashes = batch.column(0).field(1).to_numpy()
        out = []
        for i, text in enumerate(batch.column(1)):
            raw = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            for begin in range(0, len(raw) - width + 1, PIECE):
                key, first, last, at = anchors(raw[begin : begin + PIECE + width - 1], width)
                seg = stretch_hashes(raw, begin + first, begin + last + width)
                out.append((np.full(len(key), i), key.view(np.int64), seg, begin + first, last + width - first, at - first))
        if not out:
            return
        row, key, seg, first, size, at = (np.concatenate(c) for c in zip(*out))
        place = hashes[row] << 31 | first
        age = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
        order = np.lexsort((place, age[row], seg, key))
        again = np.r_[False, (key[order][1:] == key[order][:-1]) & (seg[order][1:] == seg[order][:-1])]
        new, old = order[~again], np.sort(order[again])
        for start in range(0, len(new), 100_000):
            at_ = new[start : start + 100_000]
            yield mark_rows(key[at_], seg[at_], ids.take(pa.array(row[at_])), place[at_], size[at_] << 12 | at[at_])
        if len(old):
            opens = np.r_[True, (row[old][1:] != row[old][:-1]) | (first[old][1:] > (first + size)[old][:-1])]
            start, stop = old[opens], (first + size)[old][np.r_[opens[1:], True]]
            yield mark_rows(place[start] * 31 + age[row[start]], stop, ids.take(pa.array(row[start])), place[start], np.zeros(len(start), np.int32))

    return map_rows(keyed(docs), run, MARKS)


def sorted_out(marks: DataFrame) -> DataFrame:
    """Repeated spans (as in ``anchored``) and the first of each different stretch of shared anchors.

    A task reads its anchors in order and keeps one row in memory. A stretch found
    before is a span; the first stretch of an anchor is passed on when a second differs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the first stretch of the last anchor, while it is the only one
        last_key = last_seg = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, seg, shape = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_numpy()
            place = batch.column(3).to_numpy()
            span = shape == 0
            same_key = np.r_[not span[0] and key[0] == last_key, (key[1:] == key[:-1]) & ~span[1:] & ~span[:-1]]
            same = same_key & np.r_[seg[0] == last_seg, seg[1:] == seg[:-1]]
            groups = np.cumsum(~same_key)
            several = np.zeros(groups[-1] + 1, bool)
            several[groups[same_key & ~same]] = True
            fresh = ~same & ~span
            continued = same_key[0]
            if continued and several[0] and held is not None:
                yield held
                held = None
            if not continued:
                held = None
            keep = fresh & several[groups]
            if continued and held is None and last_several:
                keep |= fresh & (groups == 0)
            at = np.flatnonzero(keep)
            if len(at):
                yield batch.take(pa.array(at))
            at = np.flatnonzero(same)
            if len(at):
                begin = place[at] & 0x7FFFFFFF
                yield mark_rows(key[at], begin + (shape[at] >> 12), batch.column(2).take(pa.array(at)), place[at], np.zeros(len(at), np.int32))
            at = np.flatnonzero(span)
            if len(at):
                yield batch.take(pa.array(at))
            final = groups[-1]
            last_several = several[final] or (continued and final == 0 and last_several)
            if not (continued and final == 0):
                first = np.flatnonzero(groups == final)[0]
                held = None if last_several or span[first] else batch.slice(int(first), 1)
            last_key, last_seg = (None, None) if span[-1] else (key[-1], seg[-1])

    dealt = marks.repartition("key").sortWithinPartitions(
        "key", (F.col("shape") == 0), "seg", F.col("doc_id").asc_nulls_first(), "place"
    )
    return dealt.mapInArrow(run, MARKS)


class Shard:
    """Suffix order and transform of a few stretches, each closed by an end mark."""

    def __init__(self, parts: list[bytes], width: int):
        closed = [p + b"\0" * STEP for p in parts]
        self.text = np.frombuffer(b"".join(closed), np.uint8)
        sizes = np.array([len(c) for c in closed])
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        length = np.repeat(sizes, sizes)
        place = np.arange(len(self.text))
        # a suffix goes round within its own stretch
        go = lambda by: start + (place - start + by) % length
        code = np.zeros(len(place), np.uint64)
        for i in range(STEP):
            code = code << np.uint64(8) | self.text[go(i)].astype(np.uint64)
        rank = np.unique(code, return_inverse=True)[1]
        have = STEP
        while have < width:
            other = rank[go(have)]
            rank = np.unique(rank * np.int64(len(place) + 1) + other, return_inverse=True)[1]
            have *= 2
        self.order = np.argsort(rank, kind="stable")
        self.before = code[go(-STEP)[self.order]]
        self.start, self.rank_code = start, code


def merge(shards: list[Shard], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaving of the shards' suffixes and the repeated interval of each place.

    Pass h has the suffixes in the order of their first h bytes, known only by which
    shard each place takes its next suffix from. Dealing that sequence out by the
    ``STEP`` bytes before each suffix, stably, gives the order by h + STEP bytes, so no
    suffix is sorted again. Where neighbours first differ ends their common prefix:
    places not parted after ``width`` bytes share an interval.
    """
    codes, at = np.unique(np.concatenate([s.before for s in shards]), return_inverse=True)
    before = np.split(at.astype(np.int32), np.cumsum([len(s.before) for s in shards])[:-1])
    begin = width % STEP
    # the order by the first few bytes, each shard being in order itself
    head = np.concatenate([s.rank_code[s.order] >> np.uint64(8 * (STEP - begin)) if begin else np.zeros(len(s.order), np.uint64) for s in shards])
    source = np.repeat(np.arange(len(shards)), [len(s.order) for s in shards])
    by = np.argsort(head, kind="stable")
    mix, head = source[by].astype(np.uint16), head[by]
    interval = np.cumsum(np.r_[0, head[1:] != head[:-1]])
    for _ in range(width // STEP):
        # suffixes of a shard come in its order: the i-th place of a shard is its i-th suffix
        byshard = np.argsort(mix, kind="stable")
        sequence = np.empty(len(mix), np.int32)
        sequence[byshard] = np.concatenate(before)
        by = radix_order(sequence)
        mix, sequence, interval = mix[by], sequence[by], interval[by]
        interval = np.cumsum(np.r_[0, (sequence[1:] != sequence[:-1]) | (interval[1:] != interval[:-1])])
    return mix, interval


def repeated_windows(stretches: list[tuple[bytes, int]], width: int) -> list[np.ndarray]:
    """For each (bytes, age) stretch, which of its windows an older stretch holds too.

    Ages are distinct; the interval's oldest stretch keeps its window, the others
    lose theirs. A window occurs in a stretch at one place only.
    """
    shards, members, held = [], [], 0
    group: list[int] = []
    most = max(SHARD_BYTES, sum(len(raw) + STEP for raw, _ in stretches) // MERGE_SHARDS)
    for i, (raw, _) in enumerate(stretches):
        group.append(i)
        held += len(raw) + STEP
        if held >= most or i == len(stretches) - 1:
            members.append(group)
            shards.append(Shard([stretches[j][0] for j in group], width))
            group, held = [], 0
    mix, interval = merge(shards, width)
    byshard = np.argsort(mix, kind="stable")
    place = np.concatenate([s.order for s in shards])
    owner, offset = [], []
    for shard, mine in zip(shards, members):
        sizes = np.array([len(stretches[j][0]) + STEP for j in mine])
        owner.append(np.repeat(np.array(mine), sizes)[shard.order])
        offset.append(shard.order - shard.start[shard.order])
    owner, offset, interval = np.concatenate(owner), np.concatenate(offset), interval[byshard]
    size = np.array([len(s[0]) for s in stretches])
    age = np.array([s[1] for s in stretches])
    real = offset <= size[owner] - width
    owner, offset, interval = owner[real], offset[real], interval[real]
    oldest = np.full(interval.max(initial=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(oldest, interval, age[owner])
    late = age[owner] > oldest[interval]
    out = [np.zeros(max(0, n - width + 1), bool) for n in size.tolist()]
    for j, k in zip(owner[late].tolist(), offset[late].tolist()):
        out[j][k] = True
    return out


def alike_by(keys: np.ndarray, sides: list[bytes], width: int) -> np.ndarray:
    """Longest prefix, up to ``width``, that each string shares with another of its key."""
    text = np.array(sides, f"S{width}")
    order = np.lexsort((text, keys))
    size = np.minimum(np.array(list(map(len, sides))), width)[order]
    grid = text[order].view(np.uint8).reshape(len(sides), width)
    same = np.minimum.accumulate(grid[1:] == grid[:-1], axis=1).sum(axis=1)
    same = np.minimum(np.minimum(same, size[1:]), size[:-1])
    same[keys[order][1:] != keys[order][:-1]] = 0
    out = np.zeros(len(sides), np.int64)
    out[order] = np.maximum(np.r_[0, same], np.r_[same, 0])
    return out


def shareable(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each stretch that others of its anchor may share windows with.

    A shared window holds the anchor, so it reaches no further to either side than
    the stretch agrees with some other there.
    """
    keys = np.array([r[0] for r in rows])
    at = np.array([r[4] for r in rows])
    right = alike_by(keys, [r[5][r[4] :] for r in rows], 2 * width)
    left = alike_by(keys, [r[5][: r[4]][::-1] for r in rows], width)
    return at - left, at + right


def radix_order(values: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative integers, 16 bits at a time."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    high = values >> 16
    while high.any():
        order = order[np.argsort((high & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        high = high >> 16
    return order


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
    return edge[::2], edge[1::2]


def repeats(docs: DataFrame, width: int = WIDTH, most: int = 20_000) -> DataFrame:
    """``who``, ``start``, ``stop``: bytes covered by an earlier window.

    A stretch that occurs again is covered whole, its first place apart. The first
    places of an anchor's different stretches are then compared. Anchors with more
    than ``most`` different stretches are cut up: their windows meet by hash, which
    spreads over tasks and combines before the shuffle. Earlier means a smaller id
    (null first), then text hash, then place; rows equal in id and text count as one
    document.
    """
    marks = materialise(sorted_out(anchored(docs, width)))
    who = F.struct("doc_id", F.shiftright("place", 31).alias("text_hash")).alias("who")
    first = F.col("place").bitwiseAND(0x7FFFFFFF).cast("int")
    copies = marks.where("shape = 0").select(who, first.alias("start"), F.col("seg").cast("int").alias("stop"))
    mixed = marks.where("shape > 0").select("key", who, first.alias("first"), "shape")
    crowded = materialise(mixed.groupBy("key").count().where(F.col("count") > most).select("key"))
    if crowded.isEmpty():
        return copies.unionByName(merged(stretches_of(docs, mixed), width))
    # both read the texts in the same way, so that they are moved once
    usual = merged(stretches_of(docs, mixed.join(crowded, "key", "left_anti")), width)
    many = windows_met(stretches_of(docs, mixed.join(crowded, "key", "left_semi")), width)
    return copies.unionByName(usual).unionByName(many)


CUT = "key long, doc_id long, text_hash long, first int, at int, raw binary"


def stretches_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` with ``raw``, the bytes from ``first`` on; a document's places travel together."""
    found = places.groupBy("who").agg(F.collect_list(F.struct("key", "first", "shape")).alias("places"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for who, text, list_ in zip(batch.column(0), batch.column(1), batch.column(2)):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            who = who.as_py()
            for p in list_.as_py():
                first, shape = p["first"], p["shape"]
                out.append((p["key"], who["doc_id"], who["text_hash"], first, shape & 4095, raw[first : first + (shape >> 12)]))
            if len(out) > 20_000:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["key", "doc_id", "text_hash", "first", "at", "raw"])

    return map_rows(keyed(docs).join(found, "who").select("who", "text", "places"), run, CUT)


SPANS = "who struct<doc_id:long,text_hash:long>, start int, stop int"


def span_rows(out: list) -> pa.RecordBatch:
    doc, text, start, stop = zip(*out)
    who = pa.StructArray.from_arrays([pa.array(doc, pa.int64()), pa.array(text, pa.int64())], ["doc_id", "text_hash"])
    return pa.RecordBatch.from_arrays([who, pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["who", "start", "stop"])


def merged(cut: DataFrame, width: int, chunk: int = 1 << 20) -> DataFrame:
    """Covered spans of the stretches in ``cut``, compared within their anchor.

    A task takes whole anchors until they hold ``chunk`` bytes and merges their shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        held, last, last_row = 0, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] == last_row:
                    continue  # a row given twice
                last_row = row[:4]
                if row[0] != last and held >= chunk:
                    yield from spans(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[5])
                last = row[0]
        if rows:
            yield from spans(rows)

    def spans(rows: list) -> Iterator[pa.RecordBatch]:
        # rows come by anchor and age, so their number is an age within an anchor
        begin, stop = shareable(rows, width)
        live = np.flatnonzero(stop - begin >= width).tolist()
        if not live:
            return
        parts = [(rows[i][5][begin[i] : stop[i]], i) for i in live]
        out = []
        for i, marks in zip(live, repeated_windows(parts, width)):
            _, doc, text, first, *_ = rows[i]
            for a, b in zip(*(x.tolist() for x in runs(marks))):
                out.append((doc, text, first + int(begin[i]) + a, first + int(begin[i]) + b - 1 + width))
        if out:
            yield span_rows(out)

    dealt = cut.select("key", "doc_id", "text_hash", "first", "at", "raw").repartition("key")
    ordered = dealt.sortWithinPartitions("key", F.col("doc_id").asc_nulls_first(), "text_hash", "first")
    return ordered.mapInArrow(run, SPANS)


def windows_met(cut: DataFrame, width: int) -> DataFrame:
    """As ``merged``, for anchors of very many different stretches: window by window."""
    window = F.substring("raw", F.col("i") + 1, F.lit(width))
    each = (
        cut.dropDuplicates(["key", "doc_id", "text_hash", "first"])
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.octet_length("raw") - width)))
        .select(
            F.struct(F.xxhash64(window), F.xxhash64(F.lit(1), window)).alias("window"), "key",
            F.struct("doc_id", "text_hash", (F.col("first") + F.col("i")).alias("start")).alias("who"),
        )
    )
    first = each.groupBy("key", "window").agg(F.min("who").alias("oldest"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = each.join(first, ["key", "window"]).where("who <> oldest")
    place = F.struct("who.doc_id", "who.text_hash").alias("who")
    return late.select(place, F.col("who.start").alias("start"), (F.col("who.start") + width).cast("int").alias("stop"))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the bytes that repeat: ``doc_id``, ``n_bytes``, ``spans``, ``kept`` (binary).

    ``spans`` are the maximal removed runs. One row comes out for each that came in; a
    null text counts as empty. Extra columns are ignored.
    """
    spans = repeats(docs, width)
    lists = spans.groupBy("who").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        removed, kept, sizes = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            covered = np.zeros(len(raw) + 1, np.int32)
            if spans.is_valid:
                held = spans.values
                np.add.at(covered, held.field(0).to_numpy(), 1)
                np.add.at(covered, held.field(1).to_numpy(), -1)
            gone = np.cumsum(covered[:-1]) > 0
            a, b = runs(gone)
            removed.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist())])
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(a) else raw)
            sizes.append(len(raw))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).field(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )

    joined = keyed(docs).join(lists, "who", "left").select("who", "text", "spans")
    return map_rows(joined, run, "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")
