"""Collocations: phrases that are frequent and whose words seldom stand apart.

Rabin-Karp fingerprints of prefix polynomials count word sequences without their text;
text is read again only for fingerprints that are frequent.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.tables import map_rows
from riskloom.session import materialise

#: Words hashed together, bytes of one text split together, words a worker remembers.
BLOCK_WORDS, PART_BYTES, WORDS_KEPT = 1 << 18, 1 << 20, 100_000
#: Bits of the map that tells which fingerprints may be frequent: 8 MB, whatever the input.
MAP_BITS = 26
#: Groups each language's candidates are ranked in first.
RANK_PARTS = 64
#: Odd, so invertible modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BREAK = b"."
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10)
ROWS = "lang string, n int, fp long, low int, high int, f long, pointer int"


class Hashes(dict):
    """128-bit hashes of the words met so far; a break is zero."""

    def __missing__(self, word: bytes) -> bytes:
        digest = xxhash.xxh3_128_digest(word)
        if len(word) < 64:
            if len(self) > WORDS_KEPT:
                self.clear()
                self[BREAK] = bytes(16)
            self[word] = digest
        return digest


def word_runs(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased words of a text with a ``BREAK`` between pieces, a bounded part at a time."""
    raw = (text or "").encode("utf-8").translate(PLAIN)
    start = 0
    while start < len(raw):
        stop = start + PART_BYTES
        if stop < len(raw):
            cut = re.compile(rb"[ \t.]").search(raw, stop)
            stop = cut.start() if cut else len(raw)
        yield raw[start:stop].replace(BREAK, b" . ").split()
        start = stop


class Block:
    """Words of one language, with the document each stands in and whether it is counted here.

    Words before a part's first, repeated from the part before, are not.
    """

    def __init__(self) -> None:
        self.hashes: list[bytes] = []
        self.sizes: list[int] = []
        self.old: list[int] = []
        self.pointers: list[int] = []
        self.held = 0

    def add(self, digests: bytes, old: int, pointer: int) -> None:
        self.hashes += [digests, bytes(16)]
        self.sizes.append(len(digests) // 16 + 1)
        self.old.append(old)
        self.pointers.append(pointer)
        self.held += self.sizes[-1]

    def open(self) -> None:
        both = np.frombuffer(b"".join(self.hashes), np.uint64).reshape(-1, 2)
        size = len(both)
        self.words = (both[:, 0], both[:, 1])
        self.powers, self.inverse, self.prefix = [], [], []
        for base, words in zip(BASES, self.words):
            power = np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)])
            back = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(base, -1, 1 << 64), np.uint64)])
            self.inverse.append(back)
            self.prefix.append(np.r_[np.uint64(0), np.cumsum(words * power[:-1])])
        self.breaks = np.r_[0, np.cumsum((both == 0).all(axis=1))]
        starts = np.cumsum([0, *self.sizes[:-1]])
        self.fresh = np.ones(size, bool)
        for at, old in zip(starts.tolist(), self.old):
            self.fresh[at : at + old] = False
        self.pointer = np.repeat(np.array(self.pointers, np.int32), self.sizes)

    def grams(self, n: int, which: int = 0) -> np.ndarray:
        """Polynomial of the ``n`` words from each position on, from two prefixes of the block."""
        prefix = self.prefix[which]
        return (prefix[n:] - prefix[:-n]) * self.inverse[which][: len(prefix) - n]

    def second(self, n: int) -> np.ndarray:
        """The upper half of the other polynomial; its words have hashes of their own."""
        return (self.grams(n, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def counted(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each position on lie in one piece and end among the fresh ones."""
        return (self.breaks[n:] == self.breaks[:-n]) & self.fresh[n - 1 :]


def blocks(batch: pa.RecordBatch, longest: int, hashes: Hashes) -> Iterator[tuple[str, Block]]:
    """Blocks of the columns language, text and pointer; memory is bounded by ``BLOCK_WORDS``."""
    open_ones: dict[str, Block] = defaultdict(Block)
    held = 0
    for lang, text, pointer in zip(*batch.columns[:3]):
        lang, pointer, before = lang.as_py(), pointer.as_py(), []
        for words in word_runs(text.as_py()):
            run = before + words
            open_ones[lang].add(b"".join(map(hashes.__getitem__, run)), len(before), pointer)
            before = run[-(longest - 1) :] if longest > 1 else []
            held += len(run) + 1
            if held > BLOCK_WORDS:
                yield from _opened(open_ones)
                open_ones, held = defaultdict(Block), 0
    yield from _opened(open_ones)


def _opened(made: dict[str, Block]) -> Iterator[tuple[str, Block]]:
    for lang, block in made.items():
        block.open()
        yield lang, block


def marked(fps: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether the bit of each fingerprint is set in the map ``known``."""
    at = fps >> np.uint64(64 - MAP_BITS)
    return (known[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def map_of(rows: DataFrame, column: str) -> Broadcast:
    """A map of ``2^MAP_BITS`` bits with one set for each value of ``column``, on every executor.

    Its size is fixed. More values only set more bits, which lets more rows through.
    """
    at = F.shiftrightunsigned(F.col(column), 64 - MAP_BITS)
    bits = F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))"))
    found = rows.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(bits.alias("bits")).toArrow()
    known = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    known[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(known)


def prepared(docs: DataFrame) -> DataFrame:
    """Language, text and pointer of every row.

    The pointer is a hash that finds the row again; another row of the same hash is read
    in vain, and has no words of both fingerprints.
    """
    return docs.select(
        F.coalesce(F.col("`lang`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("`text`"), F.lit("")).alias("text"),
        F.shiftright(F.xxhash64(F.col("`doc_id`"), F.col("`text`"), F.col("`lang`")), 32).cast("int").alias("pointer"),
    )


def counts(
    rows: DataFrame, lengths: Sequence[int], least: int, mask: int, known: Broadcast | None = None, base: int = 1
) -> DataFrame:
    """Fingerprints of ``lengths`` words with at least ``least`` places, one row each.

    ``f`` places, ``low`` and ``high`` least and largest second fingerprint, ``pointer``
    a row that holds one. Only sequences all of whose ``base``-word parts are marked in
    ``known`` count. Blocks are aggregated before rows leave the worker, tasks before
    the shuffle. Length 0 counts all words of a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes({BREAK: bytes(16)})
        for batch in batches:
            for lang, block in blocks(batch, max(lengths), hashes):
                may = None if known is None else marked(block.grams(base) & np.uint64(mask), known.value)
                for n in lengths:
                    if n == 0:
                        words = int((block.counted(1)).sum())
                        none = np.zeros(1, np.int32)
                        found = [np.zeros(1, np.int64), none, none, np.array([words]), none]
                    else:
                        found = gathered(block, n, may, base, mask)
                    size = len(found[0])
                    if size:
                        names = pa.array([lang] * size, pa.string()), pa.array(np.full(size, n, np.int32))
                        yield pa.RecordBatch.from_arrays([*names, *map(pa.array, found)], schema=SCHEMA)

    made = rows.mapInArrow(run, ROWS).groupBy("lang", "n", "fp")
    made = made.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("f").alias("f"), F.min("pointer").alias("pointer"))
    return made.where((F.col("f") >= least) | (F.col("n") == 0))


SCHEMA = pa.schema(
    [("lang", pa.string()), ("n", pa.int32()), ("fp", pa.int64()), ("low", pa.int32()), ("high", pa.int32()),
     ("f", pa.int64()), ("pointer", pa.int32())]
)


def gathered(block: Block, n: int, may: np.ndarray | None, base: int, mask: int) -> list[np.ndarray]:
    """Fingerprint, least and largest second one, places and least pointer, by fingerprint."""
    if block.held < n:
        return [np.zeros(0, np.int64)]
    right = block.counted(n)
    if may is not None:
        for j in range(n - base + 1):
            right &= may[j : j + len(right)]
    at = np.flatnonzero(right)
    if not len(at):
        return [np.zeros(0, np.int64)]
    fps, second = block.grams(n)[at] & np.uint64(mask), block.second(n)[at]
    order = np.argsort(fps, kind="stable")
    fps, second, pointer = fps[order], second[order], block.pointer[at[order]]
    starts = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
    return [
        fps[starts].view(np.int64), np.minimum.reduceat(second, starts), np.maximum.reduceat(second, starts),
        np.diff(np.r_[starts, len(fps)]), np.minimum.reduceat(pointer, starts),
    ]


def phrases_at(rows: DataFrame, wanted: DataFrame, longest: int, mask: int) -> DataFrame:
    """Text of every fingerprint of ``wanted``, read where its pointer leads.

    Returns ``lang``, ``n``, ``fp``, ``f``, ``phrase``. The words found there must have both
    fingerprints. Rows that hold none stay out of the shuffle but for false hits of the
    map; the list that meets a text is no longer than it.
    """
    asked = F.collect_list(F.struct("n", "fp", "f", "low"))
    by_row = materialise(wanted.groupBy("pointer", "lang").agg(asked.alias("asked")))
    needed = map_of(by_row.select(F.shiftleft(F.col("pointer").cast("long"), 32).alias("high")), "high")

    def some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        high = batch.column(2).to_numpy().astype(np.int64) << 32
        yield batch.filter(pa.array(marked(high.view(np.uint64), needed.value)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes({BREAK: bytes(16)})
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                yield from read_phrases(one, one.column(3).flatten(), longest, mask, hashes)

    held = map_rows(rows, some, "lang string, text string, pointer int").join(by_row, ["pointer", "lang"])
    held = held.select("lang", "text", "pointer", "asked").mapInArrow(run, "lang string, n int, fp long, f long, phrase string")
    return held.groupBy("lang", "n", "fp", "f").agg(F.min("phrase").alias("phrase"))


def read_phrases(
    row: pa.RecordBatch, sought: pa.StructArray, longest: int, mask: int, hashes: Hashes
) -> Iterator[pa.RecordBatch]:
    """Phrases of one text whose fingerprints are sought, both hashed anew from its words."""
    lang = row.column(0)[0].as_py()
    missing: dict[int, dict[int, tuple[int, int]]] = {n: {} for n in range(1, longest + 1)}
    for n, fp, f, low in zip(*(sought.field(k).to_pylist() for k in range(4))):
        missing[n][fp] = f, low
    before: list[bytes] = []
    out: list[tuple] = []
    for words in word_runs(row.column(1)[0].as_py()):
        run = before + words
        block = Block()
        block.add(b"".join(map(hashes.__getitem__, run)), 0, 0)
        block.open()
        for n, todo in missing.items():
            if todo and block.held >= n:
                here = np.flatnonzero(block.counted(n))
                mine = (block.grams(n)[here] & np.uint64(mask)).view(np.int64)
                second = block.second(n)[here]
                hit = np.isin(mine, np.fromiter(todo, np.int64, len(todo)))
                for at, fp, low in zip(here[hit].tolist(), mine[hit].tolist(), second[hit].tolist()):
                    if fp in todo and todo[fp][1] == low:
                        out.append((lang, n, fp, todo.pop(fp)[0], b" ".join(run[at : at + n]).decode("utf-8")))
        before = run[-(longest - 1) :] if longest > 1 else []
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    columns = [pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 5, kinds)]
    yield pa.RecordBatch.from_arrays(columns, ["lang", "n", "fp", "f", "phrase"])


def recount(rows: DataFrame, shared: DataFrame, lengths: Sequence[int], least: int, mask: int) -> DataFrame:
    """Phrases behind fingerprints that stand for several, counted by their text."""
    known = map_of(shared, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes({BREAK: bytes(16)})
        for batch in batches:
            for lang, text in zip(*batch.columns[:2]):
                before: list[bytes] = []
                for words in word_runs(text.as_py()):
                    run_of = before + words
                    block = Block()
                    block.add(b"".join(map(hashes.__getitem__, run_of)), len(before), 0)
                    block.open()
                    for n in lengths:
                        if block.held < n:
                            continue
                        fps = block.grams(n) & np.uint64(mask)
                        at = np.flatnonzero(block.counted(n) & marked(fps, known.value))
                        size = len(at)
                        if size:
                            phrases = [b" ".join(run_of[i : i + n]).decode("utf-8") for i in at.tolist()]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([lang.as_py()] * size, pa.string()), pa.array(np.full(size, n, np.int32)),
                                 pa.array(fps[at].view(np.int64)), pa.array(phrases, pa.string())],
                                ["lang", "n", "fp", "phrase"],
                            )
                    before = run_of[-(max(lengths) - 1) :] if max(lengths) > 1 else []

    found = rows.mapInArrow(run, "lang string, n int, fp long, phrase string")
    found = found.groupBy("lang", "n", "fp", "phrase").agg(F.count("*").alias("f"))
    return found.join(shared.select("lang", "n", "fp"), ["lang", "n", "fp"], "left_semi").where(F.col("f") >= least)


def frequent(docs: DataFrame, longest: int, least: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with ``least`` places or more, and each language's words.

    Words come first, then pairs of frequent words, then what is made of frequent pairs.
    """
    mask = ((1 << bits) - 1) << (64 - bits)
    rows = prepared(docs)
    words = materialise(counts(rows, [0, 1], least, mask))
    totals = words.where("n = 0").select("lang", F.col("f").alias("n"))
    words = words.where("n = 1")
    levels = [words]
    if longest > 1:
        pairs = materialise(counts(rows, [2], least, mask, map_of(words, "fp"), 1))
        levels.append(pairs)
    if longest > 2:
        levels.append(materialise(counts(rows, list(range(3, longest + 1)), least, mask, map_of(pairs, "fp"), 2)))
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    sure = phrases_at(rows, every.where("low = high"), longest, mask).select("lang", "n", "phrase", "f")
    sure = materialise(sure)
    shared = every.where("low <> high").select("lang", "n", "fp")
    if not shared.isEmpty():
        again = recount(rows, materialise(shared), range(1, longest + 1), least, mask)
        sure = sure.union(again.select("lang", "n", "phrase", "f"))
    return sure, totals


def joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, covered: int = 80, bits: int = 64
) -> DataFrame:
    """The best ``top`` phrases of every language.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at spaces and
    tabs. A phrase of 2 to ``longest`` words with ``a >= least`` places is cut after each
    word; the cut of the lowest floor(2000000 a / (l + r)) counts, ties to the first
    (``l`` and ``r`` are the places of both parts). Phrases inside a longer candidate with
    ``covered`` percent of their places or more are left out. Returns ``lang`` (null:
    ``und``), ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (the language's words),
    ``score``, ordered by score, ``a`` and the phrase's bytes.

    Counts are by 64-bit fingerprint; one that stands for several phrases shows by a
    second, independent one and is counted by text. ``bits`` shortens the first for
    tests. Null texts are empty, repeated rows count as often as they come, other
    columns are not looked at; an empty table gives no row. Texts of any length are
    hashed a part at a time.
    """
    grams, totals = frequent(docs, longest, least, bits)
    grams = materialise(grams)
    words = F.split("phrase", " ")
    many = grams.where("n > 1")
    cuts = many.select(
        "lang", "phrase", F.col("f").alias("a"),
        F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.struct(
            k.alias("k"), joined(words, F.lit(1), k).alias("left"), joined(words, k + 1, F.col("n") - k).alias("right")))).alias("c"),
    ).select("lang", "phrase", "a", "c.k", "c.left", "c.right")
    part = grams.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    cuts = materialise(cuts.join(part, ["lang", "left"]))
    part = grams.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = materialise(cuts.join(part, ["lang", "right"]))
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div cast(l + r as decimal(19,0)) as bigint)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
    scored = scored.agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("n") - m + 1), lambda at: joined(words, at, m))))
    inside = many.where("n > 2").select("lang", F.col("f").alias("over"), F.explode(inner).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    left = scored.join(inside, ["lang", "phrase"], "left")
    left = left.where(F.col("over").isNull() | (100 * F.col("over") < covered * F.col("a")))
    first = F.row_number().over(_ranked("lang", "salt"))
    some = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("first", first)
    some = materialise(some.where(F.col("first") <= top).drop("salt", "first"))
    best = some.withColumn("rank", F.row_number().over(_ranked("lang")).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(*by: str):
    return Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
