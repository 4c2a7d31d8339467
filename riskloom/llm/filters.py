"""What each of several filters removes, in every order they may run in."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import map_rows

CAPITALS = bytes(range(65, 91))
SIGNS = re.compile(rb"[#$%&*|]")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: str) -> int:
    """Bits of the filters that look at one text: A (1), B (2), C (4), D (8)."""
    raw = text.encode("utf-8")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * capitals > 10 * len(text),
        SIGNS.search(raw) is not None,
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` of every row, equal ones counted in ``n``.

    Bit 16 is filter E: the row's text also belongs to a smaller ``doc_id``. Texts meet
    by their SHA-256. Only the least id of each digest is shuffled to its rows, and both
    meet on digest and id, so however many copies a text has, they stay spread. A
    null id is smaller than none and has no smaller one.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        masks, digests = [], []
        for value in batch.column(2):
            text = value.as_py()
            masks.append(text_failures(text))
            digests.append(sha256(text.encode("utf-8")).digest())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            ["doc_id", "part", "mask", "digest"],
        )

    rows = docs.select(
        F.col("`doc_id`").cast("long").alias("doc_id"),
        F.coalesce(F.col("`lang`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("`text`"), F.lit("")).alias("text"),
    )
    marked = map_rows(rows, run, "doc_id long, part string, mask int, digest binary")
    marked = marked.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = marked.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marked = marked.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return marked.select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"), "n")


def cells(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, good rows and toxic rows of every part and mask.

    A row is good if any label of its id has quality 1, toxic if any has toxic 1.
    """
    known = labels.where("`doc_id` is not null").groupBy(F.col("`doc_id`").cast("long").alias("doc_id")).agg(
        F.max(F.col("`quality`").eqNullSafe(1).cast("int")).alias("good"),
        F.max(F.col("`toxic`").eqNullSafe(1).cast("int")).alias("toxic"),
    )
    held = marked.join(known, "doc_id", "left")
    return held.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def survivors(counts: np.ndarray, filters: int) -> np.ndarray:
    """What is left of ``counts`` (by mask) under every subset of the filters.

    The subsets come in Gray order, so one filter is switched at a time. Every mask keeps
    how many of the active filters it fails; the running total changes only by masks
    that leave or reach zero.
    """
    masks = np.arange(1 << filters)
    failing = np.zeros(1 << filters, np.int64)
    running = counts.sum(axis=0)
    states = np.zeros_like(counts)
    states[0] = running
    active = 0
    for step in range(1, 1 << filters):
        bit = (step & -step).bit_length() - 1
        active ^= 1 << bit
        hit = masks >> bit & 1 == 1
        if active >> bit & 1:
            running = running - counts[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            running = running + counts[hit & (failing == 0)].sum(axis=0)
        states[active] = running
    return states


def orders(part: str, states: np.ndarray, letters: str) -> pd.DataFrame:
    """Every order's steps as differences of the stored states."""
    size, left = len(letters), states[:, 0]
    whole = (1 << size) - 1
    shapley = [
        sum(
            factorial(s.bit_count()) * factorial(size - 1 - s.bit_count()) * int(left[s] - left[s | 1 << f])
            for s in range(1 << size) if not s >> f & 1
        )
        for f in range(size)
    ]
    out = []
    for order in permutations(range(size)):
        before, name = 0, "".join(letters[f] for f in order)
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed, good, toxic = (states[before] - states[after]).tolist()
            fails, alone = int(left[0] - left[1 << f]), int(left[whole ^ 1 << f] - left[whole])
            out.append((part, name, step, int(left[after]), removed, fails - removed, alone, good, toxic, shapley[f]))
            before = after
    return pd.DataFrame(out, columns=["part", "filter_order", "step", *COUNTS])


def audit(found: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of ``letters`` and step, from the cells of each part.

    A part has 2^k cells at most for k filters, whatever the rows, and its walk needs
    nothing else.
    """

    def walk(held: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(letters), 3), np.int64)
        counts[held["mask"].to_numpy()] = held[["n", "good", "toxic"]].to_numpy()
        return orders(held["part"].iloc[0], survivors(counts, len(letters)), letters)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return found.groupBy("part").applyInPandas(walk, schema)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole texts of ``docs``, in all 120 orders, for each ``lang``.

    A: under 100 words; B: under 80 percent of them distinct; C: over 10 percent of the
    code points are A-Z; D: a sign of ``#$%&*|``; E: the text of a smaller ``doc_id``.
    Words are runs without ASCII white space. Null texts and languages are empty, repeated
    rows count as often as they come and are no copies of one another; a null label is
    neither good nor toxic. Other columns are not looked at; an empty table gives no row.
    """
    return audit(cells(failures(docs), labels))
