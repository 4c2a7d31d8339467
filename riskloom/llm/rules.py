"""Quality rules in DataFrame functions, run as a cascade that stops at the first no."""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import plain_names

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, however often later ones use them.

    A one-element explode keeps the optimiser from copying their expressions into
    each use, which inside a lambda would compute them once for every element.
    """
    packed = F.struct(*[v.alias(k) for k, v in columns.items()])
    return df.withColumn("__one", F.explode(F.array(packed))).select(
        *df.columns, *[F.col(f"__one.{k}").alias(k) for k in columns]
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def needed(rule: Column) -> list[str]:
    """The counts that a rule names."""
    return [c for c in COUNTS if re.search(rf"\b{c}\b", str(rule))]


def counted(docs: DataFrame, names: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep`` and the counts ``names``, and no other count worked out."""
    names = list(names)
    if "n_repeat_words" in names:
        return measures(docs, keep).select("doc_id", *keep, *names)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    made = {
        "n_words": lambda: F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))),
        "word_chars": lambda: F.length(F.translate(text, SPACES, "")),
        "n_symbols": lambda: F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": lambda: F.size(lines),
        "n_dup_lines": lambda: F.size(lines) - F.size(F.array_distinct(lines)),
    }
    return docs.select("doc_id", *keep, *[made[c]().cast("long").alias(c) for c in names])


def measures(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep`` and all counts of every row, in one pass without a shuffle.

    Null text counts as empty. Repeated 8-word windows are found by sorting 64-bit
    hashes of the windows of each text together with their places.
    """
    rows = barrier(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_kept(keep), F.coalesce(F.col("text"), F.lit("")).alias("text")),
        words=F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0)),
    )
    filler = F.translate("text", SPACES, "")
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    rows = barrier(
        rows,
        n_words=F.size("words").cast("long"),
        word_chars=F.length(filler).cast("long"),
        n_symbols=(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
        lines=lines,
        hashes=F.transform("words", lambda w: F.xxhash64(w)),
    )
    rows = barrier(
        rows.select("doc_id", *_carried(keep), "n_words", "word_chars", "n_symbols", "lines", "hashes"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        windows=F.transform(
            F.arrays_zip(*[F.slice("hashes", i + 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")).alias(f"h{i}") for i in range(WINDOW)]),
            lambda z: F.xxhash64(*[z[f"h{i}"] for i in range(WINDOW)]),
        ),
    )
    rows = barrier(
        rows.select("doc_id", *_carried(keep), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "windows"),
        placed=F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    rows = barrier(
        rows.drop("windows"),
        # a place starts a repeated window if its neighbour in hash order has the same hash
        starts=F.array_sort(
            F.transform(
                F.filter(
                    F.zip_with(
                        "placed",
                        F.zip_with(
                            F.concat(F.array(F.lit(None).cast("long")), F.col("placed.h")),
                            F.concat(F.slice(F.col("placed.h"), 2, F.greatest(F.size("placed") - 1, F.lit(0))), F.array(F.lit(None).cast("long"))),
                            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
                        ),
                        lambda p, q: F.struct(p["i"].alias("i"), (p["h"].eqNullSafe(q["a"]) | p["h"].eqNullSafe(q["b"])).alias("twice")),
                    ),
                    lambda x: x["twice"] & x["i"].isNotNull(),
                ),
                lambda x: x["i"],
            )
        ),
    )
    # each start covers eight words, less those the start before it covers
    covered = F.aggregate(
        F.col("starts"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return rows.select(
        "doc_id", *[F.col(f"_kept_{c}").alias(c) for c in keep],
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def _kept(keep: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(f"_kept_{c}") for c in keep]


def _carried(keep: Sequence[str]) -> list[str]:
    return [f"_kept_{c}" for c in keep]


def default_rules() -> dict[str, Column]:
    """Rejections by name. A text failing none of them is kept."""
    words, chars, symbols = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")
    return {
        "few_words": words < 20,
        "repeated_words": 100 * F.col("n_repeat_words") > 30 * words,
        "symbols": 10 * symbols > chars,
        "short_words": chars < 2 * words,
        "long_words": chars > 25 * words,
        "repeated_lines": (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 60 * F.col("n_lines")),
    }


def plan_cascade(docs: DataFrame, rules: Mapping[str, Column], sample_rows: int = 2000, repeats: int = 2, seed: int = 7) -> list[str]:
    """Rule names, the most rejection per cost first.

    Both are measured on a random sample of about ``sample_rows`` rows, drawn row by row
    where the rows lie: selectivity as the share a rule rejects, cost as the time of
    working out the counts the rule needs from the texts, and the rule (the least of
    ``repeats`` runs), beside the time of a rule that needs none. The order changes the time
    the cascade takes, never which rows it keeps. On an empty sample the order is that of
    ``rules``.
    """
    n = docs.count()
    sample = docs.select("doc_id", "text").sample(min(1.0, sample_rows / max(1, n)), seed).persist()
    try:
        counts = measures(sample).agg(F.count("*").alias("rows"), *[F.count_if(r).alias(name) for name, r in rules.items()]).first()
        if not counts["rows"]:
            return list(rules)

        def seconds(rule: Column) -> float:
            took = []
            for _ in range(repeats):
                began = time.perf_counter()
                counted(sample, needed(rule)).agg(F.count_if(rule)).collect()
                took.append(time.perf_counter() - began)
            return min(took)

        idle = seconds(F.lit(False))
        cost = {name: max(seconds(r) - idle, 1e-4) for name, r in rules.items()}
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda name: (-counts[name] / counts["rows"] / cost[name], list(rules).index(name)))


def kept_by_cascade(docs: DataFrame, rules: Mapping[str, Column] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that fail no rule, the rules tried in the order of the plan.

    Each step filters the rows left with one rule and the counts it needs; the counts of a
    later rule are worked out only for rows that passed all before it.
    """
    rules = rules or default_rules()
    plain, named, columns = plain_names(docs)
    order = plan_cascade(docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text")), rules, sample_rows)
    left = plain.withColumn("text", F.col(named["text"])).withColumn("doc_id", F.col(named["doc_id"]))
    for name in order:
        tried = counted(left, needed(rules[name]), ["text", *plain.columns])
        left = tried.where(~F.coalesce(rules[name], F.lit(False))).select("doc_id", "text", *plain.columns)
    return left.select(*plain.columns).toDF(*columns)


def cascade(measured: DataFrame, rules: Mapping[str, Column], order: list[str]) -> DataFrame:
    """``measured`` with ``kept``; a rule is evaluated only for rows all before it passed."""
    verdict = F.lit(True)
    for name in reversed(order):
        verdict = F.when(F.coalesce(rules[name], F.lit(False)), F.lit(False)).otherwise(verdict)
    return measured.withColumn("kept", verdict)


def quality_rules(docs: DataFrame, rules: Mapping[str, Column] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Counts and verdict for every row of ``docs``.

    Rows come out as they came in: repeated rows repeat, null ids stay null, null or
    empty texts have no word and fail. Extra columns are ignored. The result has the base
    counts of every row, so these are worked out for all; ``kept_by_cascade`` works out
    counts only for rows still passing.
    """
    rules = rules or default_rules()
    docs = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))
    order = plan_cascade(docs, rules, sample_rows)
    judged = cascade(measures(docs), rules, order)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"),
    )
