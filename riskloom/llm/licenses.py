"""Licence scan: rare words of licence texts, aligned by relative position."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rules import barrier
from riskloom.session import materialise

# What a word is, and the phrases that always name a licence.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, words of a notice, and key phrases that must stand at their place in it.
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted", "documentation files"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["hereby granted"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "dedicated to the public domain under the creative commons cc0 1 0 universal dedication", ["public domain"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: Sequence[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Rows of ``docs`` and, of those, how many hold each word of ``vocabulary``.

    Every row is read. Only ``vocabulary`` comes to the driver, whose size is that of
    the templates.
    """
    held = F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, vocabulary)))
    marked = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("word"))
    counts = {r["word"]: r["n"] for r in marked.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def find_run(words: Sequence[str], phrase: Sequence[str]) -> int:
    return next(i for i in range(len(words)) if list(words[i : i + len(phrase)]) == list(phrase))


def postings(rows: int, frequency: Mapping[str, int], templates: Sequence[tuple[str, str, list[str]]], rare: int) -> list[tuple]:
    """(kind, pattern, word, offset, weight) of templates, key phrases and base phrases.

    A template keeps its ``rare`` words of highest IDF, ties by word; a word that it
    holds more than once stands for its first place. Weights of a pattern sum to 1.
    """
    out = []
    for number, (_, text, keys) in enumerate(templates):
        words = text.split()
        idf = {w: math.log((rows + 1) / (frequency.get(w, 0) + 1)) + 1e-9 for w in words}
        best = sorted(idf, key=lambda w: (-idf[w], w))[:rare]
        total = sum(idf[w] for w in best)
        out += [("template", number, w, words.index(w), idf[w] / total) for w in best]
        for phrase in keys:
            parts = phrase.split()
            at = find_run(words, parts)
            # a key phrase is aligned with the template's start, not its own
            out += [("key", number, w, at + i, 1.0) for i, w in enumerate(parts)]
    for number, phrase in enumerate(BASE_PHRASES):
        out += [("base", number, w, i, 1.0) for i, w in enumerate(phrase.split())]
    return out


def license_scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str, list[str]]] | None = None,
    rare: int = 4,
    least: float = 0.7,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Licence labels of every row of ``docs``.

    A first pass counts the documents with each template word. A second finds, in each
    text, the places of rare, key and base words; each place names, for every posting
    of its word, where the notice would start, and postings that agree on the start
    add up. A template counts where at least ``least`` of its rare words' IDF weight
    agrees and all its key phrases stand at their place. ``score`` is the largest such
    weight, else 0. One row comes out for each that came in, repeated ones too; a null
    or empty text has no word and no label. Extra columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    total, frequency = document_frequencies(docs, vocabulary, text_column)
    table = postings(total, frequency, templates, rare)
    words = sorted({p[2] for p in table})

    split = barrier(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).cast("long").alias("doc_id"),
            F.col(text_column).alias("text"),
        ),
        words=words_of(F.col("text")),
    ).select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words")
    placed = split.select("row", "doc_id", "n_words", F.posexplode_outer("words").alias("pos", "word"))
    hits = materialise(placed.where(F.col("word").isin(words) | (F.coalesce(F.col("pos"), F.lit(0)) == 0)))

    by_word = spark.createDataFrame(table, "kind string, pattern int, word string, offset int, weight double")
    found = hits.select("row", "pos", "word").join(F.broadcast(by_word), "word")
    starts = found.groupBy("row", "kind", "pattern", (F.col("pos") - F.col("offset")).alias("start")).agg(
        F.sum("weight").alias("weight")
    )
    needed = {("base", i): float(len(p.split())) for i, p in enumerate(BASE_PHRASES)}
    needed |= {("key", i): float(sum(len(k.split()) for k in keys)) for i, (_, _, keys) in enumerate(templates)}
    bounds = spark.createDataFrame(
        [(k, i, n) for (k, i), n in needed.items()] + [("template", i, least) for i in range(len(templates))],
        "kind string, pattern int, bound double",
    )
    good = starts.join(F.broadcast(bounds), ["kind", "pattern"]).where("weight >= bound - 1e-9")
    # a template's rare words and its key phrases have to agree on the start
    aligned = good.where("kind <> 'base'").groupBy("row", "pattern", "start").agg(
        F.count("*").alias("kinds"), F.max(F.when(F.col("kind") == "template", F.col("weight"))).alias("weight")
    ).where("kinds = 2")
    names = F.array(*[F.lit(t[0]) for t in templates])
    base_names = F.array(*[F.lit(v) for v in BASE_PHRASES.values()])
    facts = good.where("kind = 'base'").select(
        "row", F.col("start"), F.element_at(base_names, F.col("pattern") + 1).alias("base"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("weight")
    ).unionByName(
        aligned.select("row", F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("base"),
                       F.element_at(names, F.col("pattern") + 1).alias("label"), "weight")
    )
    per_row = facts.groupBy("row").agg(
        F.count("start").alias("n_base"),
        F.min("start").cast("long").alias("first_word"),
        F.max("start").cast("long").alias("last_word"),
        F.array_sort(F.collect_set("base")).alias("base"),
        F.array_sort(F.array_union(F.collect_set("base"), F.collect_set("label"))).alias("all"),
        F.max("weight").alias("score"),
    )
    rows = hits.where(F.coalesce(F.col("pos"), F.lit(0)) == 0).select("row", "doc_id", "n_words")
    return rows.join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("all", ","), F.lit("")).alias("labels"),
        F.round(F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)), 6).alias("score"),
    )
