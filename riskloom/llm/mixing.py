"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import plain_names
from riskloom.session import materialise

#: Hex digits of the hash behind each uniform number: 52 bits, exact in a double.
DIGITS = 13
MOST_RATE = 400


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ``|``; null is an empty part."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    head = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double")
    return head / F.lit(float(16**DIGITS))


def source_rates(
    docs: DataFrame, weights: Mapping[str, float] | None, alpha: float, epochs: float, source: str, size: Column
) -> DataFrame:
    """Mean repetitions of each source: its target share of the budget over its size.

    ``weights`` are target shares by source (others get none); without it, a source's
    share goes with its size to the power ``alpha``. The budget is ``epochs`` times
    the total size. A null source is a source of its own.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("held"))
    sizes = materialise(sizes.where("held > 0"))
    if weights is None:
        wanted = sizes.withColumn("want", F.pow("held", F.lit(alpha)))
    else:
        known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        wanted = sizes.withColumn("want", F.coalesce(F.element_at(known, F.col("source")), F.lit(0.0)))
    total = wanted.agg(F.sum("held"), F.sum("want")).first()
    budget = epochs * (total[0] or 0.0) / (total[1] or 1.0)
    return wanted.select("source", (F.col("want") * F.lit(budget) / F.col("held")).alias("rate"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """``rates`` with ``cdf``: the distribution function of each rate at 0, 1, 2, ...

    It ends where the terms fall below 1e-18 of the largest, past every 52-bit
    number. A rate over 400 is cut into ``parts`` equal ones, so that the terms
    stay within a double.
    """
    parts = F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("int")
    mean = F.col("mean")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.array(F.exp(-mean)).alias("cdf"), F.exp(-mean).alias("term")),
        lambda acc, k: F.struct(
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["term"] * mean / k)).alias("cdf"),
            (acc["term"] * mean / k).alias("term"),
        ),
        lambda acc: acc["cdf"],
    )
    return rates.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts")).withColumn("cdf", grown)


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = 0.5,
    epochs: float = 1.0,
    seed: int = 42,
    source: str = "source",
) -> DataFrame:
    """``docs`` repeated by hashed Poisson counts, in a shuffled order.

    A document's count comes from a number hashed from seed, id and text, so
    recomputing a lost task gives the same copies; repeated rows share their count.
    Returns the columns of ``docs`` and ``__copy`` (from 1) and ``__place`` (a hash
    that orders the result). Rows are dealt to tasks by that hash, not by source, so
    a source with a third of all rows spreads evenly. Size is the text's length
    plus one, so empty and null texts count too. Other columns may have any name; one
    already named ``__copy`` or ``__place`` is replaced.
    """
    rows, named, columns = plain_names(docs, ("__copy", "__place"))
    source, text, doc_id = named[source], named["text"], named["doc_id"]
    size = F.coalesce(F.length(text), F.lit(0)) + 1
    rates = materialise(poisson_table(source_rates(rows, weights, alpha, epochs, source, size)))
    keyed = rows.join(rates.withColumnRenamed("source", "__source"), F.col(source).eqNullSafe(F.col("__source")))
    text_key = F.md5(F.coalesce(F.col(text), F.lit("")))

    def drawn(part: Column) -> Column:
        """Copies for one part of the rate: distribution values not above the number."""
        u = uniform(F.lit(seed), F.col(doc_id), text_key, part)
        return F.size(F.filter("cdf", lambda c: c <= u))

    counted = keyed.withColumn("__count", F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), drawn), F.lit(0), lambda a, n: a + n)).where("__count > 0")
    copied = counted.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("__copy"))
    placed = copied.withColumn("__place", F.xxhash64(F.lit(seed), doc_id, text, "__copy"))
    return placed.repartition("__place").sortWithinPartitions("__place").toDF(*columns, "__copy", "__place")
