"""Quality classifier: a document's own evidence, and what its site and path suggest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import map_rows, plain_names
from riskloom.session import materialise

SYMBOLS, MARKS, DIGITS = b"#*$%&|<>~^=_\\/@+{}[]", b".,;:!?\"'()-", b"0123456789"
UPPER, SPACES = bytes(range(65, 91)), b" \t\n\x0b\x0c\r"
HIGH = bytes(range(128, 256))
SHOUT = re.compile(rb"!!+")
FEATURES = ["symbols", "marks", "digits", "upper", "spaces", "high", "word_length", "distinct_words", "distinct_lines", "commonest", "shouts", "log_words"]


def features(text: str) -> list[float]:
    """Shares of kinds of byte, word and line of one text; all zero for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)

    def share(kind: bytes) -> float:
        return 1 - len(raw.translate(None, kind)) / n

    words = raw.split()
    count = max(1, len(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    return [
        share(SYMBOLS), share(MARKS), share(DIGITS), share(UPPER), share(SPACES),
        share(HIGH),
        min(40.0, sum(map(len, words)) / count),
        # distinct words fall with length in any text; against the root this is level
        min(4.0, len(seen) / count**0.75),
        len(set(lines)) / max(1, len(lines)),
        max(seen.values(), default=0) / count,
        min(1.0, sum(1 for _ in SHOUT.finditer(raw)) / count),
        float(np.log1p(len(words))),
    ]


def featured(docs: DataFrame, host: str, path: str) -> DataFrame:
    """``row``, ``doc_id``, ``host``, ``path`` and ``x`` of every row, without its text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [features(t.as_py() or "") for t in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.float64()))], ["row", "doc_id", "host", "path", "x"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("`doc_id`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"),
        F.col("`text`").alias("text"),
    )
    return map_rows(rows, run, "row long, doc_id long, host string, path string, x array<double>")


@dataclass
class Evidence:
    """A fitted logistic model; ``prior`` is the log odds of its training rows."""

    weights: list[float]
    intercept: float
    prior: float

    def log_odds(self, x: Column) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in self.weights])
        total = F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return total + F.lit(float(self.intercept))


def fit_evidence(rows: DataFrame, labels: DataFrame, most_rows: int = 20_000, seed: int = 7) -> Evidence:
    """Fit on at most ``most_rows`` labelled rows, those of smallest hashed id.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad); null labels and ids take
    no part, and a repeated id counts once with its largest label. Without rows of
    both classes the evidence is zero for every document.
    """
    named = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    chosen = named.join(rows.select("doc_id", "x").dropDuplicates(["doc_id"]), "doc_id")
    chosen = materialise(chosen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_rows))
    n, good = chosen.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0.0, float(n)):
        return Evidence([0.0] * len(FEATURES), 0.0, 0.0)
    train = chosen.select(array_to_vector("x").alias("features"), "label")
    model = LogisticRegression(regParam=1e-3, maxIter=100, standardization=True).fit(train)
    return Evidence(list(model.coefficients), model.intercept, float(np.log(good / (n - good))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(bounded / (1 - bounded))


def strength(groups: DataFrame, mean: str) -> float:
    """Prior rows that a group's posterior starts from, by the method of moments.

    ``groups`` has ``n``, ``good`` and the mean it shrinks to. The spread of the
    groups' shares beyond what their sizes explain says how far to trust a group.
    Bounded to 1..1000 rows; without two groups, 10.
    """
    p = F.col("good") / F.col("n")
    m = F.col(mean)
    k, between, within, weight = groups.agg(
        F.count("*"), F.sum(F.col("n") * (p - m) ** 2), F.sum(m * (1 - m)), F.sum(F.col("n") * m * (1 - m))
    ).first()
    if not k or k < 2 or not weight:
        return 10.0
    excess = max((between - within) / weight, 1e-3)
    return float(min(1000.0, max(1.0, 1 / excess - 1)))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """Good share of each path, shrunk to its host's, which is shrunk to the global one.

    ``scored`` has ``host``, ``path`` and ``p`` (chance of good). One aggregate by
    path, which combines before its shuffle however large a host is; hosts are summed
    from paths. The group tables grow with sites, not rows, and are joined, not sent
    to the driver.
    """
    paths = materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    n, good = paths.agg(F.sum("n"), F.sum("good")).first()
    everywhere = (good / n) if n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("mean", F.lit(everywhere))
    hosts = materialise(hosts)
    k = strength(hosts, "mean")
    hosts = hosts.select("host", ((F.col("good") + k * F.col("mean")) / (F.col("n") + k)).alias("host_posterior"))
    paths = materialise(paths.join(hosts, "host"))
    k = strength(paths, "host_posterior")
    return paths.select(
        "host", "path", "host_posterior",
        ((F.col("good") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"),
    )


def classify(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most_rows: int = 20_000, keep_from: float = 0.5
) -> DataFrame:
    """Quality of every row of ``docs``: ``doc_id``, ``evidence``, posteriors, ``score``, ``kept``.

    The model's log odds less those of its training rows are the evidence; added to
    the log odds of the path's posterior they give the score. Null or empty texts are
    not kept. Null hosts and paths form a site of their own. Repeated rows come out
    as often as they came in; other columns are ignored.
    """
    rows = materialise(featured(docs, host, path))
    return classified(rows, labels, most_rows, keep_from).select(
        "doc_id", "evidence", "host_posterior", "path_posterior", "score", "kept"
    )


def classified(rows: DataFrame, labels: DataFrame, most_rows: int, keep_from: float) -> DataFrame:
    model = fit_evidence(rows, labels, most_rows)
    log_odds = model.log_odds(F.col("x"))
    scored = rows.withColumn("evidence", log_odds - F.lit(model.prior)).withColumn("p", sigmoid(log_odds))
    sites = site_posteriors(scored)
    final = scored.join(sites, ["host", "path"]).withColumn("score", sigmoid(F.col("evidence") + logit(F.col("path_posterior"))))
    empty = F.element_at("x", len(FEATURES)) == 0.0
    return final.withColumn("kept", (F.col("score") >= keep_from) & ~empty)


def keep_good(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most_rows: int = 20_000, keep_from: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns, whatever their names.

    The verdict comes from the row's text, host and path, so the evidence is worked
    out again beside the text instead of moving texts to meet their verdict.
    """
    rows = materialise(featured(docs, host, path))
    model = fit_evidence(rows, labels, most_rows)
    scored = rows.withColumn("p", sigmoid(model.log_odds(F.col("x"))))
    sites = site_posteriors(scored).select(F.col("host").alias("__host"), F.col("path").alias("__path"), logit(F.col("path_posterior")).alias("__site"))
    held, named, columns = plain_names(docs)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        found = [features(t.as_py() or "") for t in batch.column(at)]
        x = np.array(found).reshape(-1, len(FEATURES))
        evidence = x @ np.array(model.weights) + model.intercept - model.prior
        site = batch.column(len(columns)).to_numpy(zero_copy_only=False)
        kept = (1 / (1 + np.exp(-(evidence + site))) >= keep_from) & (x[:, -1] > 0)
        yield pa.RecordBatch.from_arrays(batch.columns[: len(columns)], list(named.values())).filter(pa.array(kept))

    joined = held.join(
        sites,
        (F.coalesce(F.col(named[host]).cast("string"), F.lit("")) == F.col("__host"))
        & (F.coalesce(F.col(named[path]).cast("string"), F.lit("")) == F.col("__path")),
    )
    return map_rows(joined.select(*held.columns, "__site"), run, held.schema).toDF(*columns)
