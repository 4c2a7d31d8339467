"""Secret scan: base patterns, and who else carries the same string."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import map_rows, plain_names
from riskloom.session import materialise

# The kinds of span in their order, with their patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "opaque"]
LEAST_VALUE = 6
#: Owners and different texts that make a string an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 4, 10
#: Method's own kind: a long run of key characters with upper and lower case and digits.
OPAQUE = re.compile(r"[A-Za-z0-9_-]{20,}")

FOUND = "array<struct<start:int,kind:int,stop:int,digest:string>>"


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, stop, secret) of every candidate of one text, in code points.

    A span is the whole match; the secret of an assignment is its value. An opaque
    run counts only outside the spans of the three base kinds.
    """
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((f[0], f[2]) for f in found)
    for m in OPAQUE.finditer(text):
        run = m[0]
        if run.islower() or run.isupper() or not any(map(str.isdigit, run)) or not any(map(str.isalpha, run)):
            continue
        if not any(start < m.end() and m.start() < stop for start, stop in base):
            found.append((m.start(), 3, m.end(), run))
    return sorted(found)


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """``row``, ``doc_id``, ``owner``, ``text_hash`` and ``found`` for every row of ``docs``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [
            [
                {"start": a, "kind": k, "stop": b, "digest": sha256(s.encode()).hexdigest()[:32]}
                for a, k, b, s in find(t.as_py() or "")
            ]
            for t in batch.column(4)
        ]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("digest", pa.string())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, kind)], ["row", "doc_id", "owner", "text_hash", "found"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("`doc_id`").cast("long").alias("doc_id"),
        F.col(f"`{owner}`").cast("string").alias("owner"),
        F.xxhash64(F.col("`text`")).alias("text_hash"),
        F.col("`text`").alias("text"),
    )
    return map_rows(rows, run, f"row long, doc_id long, owner string, text_hash long, found {FOUND}")


def ownership(scanned: DataFrame) -> DataFrame:
    """Distinct repositories (texts of an owner) and owners of every candidate string.

    Places within one text count once, and so do copies of the whole text: a copied
    document says nothing about the string. Counts are made per text, then per owner,
    then per string, so that a string found everywhere arrives at its last task as one
    row for each owner and map task. A null owner is an owner of its own.
    """
    seen = scanned.select(F.explode("found.digest").alias("digest"), "owner", "text_hash").distinct()
    by_owner = seen.groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def label_spans(
    scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES
) -> DataFrame:
    """``row`` and ``spans`` (start, kind, stop, live, owners, repositories) of rows with a span.

    A string is a copied example if it is spread over ``example_owners`` owners or more, or
    stands in ``example_repositories`` different texts or more, be they one owner's. A
    string of few owners and few texts is live. Base spans are kept either way, opaque
    ones only where they are live.
    """
    owned = ownership(scanned)
    each = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    judged = each.join(owned, "digest").withColumn("live", live).where((F.col("kind") < 3) | F.col("live"))
    span = F.struct("start", "kind", "stop", "live", "owners", "repositories")
    return judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined in the order given."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def secret_report(
    docs: DataFrame,
    example_owners: int = EXAMPLE_OWNERS,
    owner: str = "source",
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """Spans of every row of ``docs``; a row without any keeps empty strings and zeros.

    ``spread`` has owners/repositories of each of ``spans``. Null text counts as empty.
    Repeated rows are reported once each; rows of one owner and text are one repository. Columns beyond ``doc_id``, ``text`` and
    ``owner`` are ignored.
    """
    scanned = materialise(candidates(docs, owner))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,live:boolean,owners:bigint,repositories:bigint>>")
    spans = label_spans(scanned, example_owners, example_repositories)
    spread = F.transform("spans", lambda s: F.concat_ws("/", s["owners"].cast("string"), s["repositories"].cast("string")))
    all_rows = scanned.join(spans, "row", "left").withColumn("spans", F.coalesce("spans", none))
    base = F.filter("found", lambda f: f["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long")

    return all_rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text("spans").alias("spans"),
        F.array_join(spread, ",").alias("spread"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def redact(
    docs: DataFrame,
    example_owners: int = EXAMPLE_OWNERS,
    owner: str = "source",
    mark: str = "[secret]",
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """``docs`` with every live span's text replaced by ``mark``; examples stay.

    All rows and columns are kept, whatever their names; ``n_chars`` (if there) follows the
    new text. Overlapping spans are replaced as one.
    """
    scanned = materialise(candidates(docs, owner))
    spans = (
        scanned.join(label_spans(scanned, example_owners, example_repositories), "row")
        .select("doc_id", "text_hash", F.filter("spans", lambda s: s["live"]).alias("__spans"))
        .where(F.size("__spans") > 0)
        .dropDuplicates(["doc_id", "text_hash"])
    )
    rows, named, columns = plain_names(docs)
    s = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__spans")
    same = F.col(named["doc_id"]).eqNullSafe(F.col("__id")) & (F.xxhash64(named["text"]) == F.col("__hash"))
    joined = rows.join(s, same, "left")
    at = columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(at).to_pylist()
        for i, row in enumerate(batch.column(len(columns))):
            if row.is_valid and texts[i]:
                out, done = [], 0
                for span in row.as_py():
                    if span["start"] >= done:
                        out += [texts[i][done : span["start"]], mark]
                    done = max(done, span["stop"])
                texts[i] = "".join(out) + texts[i][done:]
        changed = list(batch.columns[: len(columns)])
        changed[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(changed, list(named.values()))

    made = map_rows(joined.select(*rows.columns, "__spans"), run, rows.schema)
    if "n_chars" in columns:
        length = F.length(named["text"]).cast(docs.schema["n_chars"].dataType)
        made = made.withColumn(named["n_chars"], length).select(*rows.columns)
    return made.toDF(*columns)
