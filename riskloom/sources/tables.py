"""Readers for the two input tables and their declared types."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialise

ROW_ORDER = "_row_order"
BAD_LINE, BAD_FILE = "_bad_line", "_bad_file"

# The string and integer columns of the transaction and identity
# tables. Every other column of the two tables is a double.
STRING_COLUMNS = frozenset(
    ["ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo"]
    + [f"M{i}" for i in range(1, 10)]
    + [f"id_{i}" for i in (12, 15, 16, 23, 27, 28, 29, 30, 31, 33, 34, 35, 36, 37, 38)]
)
LONG_COLUMNS = frozenset(["TransactionID", "TransactionDT", "card1"])
INT_COLUMNS = frozenset(["isFraud"])


def column_type(name: str) -> T.DataType:
    name = name.replace("id-", "id_")
    if name in STRING_COLUMNS:
        return T.StringType()
    if name in LONG_COLUMNS:
        return T.LongType()
    if name in INT_COLUMNS:
        return T.IntegerType()
    return T.DoubleType()


def schema_for(columns: Iterable[str], types: Mapping[str, T.DataType] | None = None) -> T.StructType:
    """Declared schema by column name; ``types`` overrides or adds names."""
    types = types or {}
    return T.StructType([T.StructField(c, types.get(c, column_type(c))) for c in columns])


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    format: str | None = None,
    types: Mapping[str, T.DataType] | None = None,
) -> DataFrame:
    """Read a table: parquet/ORC as stored, CSV with a declared schema.

    Without ``schema`` the CSV header alone is read and the types follow from
    the column names, so the data is scanned once and never inferred. A file whose
    header has other names or another order fails instead of being misread.
    """
    first = path if isinstance(path, str) else path[0]
    if format is None:
        format = "csv" if first.rstrip("/").lower().endswith((".csv", ".csv.gz")) else "parquet"
    if format != "csv":
        reader = spark.read.format(format)
        return (reader.schema(schema) if schema else reader).load(path)
    if schema is None:
        schema = schema_for(spark.read.option("header", True).csv(first).columns, types)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


@dataclass
class CheckedRead:
    """Rows that parse, and the text of those that do not."""

    rows: DataFrame
    rejected: DataFrame  # file, line


def read_checked(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    types: Mapping[str, T.DataType] | None = None,
) -> CheckedRead:
    """Read CSV files; a row with a cell that does not parse, or too many cells, is set aside.

    Every cell is parsed once, whatever columns are used later: the parsed table is written
    and both halves are read from it, the rejected lines with their file, so they can be
    counted, mended and read again. Rows that parse are those ``read_table`` gives. An
    empty cell is null, not a fault.
    """
    if schema is None:
        first = path if isinstance(path, str) else path[0]
        schema = schema_for(spark.read.option("header", True).csv(first).columns, types)
    scan = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .csv(path)
    )
    parsed = materialise(scan.select("*", F.col("_metadata.file_path").alias(BAD_FILE)))
    good = parsed.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE, BAD_FILE)
    bad = parsed.where(F.col(BAD_LINE).isNotNull())
    return CheckedRead(good, bad.select(F.col(BAD_FILE).alias("file"), F.col(BAD_LINE).alias("line")))


def with_file_order(scan: DataFrame) -> DataFrame:
    """Add the position of each row in its file as a sortable struct.

    ``scan`` must be a plain file scan. The row id grows within a task, and a
    task reads a block from front to back, so (file, block, id) is file order.
    """
    return scan.withColumn(
        ROW_ORDER,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def load_joined(
    fact: DataFrame,
    identity: DataFrame | None = None,
    key: str = "TransactionID",
    fact_order: list[str] | None = None,
    identity_order: list[str] | None = None,
) -> DataFrame:
    """Fact rows with their optional identity columns, one row per key.

    Each side is reduced to its first row per key *before* the join. That gives
    the rows a join followed by keep-first gives, without ever multiplying a key
    that repeats on both sides.
    """
    from riskloom.operators.clean import dedup_keep_first, rename_columns

    fact = dedup_keep_first(rename_columns(fact), key, fact_order).drop(ROW_ORDER)
    if identity is None:
        return fact
    identity = dedup_keep_first(rename_columns(identity), key, identity_order).drop(ROW_ORDER)
    return fact.join(identity, key, "left")
