"""Checked reads, sinks read back, keep-first on a stream."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.clean import dedup_keep_first
from riskloom.operators.lookup import hot_values, lookup_join, table_bytes
from riskloom.sources.tables import read_checked, read_table
from riskloom.streaming.scoring import keep_first_arrival, read_arriving

HEAD = "TransactionID,TransactionAmt,card4\n"


def test_bad_cells_are_set_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "1,2.5,x\n2,oops,y\n3,,\n")
    (tmp_path / "b.csv").write_text(HEAD + "4,1e3,z\n5,7.0,w,extra\n1x,1.0,q\n")
    got = read_checked(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(tuple(r) for r in got.rows.collect()) == [(1, 2.5, "x"), (3, None, None), (4, 1000.0, "z")]
    assert got.rows.select("card4").count() == 3  # whichever columns are used
    bad = {(r.file.rsplit("/", 1)[1], r.line) for r in got.rejected.collect()}
    assert bad == {("a.csv", "2,oops,y"), ("b.csv", "5,7.0,w,extra"), ("b.csv", "1x,1.0,q")}
    clean = read_checked(spark, str(tmp_path / "a.csv"), types=None).rows
    assert clean.schema == read_table(spark, str(tmp_path / "a.csv")).schema


def test_stream_of_swapped_columns_fails(spark, tmp_path):
    """A file whose header has another order is not read by position."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.csv").write_text(HEAD + "1,2.5,x\n")
    (source / "b.csv").write_text("TransactionAmt,TransactionID,card4\n7.0,2,y\n")
    schema = "TransactionID long, TransactionAmt double, card4 string"
    rows = read_arriving(spark, str(source), spark.createDataFrame([], schema).schema, "csv")
    query = rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c"))
    with pytest.raises(Exception, match="(?i)header|column"):
        query.trigger(availableNow=True).start().awaitTermination()


def test_keep_first_on_a_stream(spark, tmp_path):
    """Repeats within a file, across files and without a key: the rows the batch operator keeps."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, seq int, v string, _at int"
    files = [
        [(1, 3, "late", 0), (1, 1, "first", 0), (2, 1, "two", 0), (None, 2, "n2", 0), (None, 1, "n1", 0)],
        [(1, 4, "again", 0), (3, 2, "b", 0), (3, 2, "a", 0), (None, 3, "n3", 0)],
        [(2, 9, "no", 0), (4, 9, "four", 0), (3, 9, "no", 0)],
    ]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    rows = read_arriving(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
    kept = keep_first_arrival(rows, "id", ["seq"])
    assert kept.columns == ["id", "seq", "v", "_at"]
    write = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
    write.trigger(availableNow=True).start().awaitTermination()
    got = {(r["id"], r["seq"]) for r in spark.read.parquet(out).collect()}
    want = dedup_keep_first(spark.createDataFrame([r for f in files for r in f], schema), "id", ["seq"])
    assert got == {(r["id"], r["seq"]) for r in want.collect()} and spark.read.parquet(out).count() == 5


def test_unseen_crowded_key_is_spread(spark):
    """A value never fitted that fills the rows is found by counting them and joined as absent."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, -5).otherwise(F.col("id")).alias("k"))
    table = spark.range(1, 20_000, 4).select(F.col("id").alias("k"), F.lit(1).alias("n"), (F.col("id") * 2).alias("s"))
    assert hot_values(rows, "k") == [-5]
    got = lookup_join(rows, table, "k", broadcast_bytes=0)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text
    want = rows.join(table.drop("n"), "k", "left").select("id", "k", "s")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = lookup_join(rows, table, "k", broadcast_bytes=0).where("k = -5").groupBy(F.spark_partition_id().alias("p")).count()
        assert spread.agg(F.max("count")).first()[0] < 3_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_bytes_limit_the_broadcast(spark):
    wide = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("n"), F.repeat(F.lit("x"), 10_000).alias("s"))
    assert 1_000_000 < table_bytes(wide) < 1_100_000
    rows = spark.range(50).select(F.col("id").alias("k"))
    narrow = lookup_join(rows, wide, "k", broadcast_bytes=1 << 21)
    large = lookup_join(rows, wide, "k", broadcast_bytes=1 << 19)
    assert "SortMergeJoin" not in narrow._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, large.collect()))
