"""Edge rows of the feature operators."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import clean, encode, metrics, profile, sampling
from riskloom.operators.group_stats import GroupStats
from riskloom.operators.lookup import lookup_join
from riskloom.operators.ordering import hashed_rank, running_totals, sorted_position
from riskloom.sources.tables import load_joined, read_table, schema_for, with_file_order


def one(df, *columns):
    row = df.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.fixture(scope="module")
def cards(spark):
    rows = [
        (1, "single", 10.0), (2, "flat", 5.0), (3, "flat", 5.0), (4, "zero", -1.0), (5, "zero", 1.0), (6, None, 3.0),
    ]
    return spark.createDataFrame(rows, "TransactionID long, card1 string, TransactionAmt double")


def test_group_edges(cards):
    filled = clean.fill_constant(cards)
    out = GroupStats.fit(filled, {"TransactionAmt": ("card1",)}).transform(
        filled, zscores={"z": ("TransactionAmt", "card1")}
    )
    got = {r["TransactionID"]: r for r in out.collect()}
    assert got[1]["TransactionAmt_to_std_card1"] is None and got[1]["z"] is None
    assert got[2]["TransactionAmt_to_std_card1"] is None and got[2]["z"] == 0.0
    assert got[4]["TransactionAmt_to_mean_card1"] is None
    assert got[6]["TransactionAmt_to_mean_card1"] == 1.0  # the filled key is a group of its own


def test_constant_fill_of_ratios(spark):
    df = spark.createDataFrame([(1, 1, -1.0), (2, 1, 1.0), (3, 2, 4.0)], "TransactionID long, card1 long, D15 double")
    out = GroupStats.fit(df, {"D15": ("card1",)}).transform(df)
    got = {r["TransactionID"]: r for r in out.collect()}
    assert got[1]["D15_to_mean_card1"] == -1.0 and got[3]["D15_to_std_card1"] == -1.0


def test_nonfinite_and_all_null(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), None), (2, float("inf"), None), (3, -1.0, None), (4, 3.0, None), (5, float("-inf"), None)],
        "id long, v double, nothing double",
    )
    out = clean.fill_nonfinite_median(df, ["v", "nothing"])
    assert sorted(r["v"] for r in out.collect()) == [-1.0, 1.0, 1.0, 1.0, 3.0]
    assert {r["nothing"] for r in out.collect()} == {-1.0}
    assert clean.sparse_columns(df) == ["nothing"]
    assert one(df.where("id = 3"), S.log_amount(F.col("v"))) is None
    assert one(df.where("id = 3"), S.fraction_of(F.lit(-1.5))) == 0.5


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_medians(spark, n):
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(97)) / 7).alias("a"), F.col("id").cast("double").alias("b"))
    want = df.agg(F.median("a"), F.median("b")).first()
    got = profile.exact_medians(df, ["a", "b"], bins=3)
    assert got["a"] == pytest.approx(want[0], abs=1e-12) and got["b"] == want[1]


def test_medians_of_extreme_values(spark):
    rows = [(5e-324, -1e308, 2.0), (0.0, 1e308, 2.0), (1e-200, 1e-9, 2.0), (-5e-324, 7.0, 2.0), (None, float("nan"), 3.0)]
    got = profile.exact_medians(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert got == {"a": 0.0, "b": (1e-9 + 7.0) / 2, "c": 2.0}


def test_rush_hour_bounds(spark):
    df = spark.createDataFrame([(7.0,), (9.0,), (9.2,), (17.0,), (19.0,), (22.0,), (6.0,)], "h double")
    assert [r[0] for r in df.select(S.is_rush_hour(F.col("h"))).collect()] == [1, 1, 0, 1, 1, 0, 0]
    assert [r[0] for r in df.select(S.is_night(F.col("h"))).collect()] == [0, 0, 0, 0, 0, 1, 1]


def test_domains(spark):
    df = spark.createDataFrame([("word",), ("a.b",), ("a.b.c.d",), (None,)], "d string")
    rest = [tuple(r) for r in df.select(*S.domain_parts(F.col("d"))).collect()]
    assert rest == [("word", "missing", "missing"), ("a", "b", "missing"), ("a", "b", "c.d"), ("missing",) * 3]
    with pytest.raises(Exception, match="more than three parts"):
        df.select(*S.domain_parts_strict(F.col("d"))).collect()


def test_unseen_category(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    new = spark.createDataFrame([("c",), ("a",)], "c string")
    encoder = encode.LabelEncoder.fit(fit)
    assert sorted(r["c"] for r in encoder.transform(new).collect()) == [-1, 0]
    assert sorted(r["c"] for r in encoder.transform(new, broadcast_bytes=0).collect()) == [-1, 0]
    frequencies = encode.FrequencyEncoder.fit(fit).transform(new)
    assert {r["c"]: r["c_freq"] for r in frequencies.collect()} == {"c": None, "a": 1}


def test_missing_identity(spark):
    fact = spark.createDataFrame([(1, 5.0), (2, 6.0), (2, 7.0)], "TransactionID long, a double")
    identity = spark.createDataFrame([(2, "x"), (2, "y")], "TransactionID long, `id-12` string")
    out = load_joined(fact, identity, fact_order=["a"], identity_order=["id_12"])
    assert {tuple(r) for r in out.collect()} == {(1, 5.0, None), (2, 6.0, "x")}
    assert load_joined(fact, None, fact_order=["a"]).count() == 2


def test_file_order(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("TransactionID,TransactionAmt,card4\n1,9.5,z\n1,1.5,a\n2,3,\n")
    scan = read_table(spark, path)
    assert scan.schema == schema_for(["TransactionID", "TransactionAmt", "card4"])
    out = load_joined(with_file_order(scan))
    assert {tuple(r) for r in out.collect()} == {(1, 9.5, "z"), (2, 3.0, None)}


def test_one_class(spark):
    df = spark.createDataFrame([(0, 0.2, 0), (0, 0.9, 1)], "y int, p double, pred int")
    assert one(metrics.roc_auc(df, "y", "p"), "roc_auc") is None
    row = metrics.threshold_metrics(df, "y", "pred").first()
    assert row["precision"] == 0.0 and row["recall"] == 0.0 and row["accuracy"] == 0.5


def test_tied_scores(spark):
    df = spark.createDataFrame([(0.9, 0), (0.9, 1), (0.7, 1), (0.4, 0)], "p double, y int")
    assert one(metrics.pr_auc(df, "y", "p"), "pr_auc") == pytest.approx(0.6666667)
    assert one(metrics.roc_auc(df, "y", "p"), "roc_auc") == pytest.approx(0.625)


def test_hot_lookup_keeps_every_row(spark):
    """A third of the rows share one key, some have none."""
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id")).alias("k")
    )
    table = df.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    want = {tuple(r) for r in df.join(table, "k", "left").select("id", "k", "s").collect()}
    got = lookup_join(df, table, "k", table.count(), broadcast_bytes=0)
    assert got.columns == ["id", "k", "s"]
    assert {tuple(r) for r in got.collect()} == want and len(want) == 3000


def test_hot_dedup(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), (-F.col("id")).alias("o"))
    out = clean.dedup_keep_first(df, "k", ["o"])
    assert out.count() == 2001 and one(out.where("k = -1"), "o") == -2997


@pytest.mark.parametrize("partitions", [1, 13])
def test_folds_do_not_depend_on_partitions(spark, sf, partitions):
    from riskloom.sources.fixtures import view

    df = view(spark, sf, "txn").select("TransactionID", "isFraud")
    want = {tuple(r) for r in sampling.stratified_kfold(df, "TransactionID", k=5).collect()}
    got = {tuple(r) for r in sampling.stratified_kfold(df.repartition(partitions), "TransactionID", k=5).collect()}
    assert got == want
    sizes = {}
    for _, label, fold in want:
        sizes[label, fold] = sizes.get((label, fold), 0) + 1
    for label in (0, 1):
        per = [n for (lab, _), n in sizes.items() if lab == label]
        assert len(per) == 5 and max(per) - min(per) <= 1


def test_positions_and_totals(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("string")).alias("s"))
    got = sorted_position(df, ["s"]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(500))
    assert [r["s"] for r in got] == sorted(r["s"] for r in got)

    scores = spark.range(1000).select((F.col("id") % 37 / 7).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    rows = sorted(running_totals(scores, "x", ["n"]).collect(), key=lambda r: r["x"])
    total = 0
    for r in rows:
        total += r["n"]
        assert r["upto_n"] == total and r["total_n"] == 1000


def test_hashed_rank_is_a_permutation(spark):
    df = spark.range(777).withColumn("h", S.ordering_hash(F.col("id")))
    assert sorted(r["rank"] for r in hashed_rank(df, "h").collect()) == list(range(1, 778))


def test_histogram_of_equal_scores(spark):
    df = spark.createDataFrame([(0, 0.5), (0, 0.5), (1, 0.1), (1, 0.9)], "y int, p double")
    rows = metrics.score_histogram(df, "y", "p").collect()
    assert len(rows) == 100 and sum(r["n"] for r in rows) == 4
    for label in (0, 1):
        area = sum(r["density"] for r in rows if r["label"] == label) * (1.0 if label == 0 else 0.8) / 50
        assert math.isclose(area, 1.0)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    for scaler in (encode.StandardScaler.fit(df), encode.StandardScaler.fit_complete(df, ["a", "b"])):
        assert sorted(tuple(r) for r in scaler.transform(df).collect()) == [(-1.0, 0.0), (1.0, 0.0)]
    assert sorted(tuple(r) for r in encode.MinMaxScaler.fit(df).transform(df).collect()) == [(0.0, 0.0), (1.0, 0.0)]


def test_no_narrow_column(spark):
    df = spark.range(500)
    assert profile.narrow_frequencies(df, ["id"], 50).count() == 0
    assert tuple(profile.distinct_counts(df, ["id"], 50).first()) == ("id", df.select("id").distinct().count(), False)
    assert encode.FrequencyEncoder.fit(df, ["id"]).transform(df).columns == ["id"]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1.0)] * 19 + [(1.0, 2.0)], "hollow double, full double")
    assert clean.sparse_columns(df) == ["hollow"]
    assert {r.feature: round(r.null_share, 2) for r in profile.column_profile(df).collect()} == {"hollow": 0.95, "full": 0.0}


def test_csv_with_other_column_order_is_not_misread(spark, tmp_path):
    from riskloom.sources.tables import read_table

    (tmp_path / "a.csv").write_text("TransactionID,TransactionAmt,dist1\n1,3.5,200\n")
    (tmp_path / "b.csv").write_text("TransactionID,dist1,TransactionAmt\n2,200,3.5\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert read_table(spark, paths[:1]).first().TransactionAmt == 3.5
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, paths).collect()


def test_keep_first_passes_unique_keys(spark):
    rows = [(1, 5.0, 2), (1, 7.0, 1), (2, 3.0, 9), (None, 1.0, 4), (None, 2.0, 3)]
    got = clean.dedup_keep_first(spark.createDataFrame(rows, "k int, v double, at int"), "k", ["at"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 7.0, 1), (2, 3.0, 9), (None, 2.0, 3)], key=repr)
