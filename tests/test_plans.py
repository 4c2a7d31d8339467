"""The shape of the physical plans: what is shuffled, broadcast and read."""

import re

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.catalog import modeling
from riskloom.catalog.cleaning import joined
from riskloom.operators import explain, neighbors
from riskloom.operators.clean import dedup_keep_first, fill_constant
from riskloom.operators.explain import ensemble_nodes, permutation_vectors, walk_trees
from riskloom.operators.group_stats import GroupStats
from riskloom.operators.metrics import curve
from riskloom.plans.features import base_features
from riskloom.plans.models import train
from riskloom.session import for_passes
from riskloom.sources.fixtures import view


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


CHEAP = [
    n
    for n in entry.queries()
    if not n.startswith(("train_", "stack_", "score_", "contrast_", "importance_from", "risk_report", "save_and", "tree_",
                         "permutation", "build_", "smote", "knn", "pca", "walk_", "logistic_", "svm_", "network_"))
]


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_join(spark, sf, name):
    text = plan_of(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ratios_do_not_shuffle_rows(spark, sf):
    df = view(spark, sf, "txn").select("TransactionID", "TransactionAmt", "card1", "card4")
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/flat")
    flat = spark.read.parquet(path)
    text = plan_of(GroupStats.fit(flat).transform(flat))
    assert text.count("BroadcastHashJoin") >= 2
    assert not re.search(r"Exchange hashpartitioning", text)


def test_row_features_are_one_narrow_stage(spark, sf):
    text = plan_of(base_features(fill_constant(view(spark, sf, "txn"))))
    assert "hashpartitioning" not in text and "Python" not in text


def test_dedup_combines_before_the_shuffle(spark, sf):
    text = plan_of(dedup_keep_first(view(spark, sf, "txn_dup"), "TransactionID", ["seq"]))
    assert "partial_min_by" in text


def test_curve_groups_scores_first(spark, sf):
    text = plan_of(curve(view(spark, sf, "scored"), "true_label", "fraud_probability"))
    # Distinct scores were written in order; only they are read, and no task gathers scores for bounds.
    assert "percentile" not in text and "Scan parquet" in text and "true_label" not in text
    # Ordered windows run per bucket; the one unpartitioned window sees bucket totals only.
    assert len(re.findall(r"Exchange SinglePartition", text)) <= 1


def test_only_needed_columns_are_read(spark, sf):
    df = joined(spark, sf).select("TransactionID", "TransactionAmt")
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().toString())
    assert all("props" not in s and "html" not in s for s in scans)


def test_network_layers_are_worked_out_once(spark, sf):
    """a layer put into the function of a node would be worked out anew for every node."""
    text = entry.queries()["network_forward"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with(namedlambdavariable" in text.replace("lambda ", "namedlambdavariable")
    assert "zip_with(transform(" not in text and "zip_with(array(" not in text


def test_passes_have_a_task_for_each_core_and_no_tiny_ones(spark):
    """F4 to F17: neither the one task of a single file nor the many of a fine shuffle."""
    rows = spark.range(100_000, numPartitions=1)
    assert for_passes(rows, 100_000, 3).rdd.getNumPartitions() == 7
    assert for_passes(rows, 10_000_000, 3).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert for_passes(spark.range(1_000, numPartitions=64), 1_000, 3).rdd.getNumPartitions() == 1
    assert for_passes(rows, 10_000_000, 400).rdd.getNumPartitions() == 120


@pytest.fixture(scope="module")
def learnable(spark, sf):
    return view(spark, sf, "learnable").persist()


def test_background_is_not_broadcast(spark, learnable):
    """the drawn rows meet the whole background, which is no small table."""
    model = train(learnable, "log", ["x1", "x2", "x3"], size="small")
    text = plan_of(permutation_vectors(model, learnable, "TransactionID", ["x1", "x2", "x3"], learnable, draws=2))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_walk_moves_rows_once(spark, learnable, monkeypatch):
    """not once for every level of the trees; more groups of trees give the same sums."""
    features = ["x1", "x2", "x3"]
    nodes = ensemble_nodes(train(learnable, "rf", features, size="short"), spark)
    walked = walk_trees(nodes, learnable, "TransactionID", features, 30)
    assert len(re.findall("Exchange hashpartitioning", plan_of(walked))) <= 2
    one = {r[0]: r[1] for r in walked.collect()}
    monkeypatch.setattr(explain, "NODES", 100)
    monkeypatch.setattr(explain, "NUMBERS", 2_000)
    many = {r[0]: r[1] for r in walk_trees(nodes, learnable, "TransactionID", features, 30).collect()}
    assert one.keys() == many.keys() and len(one) == learnable.count()
    assert max(abs(one[k] - many[k]) for k in one) < 1e-9


def test_candidates_carry_no_vectors(spark):
    """a row has many times more candidates than neighbours, and one vector only."""
    rows = spark.range(300).select(F.col("id").alias("gid"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(4)]).alias("v"))
    found = neighbors._hashed_candidates(rows, 1.0, 3, 16, 42)
    assert found.columns == ["gid", "neighbor_gid", "distance"]
    known = {r["gid"]: r["v"] for r in rows.collect()}
    for r in neighbors.nearest_neighbors(rows, "gid", "v", 3, block_rows=16).collect():
        assert r["neighbor_vector"] == known[r["neighbor_id"]]


def test_rows_between_the_same_bounds_meet_leaves_once(spark, learnable, monkeypatch):
    met = []
    grid = explain._grid_vectors

    def counted(nodes, rows, key, features):
        met.append(rows.count())
        return grid(nodes, rows, key, features)

    monkeypatch.setattr(explain, "_grid_vectors", counted)
    model = train(learnable, "contrast_xgb", ["x1"], size="short", overrides={"maxBins": 8})
    vectors, base = explain.tree_vectors(model, learnable, "TransactionID", ["x1"])
    assert met[0] <= 8 < learnable.count() == vectors.count()
    off = F.abs(vector_to_array("rawPrediction")[1] - F.col("phi")[0] - F.lit(base)) > 1e-9
    assert model.transform(learnable).join(vectors, "TransactionID").where(off).count() == 0


def test_plan_is_fitted_on_written_rows(spark, sf, monkeypatch):
    """F32: not joined and freed of repeats again for every statistic."""
    seen = []

    class Stop(Exception):
        pass

    def fit(rows, options):
        seen.append(plan_of(rows))
        raise Stop

    monkeypatch.setattr(modeling.FeaturePlan, "fit", fit)
    monkeypatch.setattr(modeling, "_FITTED", {})
    for run in (modeling.build_features, modeling._state):
        with pytest.raises(Stop):
            run(spark, sf)
    assert len(seen) == 2 and all("Scan parquet" in p and "Join" not in p for p in seen)
