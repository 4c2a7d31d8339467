"""Learners, stacking, explanation, saved state, neighbours."""

import itertools
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskloom.catalog import modeling
from riskloom.operators import explain, machines, neighbors
from riskloom.operators.metrics import areas
from riskloom.operators.sampling import stratified_kfold
from riskloom.plans import models, stack
from riskloom.plans.features import FeaturePlan, PlanOptions
from riskloom.plans.jobs import score_rows, train_job
from riskloom.session import fits_at_once, tasks_of_a_pass
from riskloom.sources.fixtures import view
from riskloom.sources.state import IncompleteState, load_state

KEY, FEATURES = "TransactionID", ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def learnable(spark, sf):
    return view(spark, sf, "learnable").persist()


@pytest.mark.parametrize("name", [*models.BASE_MODELS, *models.SINGLE_MODELS])
def test_learner(learnable, name):
    model = models.train(learnable, name, FEATURES, size="small", key=KEY)
    scored = model.score(learnable, "m")
    assert areas(scored, "isFraud", "m_prob").first()["roc_auc"] > 0.8
    low, high = scored.agg(F.min("m_prob"), F.max("m_prob")).first()
    assert 0.0 <= low <= high <= 1.0


def test_machines_reach_the_least_loss_in_few_passes(spark, learnable, monkeypatch):
    calls, sums = [], machines._sums
    monkeypatch.setattr(machines, "_sums", lambda *a: calls.append(1) or sums(*a))
    model = models.train(learnable, "svm", FEATURES, size="short", key=KEY)
    assert len(calls) < 100
    folded = stratified_kfold(learnable, KEY, "isFraud", 5).toPandas()
    for i, machine in enumerate(model.machines):
        rows = folded[folded.fold != i]
        x, y = rows[FEATURES].to_numpy(), 2.0 * rows["isFraud"].to_numpy() - 1
        n = len(rows)

        def loss(w, b):
            return np.maximum(0, 1 - y * (x @ w + b)).mean() + w @ w / (2 * n)

        w, b = np.array(machine.coefficients), machine.intercept
        found = loss(w, b)
        random = np.random.default_rng(i)
        for size in (1e-3, 1e-2, 0.1, 1.0):
            for step in random.normal(size=(200, 4)) * size:
                assert loss(w + step[:3], b + step[3]) > found * (1 - 1e-4)


def test_machines_are_kept(spark, learnable, tmp_path):
    model = models.train(learnable, "svm", FEATURES, size="small", key=KEY)
    model.save(str(tmp_path / "svm"))
    loaded = models.load_trained(spark, str(tmp_path / "svm"), "svm", FEATURES, model.params)
    assert loaded.machines == model.machines


def test_full_presets_are_complete():
    assert list(models.build_base_models()) == ["rf", "lgb", "xgb", "catboost"]
    assert list(models.build_meta_models()) == ["meta_pred", "meta_prob"]
    assert set(models.FULL) == set(models.SMALL)


def test_fits_on_all_rows_run_beside_those_of_the_folds(learnable, monkeypatch):
    passes, run = [], stack.run_jobs
    monkeypatch.setattr(stack, "run_jobs", lambda tasks, workers: passes.append(len(tasks)) or run(tasks, workers))
    result = stack.train_stack(learnable, FEATURES, KEY, "isFraud", k=2, base_models=("log",), size="small")
    assert passes == [3, 2]  # two folds and all rows, then both metas
    plain = models.train(learnable, "log", FEATURES, size="small").learner
    found, last = result.model.base["log"].learner, result.last_fold["log"].learner
    assert np.allclose(found.coefficients.toArray(), plain.coefficients.toArray(), rtol=1e-6)
    assert not np.allclose(last.coefficients.toArray(), plain.coefficients.toArray(), rtol=1e-6)
    kept = stack.train_stack(learnable, FEATURES, KEY, "isFraud", k=2, base_models=("log",), size="small", final="last_fold")
    assert passes[2:] == [2, 2] and np.allclose(kept.model.base["log"].learner.coefficients.toArray(), last.coefficients.toArray(), rtol=1e-6)


def test_out_of_fold(learnable):
    result = stack.train_stack(learnable, FEATURES, k=3, size="small", base_models=("rf", "xgb"))
    meta = result.meta_table
    assert meta.count() == learnable.count() == meta.select(KEY).distinct().count()
    scores = {r["model"]: r for r in result.cv_scores().collect()}
    assert set(scores) == {"rf", "xgb"} and all(r["n_folds"] == 3 and r["mean_auc"] > 0.8 for r in scores.values())
    compared = {r["model"]: r["roc_auc"] for r in result.model.comparison(learnable).collect()}
    assert set(compared) == {"rf", "xgb", "meta_pred", "meta_prob", "ensemble"} and min(compared.values()) > 0.8
    assert stack.in_sample_comparison(result).count() == 5


def test_last_fold_models(learnable):
    result = stack.train_stack(learnable, FEATURES, k=2, size="small", base_models=("xgb",), final="last_fold")
    assert result.model.score(learnable).where("fraud_probability between 0 and 1").count() == learnable.count()


def brute_force(x, paths):
    """Path-dependent Shapley values by all subsets, from the definition."""
    d = len(x)

    def value(subset):
        total = 0.0
        for leaf in paths:
            part = leaf.value
            for j, f in enumerate(leaf.features):
                inside = leaf.low[j] < x[f] <= leaf.high[j]
                part *= float(inside) if f in subset else leaf.share[j]
            total += part
        return total

    phi = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for r in range(d):
            for subset in itertools.combinations(others, r):
                w = math.factorial(r) * math.factorial(d - r - 1) / math.factorial(d)
                phi[i] += w * (value({*subset, i}) - value(set(subset)))
    return phi


@pytest.mark.parametrize("name", ["rf", "xgb"])
def test_tree_attribution_is_shapley(spark, learnable, name):
    model = models.train(learnable, name, FEATURES, size="small")
    paths = leaf_paths(explain.leaf_chunks(explain.ensemble_nodes(model, spark)))
    few = learnable.orderBy(KEY).limit(5)
    x = {r[KEY]: np.array([r[c] for c in FEATURES]) for r in few.collect()}
    vectors, _ = explain.tree_vectors(model, few, KEY, FEATURES)
    got = {r[KEY]: np.array(r["phi"]) for r in vectors.collect()}
    assert got.keys() == x.keys()
    for key, row in x.items():
        assert np.allclose(got[key], brute_force(row, paths), atol=1e-10)


def leaf_paths(chunks):
    """The leaves of all chunks one by one, as the plain version wants them."""
    out = []
    for c in chunks.collect():
        for i, value in enumerate(c["value"]):
            at = slice(i * c["width"], (i + 1) * c["width"])
            out.append(SimpleNamespace(value=value, features=c["feature"][at], low=c["low"][at], high=c["high"][at], share=c["share"][at]))
    return out


def test_deep_forest_adds_up_in_many_groups(spark, learnable, monkeypatch):
    """200 trees of depth 30 in chunks that fill many cells of the grid; nothing is collected."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    monkeypatch.setattr(explain, "LEAVES", 64)
    monkeypatch.setattr(explain, "ROWS", 100)
    v = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(learnable)
    model = RandomForestClassifier(featuresCol="v", labelCol="isFraud", numTrees=200, maxDepth=30, minInstancesPerNode=4, seed=2).fit(v)
    chunks = explain.leaf_chunks(explain.ensemble_nodes(model, spark)).count()
    assert chunks > 2 * explain.CHUNKS
    vectors, base = explain.tree_vectors(model, learnable, KEY, FEATURES)
    total = vectors.select(KEY, F.aggregate("phi", F.lit(0.0), lambda a, b: a + b).alias("s"))
    joined = model.transform(v).join(total, KEY)
    gap = F.abs(vector_to_array("probability")[1] - F.col("s") - F.lit(base))
    row = joined.agg(F.count("*"), F.max(gap)).first()
    assert row[0] == learnable.count() and row[1] < 1e-9


@pytest.mark.parametrize("name", ["rf", "xgb"])
def test_walk_equals_model(spark, learnable, name, monkeypatch):
    model = models.train(learnable, name, FEATURES, size="small")
    nodes = explain.ensemble_nodes(model, spark)
    walked = explain.walk_trees(nodes, learnable, KEY, FEATURES, model.params["maxDepth"])
    output = "probability" if name == "rf" else "rawPrediction"
    gap = F.abs(vector_to_array(output)[1] - F.col("margin"))
    row = model.transform(learnable).join(walked, KEY).agg(F.count("*"), F.max(gap)).first()
    assert row[0] == learnable.count() and row[1] < 1e-9


def test_summary_equals_long_rows(spark, learnable):
    fits = {name: models.train(learnable, name, FEATURES, size="small", key=KEY) for name in ("xgb", "log", "svm")}
    few = learnable.where("TransactionID % 10 = 1")
    summary, long = explain.explain_models(fits, few, KEY, FEATURES, learnable, draws=2, rows=True)
    got = {(r["model"], r["feature"]): (r["mean_abs"], r["mean_signed"], r["n"]) for r in summary.collect()}
    want = long.groupBy("model", "feature").agg(F.avg(F.abs("shap_value")), F.avg("shap_value"), F.count("*")).collect()
    assert len(got) == 9 and all(got[r[0], r[1]] == pytest.approx(tuple(r)[2:]) for r in want)
    empty, _ = explain.explain_models(fits, few.limit(0), KEY, FEATURES, learnable, draws=2)
    assert empty.count() == 0


def test_unused_feature_gets_nothing(learnable):
    df = learnable.withColumn("constant", F.lit(1.0))
    model = models.train(df, "xgb", [*FEATURES, "constant"], size="small")
    values, _ = explain.tree_attribution(model, df, KEY, [*FEATURES, "constant"])
    assert values.where("feature = 'constant'").agg(F.max(F.abs("shap_value"))).first()[0] == 0.0


def test_categorical_split(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler, VectorIndexer

    df = spark.range(400).select(
        "id", (F.col("id") % 4).cast("double").alias("c"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("x")
    ).withColumn("y", (F.col("c").isin(1.0, 3.0) & (F.col("x") > 0.3)).cast("double"))
    v = VectorAssembler(inputCols=["c", "x"], outputCol="v").transform(df)
    v = VectorIndexer(inputCol="v", outputCol="f", maxCategories=5).fit(v).transform(v)
    model = GBTClassifier(labelCol="y", featuresCol="f", maxIter=3, maxDepth=3, seed=1).fit(v)
    values, base = explain.tree_attribution(model, df, "id", ["c", "x"])
    total = values.groupBy("id").agg(F.sum("shap_value").alias("s"))
    gap = F.abs(vector_to_array("rawPrediction")[1] - F.col("s") - F.lit(base))
    assert model.transform(v).join(total, "id").agg(F.max(gap)).first()[0] < 1e-9


def test_permutation_values_add_up(learnable):
    model = models.train(learnable, "log", FEATURES, size="small")
    few = learnable.orderBy(KEY).limit(20)
    errors = []
    for draws in (3, 40):
        vectors = explain.permutation_vectors(model, few, KEY, FEATURES, learnable, draws)
        total = F.aggregate("phi", F.lit(0.0), lambda a, b: a + b)
        rows = vectors.join(model.score(few, "m"), KEY).select((F.col("m_prob") - total - F.col("base")).alias("gap"), "std_error").collect()
        assert len(rows) == 20 and all(abs(r["gap"]) < 1e-9 for r in rows)
        errors.append(np.mean([r["std_error"] for r in rows]))
    assert errors[1] < 0.6 * errors[0]
    one = explain.permutation_attribution(model, few, KEY, FEATURES, learnable.limit(1), draws=1)
    assert one.count() == 60 and one.where("std_error is not null").count() == 0


def test_network_draws_are_those_of_its_model(spark, learnable, monkeypatch):
    """Blocks switched and scored in place give what the model gives for rows taken apart; only its weights are asked."""
    rows = learnable.where(F.col(KEY) % 5 == 0)
    model = models.train(rows, "mlp", FEATURES, size="small")
    asked, ask = [], models.TrainedModel.transform
    monkeypatch.setattr(models.TrainedModel, "transform", lambda self, df: asked.append(df) or ask(self, df))
    found = explain.drawn_vectors(model, rows, KEY, FEATURES, rows, draws=3)
    assert not asked
    plain = explain.drawn_vectors(model.pipeline, rows, KEY, FEATURES, rows, draws=3)
    both = found.join(plain.select(KEY, "draw", F.col("phi").alias("other"), F.col("base").alias("b")), [KEY, "draw"]).collect()
    assert len(both) == 3 * rows.count()
    for r in both:
        assert r["phi"] == pytest.approx(r["other"], abs=1e-12) and r["base"] == pytest.approx(r["b"], abs=1e-12)
    vectors = {r[KEY]: r for r in explain.permutation_vectors(model, rows, KEY, FEATURES, rows, draws=3).collect()}
    of = {}
    for r in both:
        of.setdefault(r[KEY], []).append(r["phi"])
    for k, phis in of.items():
        assert vectors[k]["phi"] == pytest.approx(np.mean(phis, axis=0).tolist(), abs=1e-12)
        assert vectors[k]["std_error"] == pytest.approx((np.std(phis, axis=0, ddof=1) / np.sqrt(3)).tolist(), abs=1e-12)
    text = explain.permutation_vectors(model, rows, KEY, FEATURES, rows, draws=3)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text


def test_permutation_of_a_linear_margin(spark):
    """With one background row the values of an additive model are exact, whatever the orders."""
    rows = spark.range(30).select("id", (F.col("id") % 5 / 5).alias("a"), (F.col("id") % 7 / 7).alias("b"))

    class Additive:
        def transform(self, df):
            p = F.col("a") * 0.5 + F.col("b") * 0.25
            return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))

    got = explain.permutation_vectors(Additive(), rows, "id", ["a", "b"], rows.where("id = 9"), draws=2)
    for r in got.join(rows, "id").collect():
        assert r["phi"] == pytest.approx([(r["a"] - 0.8) * 0.5, (r["b"] - 2 / 7) * 0.25])


def test_plan_state_and_partial_state(spark, sf, tmp_path):
    fact, identity = view(spark, sf, "txn"), view(spark, sf, "identity")
    out = str(tmp_path / "run")
    report = train_job(fact, identity, k=2, size="small", base_models=("xgb",), explain_rows=100, keep_attributions=True,
                       explain_last_fold=True, output=out)
    assert report.attributions.select(KEY).distinct().count() == 100
    assert report.fold_importance.count() == report.importance.count() == len(report.state.plan.features)
    assert spark.read.parquet(f"{out}/importance_last_fold").count() == report.importance.count()
    assert report.comparison.count() == 4
    new = fact.drop("isFraud", "addr1")  # an absent column counts as missing
    before = {tuple(r) for r in score_rows(report.state, new, identity).collect()}
    loaded = load_state(spark, f"{out}/models")
    assert {tuple(r) for r in score_rows(loaded, new, identity).collect()} == before and len(before) == 1000
    assert score_rows(loaded, fact.where("TransactionID = 5")).count() == 1

    # a second save that stops before its manifest leaves the first one
    models = tmp_path / "run" / "models"
    loaded.plan.save(str(models / "versions" / "99999999999999999999-cut" / "plan"))
    again = load_state(spark, str(models))
    assert {tuple(r) for r in score_rows(again, new, identity).collect()} == before

    saved = next(p for p in (models / "versions").iterdir() if not p.name.endswith("cut"))
    (saved / "models" / "meta_meta_prob").rename(tmp_path / "aside")
    with pytest.raises(IncompleteState, match="meta_meta_prob"):
        load_state(spark, f"{out}/models")
    with pytest.raises(IncompleteState):
        load_state(spark, str(tmp_path / "nowhere"))


def test_plan_options(spark, sf):
    rows = view(spark, sf, "txn").withColumn("rare", F.when(F.col("card1") == 3, F.lit(2.0)))
    plan = FeaturePlan.fit(rows, PlanOptions(keep_key=True))
    assert "rare" not in plan.columns and "TransactionID_value" in plan.medians
    assert "rare" in FeaturePlan.fit(rows, PlanOptions(sparse_after_fill=True)).columns
    scaled = plan.transform(rows)
    row = scaled.agg(*[F.avg(c).alias(f"m_{c}") for c in plan.features], *[F.stddev_pop(c).alias(f"s_{c}") for c in plan.features]).first()
    for c in plan.features:
        assert abs(row[f"m_{c}"]) < 1e-6 and (row[f"s_{c}"] == pytest.approx(1.0) or row[f"s_{c}"] == 0.0)


def test_block_of_columns(spark, sf):
    from riskloom.operators.reduce import BlockPCA, block_from_array

    df = block_from_array(view(spark, sf, "vectors"), "embedding", 64)
    names = [f"V{i + 1}" for i in range(64)]
    out = BlockPCA.fit(df, names).transform(df).orderBy("vec_id")
    got = np.array([[r[f"V_PCA_{i}"] for i in range(1, 6)] for r in out.collect()])
    x = np.array([[r[c] for c in names] for r in df.orderBy("vec_id").collect()])
    x = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :5] * s[:5]), atol=1e-8)
    plan = FeaturePlan.fit(df.withColumnRenamed("vec_id", KEY))
    assert plan.features == [f"V_PCA_{i}" for i in range(1, 6)]


@pytest.mark.parametrize("block_rows", [40, 1000])
def test_neighbors_against_brute_force(spark, block_rows):
    """Integer grid with many ties; a third of the rows are copies of one."""
    rng = np.random.default_rng(0)
    v = rng.integers(0, 12, size=(300, 3)).astype(float)
    v[:100] = v[0]
    v[200:210] = v[199]
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    near = neighbors.nearest_neighbors(df, "id", "v", 5, block_rows=block_rows)
    got = {(r["id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in near.collect()}
    assert len(got) == 1500
    for i in range(len(v)):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        order = sorted((d[j], j) for j in range(len(v)) if j != i)[:5]
        for rank, (distance, j) in enumerate(order, 1):
            assert got[i, rank] == (j, pytest.approx(distance))


def test_visits_of_a_row_do_not_grow_with_the_table(spark, monkeypatch):
    kept, write = [], neighbors.materialise
    monkeypatch.setattr(neighbors, "materialise", lambda df: kept.append(write(df)) or kept[-1])
    visited = {}
    for n in (2_000, 24_000):
        v = np.random.default_rng(7).random((n, 3))
        v[:, 2] = np.floor(v[:, 2] * 20) / 20
        df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "id long, v array<double>")
        near = neighbors.nearest_neighbors(df, "id", "v", 5, block_rows=64).where("id % 200 = 0").collect()
        for i in range(0, n, 200):
            d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
            d[i] = np.inf
            found = [r["neighbor_id"] for r in sorted((r for r in near if r["id"] == i), key=lambda r: r["rank"])]
            assert found == np.lexsort((np.arange(n), d))[:5].tolist()
        visits = [t for t in kept if "cells" in t.columns][-1]
        visited[n] = visits.agg(F.avg(F.size("cells"))).first()[0]
    assert visited[24_000] < 1.5 * visited[2_000] and visited[24_000] < 40


@pytest.mark.parametrize("width", [2, 13])
def test_cells_travel_without_the_package(spark, monkeypatch, width):
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or send(value))
    rows = spark.range(200).select("id", F.array(*[F.col("id") * (i + 1.0) for i in range(width)]).alias("v"))
    assert neighbors.nearest_neighbors(rows, "id", "v", 3, block_rows=40).count() == 600
    assert len(sent) == 2
    for value in sent:
        assert all(v is None or type(v) in (int, np.ndarray) for v in value.values())


def test_hashed_neighbors_of_clusters(spark):
    """64 dimensions, 40 clusters: nearly all neighbours, few visits, k for every row."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64)) * 4
    v = np.vstack([c + rng.normal(size=(50, 64)) * 0.3 for c in centres] + [rng.normal(size=(1, 64)) * 60])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    exact = neighbors.nearest_neighbors(df, "id", "v", 5)
    found = neighbors.nearest_neighbors(df, "id", "v", 5, mode="hashed", block_rows=30).persist()
    assert found.count() == 5 * len(v)
    assert neighbors.recall(found, exact, "id").first()["recall"] >= 0.9
    groups = df.select(F.col("id").alias("gid"), "v")
    stretch = neighbors._stretch(groups, len(v), 5, 42)
    assert 4 * 1.5 < stretch < 4 * 6
    pairs = neighbors._hashed_candidates(groups, stretch, 400, 2_048, 42).groupBy("gid").count().agg(F.avg("count")).first()[0]
    assert pairs < 0.1 * len(v)


def test_smote_of_two_rows_is_dealt_out(spark):
    rows = spark.range(5_002).select("id", F.array(F.col("id") * 1.0).alias("v"), (F.col("id") < 2).cast("int").alias("isFraud"))
    made = neighbors.smote(rows, "id", "v").where("synthetic = 1").persist()
    assert made.count() == 4_998
    assert made.groupBy("base_id").count().agg(F.min("count"), F.max("count")).first()[:] == (2_499, 2_499)
    assert made.where("v[0] between 0 and 1").count() == 4_998
    assert made.select(F.spark_partition_id()).distinct().count() > 1


def test_smote(spark, sf):
    df = view(spark, sf, "vectors")
    out = neighbors.smote(df, "vec_id", "embedding").persist()
    counts = {r["isFraud"]: r["count"] for r in out.groupBy("isFraud").count().collect()}
    assert counts[0] == counts[1] == df.where("isFraud = 0").count()
    assert out.where("synthetic = 0").count() == df.count()
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in df.collect()}
    near = neighbors.nearest_neighbors(df.where("isFraud = 1"), "vec_id", "embedding", 5)
    allowed = {(r["vec_id"], r["neighbor_id"]) for r in near.collect()}
    for r in out.where("synthetic = 1").collect():
        assert (r["base_id"], r["neighbor_id"]) in allowed
        a, b = vectors[r["base_id"]], vectors[r["neighbor_id"]]
        x = np.array(r["embedding"])
        u = np.dot(x - a, b - a) / np.dot(b - a, b - a)
        assert -1e-9 <= u <= 1 + 1e-9 and np.allclose(x, a + u * (b - a), atol=1e-9)


def spied_training(monkeypatch):
    """What is asked of every fit, as ``(name, settings)``; the fits themselves are cut to a round."""
    asked, train = [], stack.train

    def fit(df, name, features, label, size, overrides, seed, key, dealt=False):
        asked.append((name, models.settings(name, size, overrides)))
        less = {"numTrees": 2, "maxDepth": 3} if name == "rf" else {"maxIter": 1, "maxDepth": 2}
        return train(df, name, features, label, "small", less, seed, key, dealt)

    monkeypatch.setattr(stack, "train", fit)
    return asked


def assert_whole(asked):
    """Five folds and all rows for every base model, then both metas, none with a setting or a round less."""
    assert sorted(name for name, _ in asked) == sorted([*models.BASE_MODELS * 6, *models.META_MODELS])
    assert all(spec == models.FULL[name] for name, spec in asked)


def test_submission_is_scored_by_the_whole_training(spark, sf, monkeypatch):
    """all rounds of all models over five folds, also after a short training in the same session."""
    monkeypatch.setattr(modeling, "_FITTED", {})
    asked = spied_training(monkeypatch)
    short = modeling._state(spark, sf)
    asked.clear()
    assert modeling.score_submission(spark, sf).count() == 1000
    assert_whole(asked)
    assert modeling._state(spark, sf) is short and len(modeling._FITTED) == 2


def test_boosting_has_a_folder_to_cut_its_lineage(learnable, monkeypatch):
    """without one some hundred rounds overflow the stack."""
    asked, ask = [], models.checkpoint_dir
    monkeypatch.setattr(models, "checkpoint_dir", lambda spark: asked.append(ask(spark)) or asked[-1])
    models.train(learnable, "xgb", FEATURES, size="small", overrides={"maxIter": 1})
    assert len(asked) == 1 and learnable.sparkSession.sparkContext.getCheckpointDir()


def test_short_passes_leave_room_for_more_fits(spark):
    cores = spark.sparkContext.defaultParallelism
    assert fits_at_once(spark, tasks_of_a_pass(spark, 1_000, 3)) == 3 * cores
    assert fits_at_once(spark, tasks_of_a_pass(spark, 10_000_000, 3)) == 4


def test_comparison_is_of_the_whole_training(spark, sf, monkeypatch):
    """F2"""
    asked = spied_training(monkeypatch)
    assert modeling.stack_comparison(spark, sf).count() == 7
    assert_whole(asked)


def test_train_job_trains_in_whole(spark, sf, monkeypatch):
    """F3"""
    asked = spied_training(monkeypatch)
    assert modeling.train_everything(spark, sf).count() == 7
    assert_whole(asked)
