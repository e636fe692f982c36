from multiprocessing.pool import ThreadPool
from threading import Barrier

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from buyerscope.models import stacking, validation
from buyerscope.models.learners import AtThreshold, FourierFeatures, Learner, PopulationScaler, learner
from buyerscope.models.selection import (
    importance_table, linear_attribution, permutation_importance, recursive_elimination, top_features,
)
from buyerscope.models.stacking import fit_stack, fit_vote, join_vote, meta_learner, stack_out_of_fold
from buyerscope.models.validation import (
    SPACES, cross_validated_search, draw_from_grid, draw_from_space, expand_grid, out_of_fold, score_with,
)
from buyerscope.operators import metrics as M
from buyerscope.operators.splits import stratified_folds
from buyerscope.plans import jobs
from buyerscope.plans.jobs import balanced
from buyerscope.storage import write_once

NAMES = ["signal", "weak", "noise", "constant"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    n = 240
    x = rng.normal(size=(n, 3))
    label = (2 * x[:, 0] + 0.5 * x[:, 1] + 0.5 * rng.normal(size=n) > 0.4).astype(float)
    pdf = pd.DataFrame({"key": range(n), "label": label, "a": list(np.c_[x * [1, 10, 1] + [0, 50, 0], np.ones(n)])})
    df = spark.createDataFrame(pdf).withColumn("features", array_to_vector("a")).drop("a")
    return write_once(stratified_folds(df, "key", "label", k=3), "test_models")


@pytest.mark.parametrize(
    "kind, params",
    [
        ("logistic_regression", {"class_weight": "balanced", "C": 10.0}),
        ("random_forest", {"n_estimators": 10, "max_depth": 4}),
        ("gradient_boosting", {"n_estimators": 5, "max_depth": 2, "subsample": 0.8}),
        ("xgboost", {"n_estimators": 5, "max_depth": 2, "scale_pos_weight": "balanced", "colsample_bytree": 0.8}),
        ("lightgbm", {"n_estimators": 5, "max_depth": -1, "class_weight": "balanced"}),
        ("catboost", {"iterations": 5, "depth": 2, "auto_class_weights": "Balanced"}),
        ("svm", {"kernel": "linear"}),
        ("svm", {"kernel": "rbf", "gamma": "auto", "dims": 64}),
        ("knn", {"n_neighbors": 7, "weights": "distance", "p": 1}),
        ("decision_tree", {"max_depth": 3, "criterion": "entropy", "min_samples_split": 5}),
        ("mlp", {"hidden": [4], "max_iter": 60}),
    ],
)
def test_learners_find_the_signal_and_survive_saving(data, tmp_path, kind, params):
    train, test = data.where("fold <> 0"), data.where("fold = 0")
    model = learner(kind, "m", **params).fit(train)
    scored = score_with(model, "m", test, ["key", "label"])
    assert M.roc_auc(scored).first()[0] > 0.8
    model.write().save(str(tmp_path / "m"))
    back = score_with(PipelineModel.load(str(tmp_path / "m")), "m", test, ["key", "label"])
    a, b = ({r["key"]: r["p"] for r in s.collect()} for s in (scored, back))
    assert a == pytest.approx(b) and all(0 <= v <= 1 for v in a.values())


def test_unknown_learner(data):
    with pytest.raises(ValueError, match="unknown learner"):
        learner("oracle").fit(data)


def test_population_scaler_matches_numpy(data):
    x = np.array([r[0].toArray() for r in data.select("features").collect()])
    model = PopulationScaler().fit(data)
    z = np.array([r[0].toArray() for r in model.transform(data).select("scaled").collect()])
    assert z[:, :3].std(axis=0) == pytest.approx(np.ones(3)) and (z[:, 3] == 0).all()
    assert np.allclose(z[:, 1], (x[:, 1] - x[:, 1].mean()) / x[:, 1].std())


def test_cosine_features_approximate_the_kernel(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 0.2)], "a double, b double").select(array_to_vector(F.array("a", "b")).alias("scaled"))
    lift = FourierFeatures(gamma=0.7, size=2, dims=8000)
    a, b = (r[0].toArray() for r in lift.transform(df).select("lifted").collect())
    assert a @ b == pytest.approx(np.exp(-0.7 * (0.25 + 0.04)), abs=0.03)


def test_out_of_fold_scores_every_row_once(data):
    scored = out_of_fold(data, [learner("logistic_regression", "a"), learner("decision_tree", "b", max_depth=2)])
    assert scored.count() == 480 and scored.select("key", "model").distinct().count() == 480
    assert M.cv_metrics(scored.where("model = 'a'")).first()["cv_roc_auc"] > 0.9


def test_out_of_fold_does_not_leak(spark):
    # Labels are noise: a model that saw its own rows would do well on them.
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"key": range(300), "label": rng.integers(0, 2, 300) * 1.0, "a": list(rng.normal(size=(300, 2)))})
    df = stratified_folds(spark.createDataFrame(pdf).withColumn("features", array_to_vector("a")), "key", "label", k=3)
    scored = out_of_fold(write_once(df, "noise"), [learner("decision_tree", "t", max_depth=8)])
    assert abs(M.roc_auc(scored).first()[0] - 0.5) < 0.12


def test_oversampled_folds(data):
    rare = data.where("label = 0 or key % 4 = 0")
    grown = balanced(rare)
    sizes = {r["label"]: r["count"] for r in grown.groupBy("label").count().collect()}
    assert sizes[0.0] == sizes[1.0] and grown.select("key").distinct().count() == grown.count()
    scored = out_of_fold(write_once(rare, "rare"), [learner("logistic_regression")], resample=balanced)
    assert M.score_spread(M.fold_scores(scored)).first()["mean"] > 0.9


def test_grids_and_spaces():
    assert len(expand_grid({"a": [1, 2], "b": [3, 4, 5]})) == 6
    assert len(draw_from_grid({"a": [1, 2], "b": [3, 4, 5]}, 4)) == 4
    assert draw_from_grid({"a": [1, 2]}, 9) == [{"a": 1}, {"a": 2}]
    for space in SPACES.values():
        points = draw_from_space(space, 20, seed=3)
        assert points == draw_from_space(space, 20, seed=3)
        assert all(0.01 <= p["learning_rate"] <= 0.3 for p in points)
    kinds = {p["bootstrap_type"]: set(p) for p in draw_from_space(SPACES["catboost"], 30)}
    assert "bagging_temperature" in kinds["Bayesian"] and "subsample" in kinds["Bernoulli"]
    assert not {"subsample", "bagging_temperature"} & kinds["MVS"]


def test_benchmark_grid_has_its_full_size():
    from buyerscope.models.learners import GRIDS

    assert {k: len(expand_grid(g)) for k, g in GRIDS.items()} == {
        "logistic_regression": 16, "random_forest": 54, "gradient_boosting": 16, "xgboost": 32, "lightgbm": 48,
        "svm": 12, "knn": 16, "decision_tree": 36}


def test_search_picks_the_better_candidate(data):
    model, params, table = cross_validated_search(
        data, learner("decision_tree", "t"), [{"max_depth": 0}, {"max_depth": 4}])
    assert params == {"max_depth": 4} and table.count() == 2
    assert M.roc_auc(score_with(model, "t", data, ["key", "label"])).first()[0] > 0.9


def test_stack_and_vote(data, tmp_path):
    bases = [learner("logistic_regression", "lr"), learner("decision_tree", "dt", max_depth=3)]
    stack = fit_stack(data, bases, meta_learner())
    assert M.roc_auc(score_with(stack, "stack", data, ["key", "label"])).first()[0] > 0.9
    vote = join_vote([stack], ["stack", "lr", "dt"], [0.6, 0.2, 0.2])
    row = vote.transform(data).select(*[F.expr(c) for c in ("prob_vote", "prob_stack", "prob_lr", "prob_dt")]).first()
    want = 0.6 * row[1][1] + 0.2 * row[2][1] + 0.2 * row[3][1]
    assert row[0][1] == pytest.approx(want)
    whole = PipelineModel([vote, AtThreshold(name="vote", threshold=0.4)])
    whole.write().save(str(tmp_path / "v"))
    back = PipelineModel.load(str(tmp_path / "v")).transform(data).select("score", "prediction").first()
    assert back["prediction"] == int(back["score"] >= 0.4)
    nested = stack_out_of_fold(data, bases, meta_learner(), inner_folds=2)
    assert nested.count() == 240 and M.cv_metrics(nested).first()["cv_roc_auc"] > 0.9
    equal = fit_vote(data, bases)
    assert M.roc_auc(score_with(equal, "vote", data, ["key", "label"])).first()[0] > 0.9


def test_importance_and_selection(spark, data):
    forest = learner("random_forest", n_estimators=10, max_depth=4).fit(data)
    table = importance_table(forest, NAMES, spark)
    assert top_features(table, 1) == ["signal"]
    linear = learner("logistic_regression", "lr").fit(data)
    assert [r["Feature"] for r in linear_attribution(linear, data, NAMES).collect()][0] == "signal"
    assert importance_table(linear, NAMES, spark).first()["Feature"] == "signal"
    shuffled = permutation_importance(linear, "lr", data, NAMES, repeats=3).collect()
    assert shuffled[0]["Feature"] == "signal" and shuffled[0]["Importance"] > 0.2
    assert {r["Feature"]: r["Importance"] for r in shuffled}["constant"] == pytest.approx(0)
    kept, sizes = recursive_elimination(data, learner("decision_tree", "t", max_depth=3), NAMES, min_features=1)
    assert "signal" in kept and {r["n_features"] for r in sizes.collect()} == {4, 3, 2, 1}


def test_candidates_that_are_one_model_are_fitted_once(data, monkeypatch):
    """Solvers that reach the same solution share a model; liblinear, which penalizes the intercept too, has its own."""
    counted = []
    grid = [{"C": c, "solver": s} for c in (0.1, 1.0) for s in ("lbfgs", "saga", "liblinear")]
    real = validation.held_out_linear
    monkeypatch.setattr(validation, "held_out_linear", lambda rows, models, names: counted.append(len(models)) or real(rows, models, names))
    _, params, table = cross_validated_search(data, learner("logistic_regression", "t"), grid)
    rows = {r["candidate"]: r["mean_auc"] for r in table.collect()}
    assert rows[0] == rows[1] and rows[3] == rows[4] and len(rows) == 6
    assert counted == [4 * 3] and rows[grid.index(params)] == max(rows.values())


def test_tasks_run_side_by_side_inside_a_thread_without_a_session(spark):
    inner = lambda i: validation.in_parallel([lambda j=j: spark.range(i + j + 1).count() for j in range(2)])
    with ThreadPool(1) as pool:
        assert pool.apply(lambda: validation.in_parallel([lambda i=i: inner(i) for i in range(2)])) == [[1, 2], [2, 3]]


def test_outer_folds_and_searches_run_side_by_side(spark, monkeypatch):
    """Each waits until the others have begun too."""
    rows = [(i, float(i % 2), i % 3, float(i)) for i in range(60)]
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame(rows, "key long, label double, fold int, a double"))
    own, together = stacking.fit_stack, Barrier(3)
    monkeypatch.setattr(stacking, "fit_stack", lambda *a, **k: together.wait(60) is None or own(*a, **k))
    bases = [learner("decision_tree", max_depth=2), learner("logistic_regression")]
    scored = stacking.stack_out_of_fold(df, bases, stacking.meta_learner(), inner_folds=2).collect()
    assert sorted((r["key"], r["fold"]) for r in scored) == [(i, i % 3) for i in range(60)]
    search, two = jobs.cross_validated_search, Barrier(2)
    monkeypatch.setattr(jobs, "cross_validated_search", lambda *a, **k: two.wait(60) is None or search(*a, **k))
    grids = {"decision_tree": {"max_depth": [1, 2]}, "logistic_regression": {"C": [1.0]}}
    found = jobs.benchmark(df.drop("fold"), grids=grids, folds=2)
    assert [r["error"] for r in found.table.collect()] == [None, None] and list(found.models) == list(found.searches) == list(grids)
