"""Trees and linear models: both ways of fitting agree, closed forms hold, every parameter counts, readings equal separate fits."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector

from buyerscope.models import boosting, linear, selection, trees
from buyerscope.models.boosting import Reading, Trial, plan_of
from buyerscope.models.learners import GRIDS, LINEAR, TREES, learner
from buyerscope.models.linear import Model, linear_plan
from buyerscope.models.validation import SPACES, cross_validated_search, draw_from_space, expand_grid, halving_search, out_of_fold
from buyerscope.plans import identities
from buyerscope.storage import write_once

D = 7


def rows(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, D))
    x[:, 4] = x[:, 4] > 0.6
    x[:, 5] = rng.integers(0, 4, n)
    x[:, 6] = 1.0
    y = (x[:, 0] + x[:, 1] * x[:, 2] + x[:, 4] + 0.7 * rng.normal(size=n) > 0.5).astype(float)
    return x, y, np.arange(n) % 3


@pytest.fixture(scope="module")
def frame(spark):
    x, y, fold = rows()
    pdf = pd.DataFrame({"key": range(len(y)), "label": y, "fold": fold, "a": list(x)})
    df = spark.createDataFrame(pdf).withColumn("features", array_to_vector("a")).drop("a")
    return write_once(df.repartition(4), "trees_linear")


@pytest.fixture(scope="module")
def binned(frame):
    return boosting.bin_rows(frame, fold="fold")


@pytest.fixture(scope="module")
def block(binned):
    return boosting._block(binned.rows.toArrow().to_batches(), len(binned.bins.edges))


def same(a, b):
    return len(a.trees) == len(b.trees) and all(
        (getattr(s, f) == getattr(t, f)).all() for s, t in zip(a.trees, b.trees, strict=True) for f in trees.Tree.FIELDS
    )


SMALL = [
    ("gradient_boosting", {"n_estimators": 3, "subsample": 0.8}),
    ("xgboost", {"n_estimators": 2, "max_depth": 3, "scale_pos_weight": "balanced", "gamma": 0.1, "reg_alpha": 0.2}),
    ("lightgbm", {"n_estimators": 2, "num_leaves": 6, "colsample_bytree": 0.6, "class_weight": "balanced"}),
    ("catboost", {"iterations": 2, "depth": 3}),
    ("catboost", {"iterations": 2, "depth": 3, "bootstrap_type": "Bayesian", "bagging_temperature": 0.5}),
    ("random_forest", {"n_estimators": 3, "max_depth": 5, "class_weight": "balanced_subsample"}),
    ("decision_tree", {"criterion": "entropy", "max_depth": 4}),
]


def test_a_table_that_stays_in_place_grows_the_same_trees(binned, monkeypatch):
    """One task per ensemble, or one job per level over many tasks: node by node the same."""
    trials = [Trial(plan_of(k, p), f) for k, p in SMALL for f in (boosting.NO_FOLD, 1)]
    whole = boosting.fit_ensembles(binned, trials)
    monkeypatch.setattr(boosting, "NODES", 3)
    levels = boosting.fit_ensembles(binned, trials, block_rows=10)
    assert all(same(a, b) for a, b in zip(whole, levels, strict=True))


def test_scores_of_both_ways_are_the_same(binned):
    trials = [Trial(plan_of(k, p), f, (Reading(i, plan_of(k, p).rounds),)) for i, (k, p) in enumerate(SMALL[:2]) for f in (0, 1, 2)]
    a, b = (sorted(map(tuple, boosting.held_out_scores(binned, trials, n).collect())) for n in (None, 10))
    assert a == b and len(a) == 2 * 300


def brute_tree(x, g, h, depth, l1, l2, gamma, least):
    """Nodes of one second-order tree in order of depth: (feature, gain, leaf weight), by plain loops over all cuts."""
    soft = lambda v: np.sign(v) * max(abs(v) - l1, 0.0)
    worth = lambda on: soft(g[on].sum()) ** 2 / (h[on].sum() + l2)
    out, level = [], [np.ones(len(g), dtype=bool)]
    for d in range(depth + 1):
        following = []
        for on in level:
            best = (0.0, None, None)
            for j in range(x.shape[1]) if d < depth else ():
                for cut in np.unique(x[on, j])[:-1]:
                    left = on & (x[:, j] <= cut)
                    right = on & ~left
                    if h[left].sum() >= least and h[right].sum() >= least:
                        gain = worth(left) + worth(right) - worth(on)
                        if gain > best[0] + 1e-9 and gain / 2 > gamma:
                            best = (gain, j, left)
            out.append((best[1], best[0], -soft(g[on].sum()) / (h[on].sum() + l2)))
            if best[1] is not None:
                following += [best[2], on & ~best[2]]
        level = following
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
@pytest.mark.parametrize("l1, l2, gamma, least", [(0.0, 1.0, 0.0, 1.0), (2.0, 0.5, 0.5, 4.0), (0.0, 0.0, 3.0, 0.0)])
def test_a_boosted_tree_equals_plain_loops(binned, block, depth, l1, l2, gamma, least):
    plan = plan_of("xgboost", {"n_estimators": 1, "max_depth": depth, "reg_alpha": l1, "reg_lambda": l2, "gamma": gamma, "min_child_weight": least, "learning_rate": 1.0})
    (tree,) = boosting.grow(binned.bins, block, plan, (1.0, 1.0), 0.0).trees
    want = brute_tree(block.bins.astype(int), 0.5 - block.label, np.full(len(block.label), 0.25), depth, l1, l2, gamma, least)
    got = [(int(f) if f >= 0 else None, gain, value) for f, gain, value in zip(tree.feature, tree.gain, tree.value, strict=True)]
    assert [f for f, _, _ in got] == [f for f, _, _ in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want])


def test_a_decision_tree_leaves_hold_class_shares(binned, block):
    for criterion in ("gini", "entropy"):
        plan = plan_of("decision_tree", {"criterion": criterion, "min_samples_split": 20})
        (tree,) = boosting.grow(binned.bins, block, plan, (1.0, 1.0), 0.0).trees
        at = tree.places(block.bins)
        for node in np.unique(at):
            assert tree.value[node] == pytest.approx(block.label[at == node].mean()) and tree.rows[node] == (at == node).sum()
        assert all(tree.rows[tree.feature >= 0] >= 20)


def test_best_first_takes_the_highest_gains(binned, block):
    def total(leaves):
        (tree,) = boosting.grow(binned.bins, block, plan_of("lightgbm", {"n_estimators": 1, "num_leaves": leaves, "min_child_samples": 5}), (1.0, 1.0), 0.0).trees
        assert (tree.feature < 0).sum() <= leaves
        return sorted(tree.gain[tree.feature >= 0], reverse=True)

    small, large = total(4), total(9)
    assert len(small) == 3 and len(large) == 8 and set(small) <= set(large)


def test_oblivious_trees_share_one_split_per_level(binned, block):
    (tree,) = boosting.grow(binned.bins, block, plan_of("catboost", {"iterations": 1, "depth": 4, "bootstrap_type": "No"}), (1.0, 1.0), 0.0).trees
    for depth in range(4):
        level = (tree.depth == depth) & (tree.feature >= 0)
        assert len({(f, c) for f, c in zip(tree.feature[level], tree.cut[level], strict=True)}) <= 1


def test_smaller_ensembles_are_read_off_larger_ones(binned, block):
    """100 rounds as the start of 200, shallow forests and larger nodes as parts of deep ones."""
    for kind, large, small in [
        ("lightgbm", {"n_estimators": 12}, [{"n_estimators": 5}]),
        ("random_forest", {"n_estimators": 6}, [{"n_estimators": 3, "max_depth": 3}, {"n_estimators": 6, "min_samples_split": 30}, {"n_estimators": 2}]),
        ("decision_tree", {}, [{"max_depth": 2}, {"min_samples_split": 40, "max_depth": 5}]),
    ]:
        plans = [plan_of(kind, p) for p in [large, *small]]
        (trial,) = boosting.families(plans, [boosting.NO_FOLD])
        whole = boosting.grow(binned.bins, block, trial.plan, (1.0, 1.0), 0.0)
        found = boosting.read_off(whole, block.bins, trial.readings)
        for i, plan in enumerate(plans):
            assert np.allclose(found[i], boosting.grow(binned.bins, block, plan, (1.0, 1.0), 0.0).probabilities(block.bins))


def test_a_packed_ensemble_comes_back(binned, block):
    whole = boosting.grow(binned.bins, block, plan_of("lightgbm", {"n_estimators": 3}), (1.0, 1.0), 0.1)
    back = trees.Ensemble.unpack(whole.pack())
    assert same(whole, back) and (back.probabilities(block.bins) == whole.probabilities(block.bins)).all()
    assert trees.Ensemble.unpack(trees.Ensemble(True, 0.3).pack()).probabilities(block.bins[:2]) == pytest.approx([trees.sigmoid(0.3)] * 2)


# Values that differ from the defaults enough to show in a model of a few trees.
CHANGED = {
    "n_estimators": 4, "iterations": 4, "learning_rate": 0.27, "num_leaves": 4, "max_depth": 2, "depth": 2, "min_child_samples": 60,
    "subsample": 0.5, "colsample_bytree": 0.3, "reg_alpha": 5.0, "reg_lambda": 9.0, "class_weight": "balanced", "min_child_weight": 20,
    "gamma": 8.0, "scale_pos_weight": 3.0, "l2_leaf_reg": 40.0, "bootstrap_type": "Bernoulli", "auto_class_weights": "Balanced",
    "min_samples_split": 90, "criterion": "entropy", "bagging_temperature": 4.0,
}


def test_every_parameter_of_grids_and_spaces_counts(binned, block):
    def scores(kind, params):
        plan = plan_of(kind, params)
        table = boosting.Binned(binned.bins, None, {(0, 0): int((block.label == 0).sum()), (0, 1): int((block.label == 1).sum())})
        return boosting.grow(binned.bins, block, plan, table.classes(plan, -1), table.start(plan, -1)).probabilities(block.bins)

    for kind in TREES:
        names = set(GRIDS.get(kind, {})) | {k for k in SPACES.get(kind, {})}
        names |= {k for v in SPACES.get(kind, {}).get("bootstrap_type", {}).values() for k in v} if kind == "catboost" else set()
        rounds = "iterations" if kind == "catboost" else "n_estimators"
        for name in names:
            base = {"max_depth": 5} if kind == "decision_tree" else {rounds: 3}
            if name == "bagging_temperature":
                base["bootstrap_type"] = "Bayesian"
            if name == "subsample" and kind == "catboost":
                base["bootstrap_type"] = "Bernoulli"
            if name == "num_leaves":
                base["min_child_samples"] = 5
            assert not np.allclose(scores(kind, base), scores(kind, {**base, name: CHANGED[name]})), (kind, name)
        with pytest.raises(ValueError, match="no parameters"):
            plan_of(kind, {"unheard_of": 1})
    balanced, own = (scores("random_forest", {"n_estimators": 3, "class_weight": w}) for w in ("balanced", "balanced_subsample"))
    assert not np.allclose(balanced, own)
    with pytest.raises(ValueError):
        plan_of("catboost", {"bootstrap_type": "Bernoulli", "bagging_temperature": 1.0})


def test_mvs_threshold_draws_the_share(binned, block):
    plan = plan_of("catboost", {"iterations": 1, "subsample": 0.4})
    margin = np.linspace(-3, 3, len(block.label))
    cut = trees.mvs_threshold(trees.size_counts(block, margin, plan, (1.0, 1.0)), 0.4)
    p = trees.sigmoid(margin)
    chance = np.minimum(np.sqrt((p - block.label) ** 2 + 1e-6) / cut, 1.0)
    assert chance.mean() == pytest.approx(0.4, abs=0.02)


# --- linear models


def test_a_table_that_stays_in_place_fits_the_same_lines(frame):
    table = linear.linear_rows(frame, fold="fold")
    models = [Model(linear_plan("logistic_regression", {"C": 0.1, "solver": s, "class_weight": w}), 1) for s in ("liblinear", "saga") for w in (None, "balanced")]
    models += [Model(linear_plan("svm", {"kernel": k, "dims": 16}), f) for k in ("linear", "rbf") for f in (0, 2)]
    whole, steps = linear.fit_models(table, models), linear.fit_models(table, models, block_rows=10)
    for a, b in zip(whole, steps, strict=True):
        assert a.keys() == b.keys()
        assert all(np.allclose(a[k], b[k], atol=1e-8) for k in a)


def test_regression_equals_sparks_own(frame):
    model = learner("logistic_regression", "m", C=0.5).fit(frame)
    z = model.stages[0].transform(frame)
    own = LogisticRegression(featuresCol="scaled_m", labelCol="label", regParam=1 / (0.5 * 300), standardization=False, tol=1e-11, maxIter=500).fit(z)
    assert np.allclose(model.stages[-1].coefficients.toArray(), own.coefficients.toArray(), atol=1e-6)
    assert model.stages[-1].intercept == pytest.approx(own.intercept, abs=1e-6) and model.stages[-1].getRegParam() == pytest.approx(1 / 150)


def test_machine_is_near_the_least_hinge_loss(frame):
    table = linear.linear_rows(frame)
    plan = linear_plan("svm", {"kernel": "linear", "C": 1.0})
    (found,) = linear.fit_models(table, [Model(plan)])
    rows_ = table.table.toPandas()
    z, y = table.design(plan, -1)(np.stack(rows_["x"])), 2 * rows_["label"].to_numpy() - 1
    loss = lambda t: np.maximum(0, 1 - y * (z @ t)).sum() + 0.5 * (t[:-1] ** 2).sum()
    theta, rng = np.array(found["theta"]), np.random.default_rng(1)
    best = min(loss(theta + s * rng.normal(size=len(theta))) for s in (1e-3, 1e-2, 1e-1) for _ in range(500))
    assert loss(theta) < best * 1.01


def test_every_linear_parameter_counts():
    for kind in LINEAR:
        plans = {linear_plan(kind, c) for c in expand_grid(GRIDS[kind])}
        # A linear kernel has no gamma; all other combinations differ.
        assert len(plans) == (16 if kind == "logistic_regression" else 9)
        with pytest.raises(ValueError):
            linear_plan(kind, {"unheard_of": 1})
    with pytest.raises(ValueError):
        linear_plan("logistic_regression", {"penalty": "l1"})


# --- searches


@pytest.mark.parametrize("kind, grid", [
    ("lightgbm", [{"n_estimators": 3}, {"n_estimators": 6}, {"n_estimators": 6, "num_leaves": 3}]),
    ("logistic_regression", [{"C": 0.01}, {"C": 10.0}]), ("knn", [{"n_neighbors": 3}, {"n_neighbors": 5, "weights": "distance", "p": 1}]),
])
def test_a_search_equals_its_fits(frame, kind, grid):
    """Areas of a search with shared passes against one learner per candidate and fold."""
    from buyerscope.operators.metrics import roc_auc

    _, _, table = cross_validated_search(frame, learner(kind, "m"), grid)
    for r in table.collect():
        areas = []
        for f in range(3):
            model = learner(kind, "m", **grid[r["candidate"]]).fit(frame.where(f"fold <> {f}"))
            from buyerscope.models.validation import score_with

            areas.append(roc_auc(score_with(model, "m", frame.where(f"fold = {f}"), ["key", "label"])).first()[0])
        # Trees of one fold alone are cut at the quantiles of its own rows.
        assert r["mean_auc"] == pytest.approx(np.mean(areas), abs=0.05 if kind == "lightgbm" else 1e-9)
        assert r["std_auc"] == pytest.approx(np.std(areas), abs=0.05 if kind == "lightgbm" else 1e-9)


def test_halving_goes_on_with_the_best(frame):
    points = [{**p, "n_estimators": 9 + i} for i, p in enumerate(draw_from_space(SPACES["lightgbm"], 9))]
    model, params, table = halving_search(frame, learner("lightgbm", "m"), points)
    _, again, same_table = halving_search(frame, learner("lightgbm", "m"), points)
    rows_ = {r["candidate"]: r for r in table.collect()}
    assert again == params and {r["candidate"]: r for r in same_table.collect()} == rows_
    assert [sum(r["rung"] >= k for r in rows_.values()) for k in range(3)] == [9, 3, 1]
    for rung in (0, 1):
        gone = [r["mean_auc"] for r in rows_.values() if r["rung"] == rung]
        assert len(gone) == (6 if rung == 0 else 2)
    last = next(r for r in rows_.values() if r["rung"] == 2)
    assert params == points[last["candidate"]] and last["rounds"] == params["n_estimators"]
    _, _, full = cross_validated_search(frame, learner("lightgbm", "m"), points)
    areas = {r["candidate"]: r["mean_auc"] for r in full.collect()}
    assert areas[last["candidate"]] == pytest.approx(last["mean_auc"]) and areas[last["candidate"]] > max(areas.values()) - 0.05


def test_out_of_fold_scores_side_by_side_and_one_by_one_agree(frame):
    some = [learner("logistic_regression", "lr"), learner("decision_tree", "dt", max_depth=3), learner("svm", "sv", kernel="linear")]
    together = {(r["key"], r["model"]): r["p"] for r in out_of_fold(frame, some).collect()}
    alone = {(r["key"], r["model"]): r["p"] for r in out_of_fold(frame, some, resample=lambda df: df).collect()}
    assert together.keys() == alone.keys() and len(together) == 900
    linear_keys = [k for k in together if k[1] != "dt"]
    assert np.allclose([together[k] for k in linear_keys], [alone[k] for k in linear_keys], atol=1e-6)


def test_block_order_does_not_matter(binned, block):
    shuffled = block.take(np.random.default_rng(0).permutation(len(block.label)))
    assert isinstance(shuffled.key, pa.Array) or shuffled.key is not None
    for kind, params in SMALL:
        plan = plan_of(kind, params)
        assert same(boosting.grow(binned.bins, block, plan, (1.0, 2.0), 0.0), boosting.grow(binned.bins, shuffled, plan, (1.0, 2.0), 0.0))


@pytest.mark.parametrize("kind, params", [
    ("random_forest", {"n_estimators": 2}), ("random_forest", {"n_estimators": 2, "class_weight": "balanced_subsample", "criterion": "entropy", "min_samples_split": 5}),
    ("decision_tree", {}), ("xgboost", {"n_estimators": 2, "max_depth": 8, "colsample_bytree": 0.8, "reg_alpha": 0.1}),
    ("lightgbm", {"n_estimators": 2, "num_leaves": 40}), ("catboost", {"n_estimators": 2}), ("gradient_boosting", {"n_estimators": 2, "subsample": 0.8}),
])
def test_moving_rows_and_sparse_sums_give_the_trees_of_dense_sums(monkeypatch, kind, params):
    """Only the first look at a tree reads all rows: growing by rows equals growing by the sums of all nodes over all bins."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(3000, 6)), rng.integers(0, 3, size=(3000, 5))])
    bins = trees.Bins([sorted(set(np.quantile(c, np.linspace(0, 1, 65))))[:-1] for c in x.T])
    label = (rng.uniform(size=3000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    block = trees.Block(bins.cut(x), label, np.zeros(3000, dtype=int), rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    plan, classes = boosting.plan_of(kind, params), (0.7, 1.6)
    margin = np.zeros(3000)
    monkeypatch.setattr(trees, "_KEPT", 64)
    grown = boosting.grow(bins, block, plan, classes, 0.0)
    for number in range(plan.rounds):
        cut = trees.mvs_threshold(trees.size_counts(block, margin, plan, classes), plan.row_share) if plan.bootstrap == "mvs" else None
        sample, tree = trees.gradients(block, margin, plan, number, classes, cut), trees.Growth(plan, number, 11, classes)
        while not tree.done:
            sums = trees.node_sums(bins, block, sample, tree.partial().places(block.bins), tree.wanted, tree.features)
            tree.take(trees.best_splits(bins, sums, [tree.path[n] for n in tree.wanted], plan, tree.classes, tree.features, number))
        for name in trees.Tree.FIELDS:
            np.testing.assert_array_equal(getattr(grown.trees[number], name), getattr(tree.finish(), name))
        margin = margin + (grown.trees[number].scores(block.bins) if plan.boosted else 0.0)
    if not plan.boosted and plan.rounds > 1:
        (part,) = boosting.grow(bins, block, plan, classes, 0.0, range(1, 2)).trees
        np.testing.assert_array_equal(part.feature, grown.trees[1].feature)


def test_slopes_are_summed_by_task_and_not_by_cell():
    """One row per candidate and column leaves a task, whatever its rows; an empty task sends none."""
    rng = np.random.default_rng(9)
    x, y, thetas, weights = rng.normal(size=(500, 3)), rng.integers(0, 2, 500).astype(float), rng.normal(size=(2, 4)), np.array([[1.0, 1.0], [0.6, 1.7]])
    design = linear.Design(x.mean(axis=0), 1 / x.std(axis=0))
    batches = [pa.RecordBatch.from_arrays([pa.array(y[s]), pa.array(x[s].tolist())], names=["label", "x"]) for s in (slice(0, 120), slice(120, 120), slice(120, 500))]
    (found,) = identities._slopes(design, thetas, weights)(iter(batches))
    z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones(500)])
    want = [[sum((1 / (1 + np.exp(-z[r] @ t)) - y[r]) * w[int(y[r])] * z[r, j] for r in range(500)) for j in range(4)] for t, w in zip(thetas, weights, strict=True)]
    assert found.num_rows == 8 and np.allclose(np.array(found.column("s")).reshape(2, 4), want)
    assert not list(identities._slopes(design, thetas, weights)(iter(batches[1:2])))


def test_features_counted_together_give_the_sums_of_each(monkeypatch):
    """Features share cells of at most ``_CELLS`` combinations; sums by node and bin are those of one feature at a time."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(2000, 4)), rng.integers(0, 2, size=(2000, 9)), np.ones(2000)])
    bins = trees.Bins([sorted(set(np.quantile(c, np.linspace(0, 1, 65))))[:-1] for c in x.T])
    assert sorted(j for g in bins.groups for j in g) == list(range(14)) and len(bins.groups) <= 4
    assert all(np.prod(bins.sizes[g]) <= trees._CELLS for g in bins.groups)
    block = trees.Block(bins.cut(x), (x[:, 0] > 0).astype(float), np.zeros(2000, dtype=int), np.arange(2000).astype(np.uint64))
    at = rng.integers(0, 3, 2000)
    for kind, params in SMALL:
        sample = trees.gradients(block, rng.normal(size=2000), plan_of(kind, params), 0, (1.0, 1.0))
        found = []
        for dense in (1, 10**6):
            monkeypatch.setattr(trees, "_DENSE", dense)
            found.append(trees.node_sums(bins, block, sample, at, [1, 2], np.arange(14)))
        np.testing.assert_array_equal(*found)
        rows, g, _, n = sample
        first = bins.starts[5]
        want = [[w[(at[rows] == 2) & (block.bins[rows, 5] == b)].sum() for b in (0, 1)] for w in (g, n)]
        np.testing.assert_array_equal(found[0][[0, 2], 1, first : first + 2], want)


def test_nodes_at_the_depth_limit_are_known_from_their_parents(binned, block):
    plan = plan_of("gradient_boosting", {"max_depth": 2})
    tree, passes = trees.Growth(plan, 0, D, (1.0, 1.0)), 0
    sample = trees.gradients(block, np.zeros(len(block.label)), plan, 0, (1.0, 1.0))
    while not tree.done:
        sums = trees.node_sums(binned.bins, block, sample, tree.partial().places(block.bins), tree.wanted, tree.features)
        tree.take(trees.best_splits(binned.bins, sums, [tree.path[n] for n in tree.wanted], plan, tree.classes, tree.features, 0))
        passes += 1
    assert passes == 2 and len(tree.finish().feature) == 7


def test_margins_of_a_table_in_place_are_not_written_every_round(binned, monkeypatch):
    written = []
    monkeypatch.setattr(boosting, "write_once", lambda df, name: written.append(name) or write_once(df, name))
    monkeypatch.setattr(boosting, "PENDING", 3)
    trial = Trial(plan_of("gradient_boosting", {"n_estimators": 7, "max_depth": 2}))
    (level,) = boosting.fit_ensembles(binned, [trial], block_rows=10)
    assert written == ["packed", "margins", "margins"]
    assert same(level, boosting.fit_ensembles(binned, [trial])[0])


def test_elimination_and_permutation_of_trees_equal_those_of_any_learner(frame, monkeypatch):
    """Rows are binned once for all steps, and swapped rows are scored without copies; results are those of separate fits and scorings."""
    names, base, calls = [f"f{i}" for i in range(D)], learner("decision_tree", "m", max_depth=3), []
    monkeypatch.setattr(selection, "bin_rows", lambda *a: calls.append(a) or boosting.bin_rows(*a))

    def both():
        kept, table = selection.recursive_elimination(frame, base, names, min_features=4)
        model = base.fit(frame)
        return kept, table.collect(), selection.permutation_importance(model, "m", frame, names, repeats=2).collect()

    monkeypatch.setattr(selection, "slice_features", None)
    found = both()
    monkeypatch.undo()
    assert len(calls) == 1
    monkeypatch.setattr(selection, "_tree_steps", lambda *a: None)
    monkeypatch.setattr(selection, "TreesModel", int)
    assert found == both()


def test_forests_are_dealt_by_their_trees_and_their_scores_stay(binned, monkeypatch):
    plans = [plan_of("random_forest", {"n_estimators": 9, **p}) for p in ({}, {"max_depth": 3}, {"class_weight": "balanced_subsample"})]
    trials = [*boosting.families(plans, [0, 1, 2]), Trial(plan_of("decision_tree", {"max_depth": 3}), 1, (Reading(3, 1),))]
    dealt = []
    own = boosting._each_trial
    monkeypatch.setattr(boosting, "_each_trial", lambda table, some, use, schema, parts=None: dealt.append(len(parts or some)) or own(table, some, use, schema, parts))
    by_trees = sorted(map(tuple, boosting.held_out_scores(binned, trials).collect()))
    assert max(dealt) > len(trials)  # more tasks than forests
    monkeypatch.setattr(boosting, "TREES", 100)
    assert by_trees == sorted(map(tuple, boosting.held_out_scores(binned, trials).collect()))


def test_trees_of_a_forest_grow_from_counted_rows(block, binned, monkeypatch):
    """Rows drawn a few times are counted along with their bins; other weights take the general way to the same tree."""
    plan = plan_of("random_forest", {"class_weight": "balanced_subsample", "max_depth": 6, "min_samples_leaf": 2})
    sample = trees.gradients(block, None, plan, 0, (1.0, 1.0))
    growth = lambda: trees.Growth(plan, 0, len(binned.bins.edges), (1.0, 1.0))
    general, scores = trees.grow_tree(binned.bins, block, (sample[0], *[w * 16.0 for w in sample[1:]]), growth())
    monkeypatch.setattr(trees, "sparse_splits", None)
    counted, own = trees.grow_tree(binned.bins, block, sample, growth())
    assert len(counted.feature) > 9 and not any(counted.gain[counted.feature < 0])
    rows = block.bins[sample[0]]
    np.testing.assert_array_equal(own, counted.scores(rows))
    assert counted.rows[0] == sample[3].sum() and general.rows[0] == 16 * counted.rows[0]


@pytest.mark.parametrize("kind, params", [("xgboost", {"reg_alpha": 0.5}), ("lightgbm", {"reg_lambda": 0.0}), ("random_forest", {}), ("decision_tree", {"class_weight": "balanced"})])
def test_values_of_many_leaves_are_those_of_each(kind, params):
    plan = plan_of(kind, params)
    n = np.random.default_rng(2).integers(0, 9, 50).astype(float)
    sums = np.stack([np.floor(n / 2), n, n], axis=1) * (trees.SCALE if plan.boosted else 1.0)
    found = trees.leaf_values(sums, plan, (0.7, 1.9))
    assert (n == 0).any() and found.tolist() == [trees.leaf_value(s, plan, (0.7, 1.9)) for s in sums]


def test_a_table_of_a_million_rows_is_dealt_whole(spark, monkeypatch):
    """140,000 rows stay one task's work, in packs; no job per level."""
    monkeypatch.setattr(boosting, "_grow_by_level", None)
    df = spark.range(140_000).selectExpr("id as key", "cast(id % 3 = 0 as double) as label", "array(cast(id % 3 as double), cast(id % 7 as double)) as a")
    df = df.withColumn("features", array_to_vector("a"))
    model = boosting.fit_trees(df, plan_of("random_forest", {"n_estimators": 4, "max_depth": 4}), "m")
    assert set(model.transform(df.limit(50)).selectExpr("pred_m = label").distinct().toPandas().iloc[:, 0]) == {True}
    assert "parts" in model.state()["ensemble"] and "gain" not in model.scoring()["ensemble"]["parts"][0]


def test_a_wide_table_is_not_dealt_whole(binned, monkeypatch):
    assert binned.fits() and not binned.fits(10)
    monkeypatch.setattr(boosting, "BLOCK_BYTES", D * 300 - 1)
    assert not binned.fits()


def test_packs_hold_the_rows_of_the_table(binned, block):
    for some, want in ((binned, block), (binned.only([4, 1]), None)):
        found = boosting._unpacked(some.packs().toArrow().to_batches(), len(some.bins.edges))
        np.testing.assert_array_equal(found.bins, block.bins if want else block.bins[:, [4, 1]])
        assert found.bins.flags.f_contiguous and found.key.equals(block.key)
        for name in ("label", "fold", "mark"):
            np.testing.assert_array_equal(getattr(found, name), getattr(block, name))
        part = found.take(np.array([5, 2, 2]))
        np.testing.assert_array_equal(part.by_row.reshape(3, -1), found.bins[[5, 2, 2]])


def test_rows_are_placed_by_number_and_in_either_layout(binned, block):
    (tree,) = boosting.grow(binned.bins, block, plan_of("random_forest", {"n_estimators": 1}), (1.0, 1.0), 0.0).trees
    some, columns = np.array([7, 3, 250]), np.asfortranarray(block.bins)
    for limits in ({}, {"depth": 2}, {"min_split": 20}):
        want = tree.places(np.ascontiguousarray(block.bins), **limits)
        np.testing.assert_array_equal(tree.places(columns, **limits), want)
        np.testing.assert_array_equal(tree.places(columns, some=some, **limits), want[some])


def test_boosting_goes_on_from_the_trees_that_are_there(binned, monkeypatch):
    """Longer ensembles that begin with the trees of shorter ones score as those grown at once, and only the new trees are grown."""
    kinds = [("lightgbm", {"num_leaves": 6, "subsample": 0.7}), ("catboost", {"depth": 3}), ("xgboost", {"max_depth": 3})]

    def trials(rounds, order):
        plans = [plan_of(kinds[i][0], {**kinds[i][1], "n_estimators": rounds + i}) for i in order]
        return boosting.families(plans, [0, 1, 2])

    short, whole = trials(2, [0, 1, 2]), trials(5, [2, 0])
    first = write_once(boosting.grown_scores(binned, short), "grown")
    assert first.where("packed is not null").count() == 9
    again = boosting.grown_scores(binned, whole, (first.where("packed is not null").select("place", "packed"), short)).toPandas()
    want = sorted(map(tuple, boosting.held_out_scores(binned, whole).collect()))
    rows = again[again.packed.isna()][["candidate", "fold", "key", "label", "p"]]
    assert sorted(map(tuple, rows.itertuples(index=False))) == want and len(want) == 600
    block, plan = boosting._unpacked(binned.packs().toArrow().to_batches(), D), whole[0].plan
    grown, asked = boosting.grow(binned.bins, block, plan, (1.0, 1.0), 0.0), []
    own = trees.grow_tree
    monkeypatch.setattr(trees, "grow_tree", lambda *a: asked.append(a) or own(*a))
    assert same(boosting.grow(binned.bins, block, plan, (1.0, 1.0), 0.0, known=grown.trees[:3]), grown) and len(asked) == plan.rounds - 3
