"""Out-of-fold scores and hyperparameter search over a fold column."""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerscope.models.boosting import bin_rows, families, grown_scores, held_out_scores, plan_of
from buyerscope.models.knn import knn_readings
from buyerscope.models.learners import LINEAR, TREES, Learner, PopulationScaler, probability
from buyerscope.models.linear import Model, held_out_linear, linear_plan, linear_rows
from buyerscope.operators.metrics import rank_metrics
from buyerscope.operators.neighbours import nearest_neighbours
from buyerscope.storage import write_once

Resample = Callable[[DataFrame], DataFrame]
# Fits that run side by side; each is itself a distributed job.
PARALLELISM = 4


def score_with(model: PipelineModel, name: str, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., model, p) of a fitted learner."""
    return model.transform(df).select(*keep, F.lit(name).alias("model"), probability(name).alias("p"))


def in_parallel(tasks: Sequence[Callable[[], Any]], parallelism: int = PARALLELISM) -> list[Any]:
    """Run driver-side fits side by side."""
    if parallelism <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    # A thread of such tasks has no active session until it needs one, and may itself run tasks side by side.
    inherit = inheritable_thread_target(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
    spark_tasks = [inherit(t) for t in tasks]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(lambda t: t(), spark_tasks)


def fold_numbers(df: DataFrame, fold: str = "fold") -> list[int]:
    return sorted(r[0] for r in df.select(fold).distinct().collect())


def out_of_fold(
    df: DataFrame,
    learners: Sequence[Learner],
    key: str = "key",
    label: str = "label",
    fold: str = "fold",
    resample: Resample | None = None,
    parallelism: int = PARALLELISM,
) -> DataFrame:
    """(key, label, fold, model, p): every row scored by models that have not seen its fold.

    Tree models of all learners and folds grow in one job, and so do linear models. ``resample`` is applied to the training part only, once per fold. The scores are written once, so that all
    later searches read a table instead of refitting.
    """

    if not resample:
        together, learners = _side_by_side(df, learners, key, label, fold)
        if not learners:
            return write_once(reduce(DataFrame.unionByName, together), "out_of_fold")
    else:
        together = []
    numbers = fold_numbers(df, fold)
    trains = {f: df.where(F.col(fold) != f) for f in numbers}
    if resample:
        # A fit makes many passes over its rows, and all learners of a fold read the same ones.
        grown = in_parallel([lambda f=f: write_once(resample(trains[f]), "resampled") for f in numbers], parallelism)
        trains = dict(zip(numbers, grown))

    def task(f: int, one: Learner) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            fitted = one.fit(trains[f])
            return score_with(fitted, one.opt("name"), df.where(F.col(fold) == f), [key, label, fold])

        return run

    tasks = [task(f, one) for f in numbers for one in learners]
    return write_once(reduce(DataFrame.unionByName, [*together, *in_parallel(tasks, parallelism)]), "out_of_fold")


def _side_by_side(
    df: DataFrame, learners: Sequence[Learner], key: str, label: str, fold: str
) -> tuple[list[DataFrame], list[Learner]]:
    """Out-of-fold scores of the learners whose fits share their passes over the rows, and the learners that are left."""
    groups: dict[tuple, list[Learner]] = {}
    for one in learners:
        fixed = json.loads(one.getOrDefault(one.options))
        kind = "trees" if fixed["kind"] in TREES else "linear" if fixed["kind"] in LINEAR else "other"
        same = (fixed["features"], fixed["label"], fixed["key"]) == (fixed["features"], label, key)
        groups.setdefault((kind if same else "other", fixed["features"]), []).append(one)
    parts, left = [], []
    for (kind, features), some in groups.items():
        options = [json.loads(one.getOrDefault(one.options)) for one in some]
        if kind == "trees":
            plans = [plan_of(o["kind"], o["params"], o["seed"]) for o in options]
            table = bin_rows(df, features, label, key, fold)
            scores = held_out_scores(table, families(plans, sorted({f for f, _ in table.counts})))
        elif kind == "linear":
            rows = linear_rows(df, features, label, key, fold)
            models = [(Model(linear_plan(o["kind"], o["params"], o["seed"]), f), i) for i, o in enumerate(options) for f in sorted(rows.moments)]
            scores = held_out_linear(rows, [m for m, _ in models], [i for _, i in models])
        else:
            left += some
            continue
        names = F.array(*[F.lit(o["name"]) for o in options])
        parts.append(scores.select(
            F.col("key").alias(key), F.col("label").cast(df.schema[label].dataType).alias(label),
            F.col("fold").cast(df.schema[fold].dataType).alias(fold), F.get(names, F.col("candidate")).alias("model"), "p",
        ))
    return parts, left


def expand_grid(grid: dict[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """All combinations of the grid's values."""
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]


def draw_from_grid(grid: dict[str, Sequence[Any]], n: int, seed: int = 42) -> list[dict[str, Any]]:
    """``n`` different combinations of the grid, or all if there are fewer."""
    every = expand_grid(grid)
    return every if n >= len(every) else random.Random(seed).sample(every, n)


# Search spaces of the boosted-tree presets. Each entry is (kind, low, high), a list
# of choices, or a nested choice {value: further entries}.
SPACES: dict[str, dict[str, Any]] = {
    "lightgbm": {
        "n_estimators": ("int", 100, 1000),
        "learning_rate": ("log", 0.01, 0.3),
        "num_leaves": ("int", 20, 150),
        "max_depth": ("int", 3, 12),
        "min_child_samples": ("int", 5, 100),
        "subsample": ("float", 0.5, 1.0),
        "colsample_bytree": ("float", 0.5, 1.0),
        "reg_alpha": ("log", 1e-8, 10.0),
        "reg_lambda": ("log", 1e-8, 10.0),
        "class_weight": ["balanced"],
    },
    "xgboost": {
        "n_estimators": ("int", 100, 1000),
        "learning_rate": ("log", 0.01, 0.3),
        "max_depth": ("int", 3, 10),
        "min_child_weight": ("int", 1, 10),
        "gamma": ("log", 1e-8, 1.0),
        "subsample": ("float", 0.5, 1.0),
        "colsample_bytree": ("float", 0.5, 1.0),
        "reg_alpha": ("log", 1e-8, 10.0),
        "reg_lambda": ("log", 1e-8, 10.0),
        "scale_pos_weight": ["balanced"],
    },
    "catboost": {
        "iterations": ("int", 100, 1000),
        "learning_rate": ("log", 0.01, 0.3),
        "depth": ("int", 3, 10),
        "l2_leaf_reg": ("log", 1e-8, 10.0),
        "bootstrap_type": {
            "Bayesian": {"bagging_temperature": ("float", 0.0, 10.0)},
            "Bernoulli": {"subsample": ("float", 0.5, 1.0)},
            "MVS": {},
        },
        "auto_class_weights": ["Balanced"],
    },
}


def draw_from_space(space: dict[str, Any], n: int, seed: int = 42) -> list[dict[str, Any]]:
    """``n`` random points of a space with whole, real, log-uniform and conditional entries."""
    source = random.Random(seed)

    def point(entries: dict[str, Any]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for name, entry in entries.items():
            if isinstance(entry, dict):
                out[name] = source.choice(list(entry))
                out.update(point(entry[out[name]]))
            elif isinstance(entry, list):
                out[name] = source.choice(entry)
            elif entry[0] == "int":
                out[name] = source.randint(entry[1], entry[2])
            elif entry[0] == "log":
                out[name] = math.exp(source.uniform(math.log(entry[1]), math.log(entry[2])))
            else:
                out[name] = source.uniform(entry[1], entry[2])
        return out

    return [point(space) for _ in range(n)]


def tree_search_scores(
    df: DataFrame, base: Learner, candidates: Sequence[dict[str, Any]], fold: str = "fold"
) -> DataFrame:
    """(candidate, fold, key, label, p) of tree models: every row scored by every candidate's model of its fold, in one job for all fits."""
    fixed = json.loads(base.getOrDefault(base.options))
    plans = [plan_of(fixed["kind"], {**fixed["params"], **c}, fixed["seed"]) for c in candidates]
    table = bin_rows(df, fixed["features"], fixed["label"], fixed["key"], fold)
    return held_out_scores(table, families(plans, sorted({f for f, _ in table.counts})))


def linear_search_scores(
    df: DataFrame, base: Learner, candidates: Sequence[dict[str, Any]], fold: str = "fold"
) -> tuple[DataFrame, list[int]]:
    """The same for linear models, and the place of each candidate among them: candidates with one solution are one model."""
    fixed = json.loads(base.getOrDefault(base.options))
    plans = [linear_plan(fixed["kind"], {**fixed["params"], **c}, fixed["seed"]) for c in candidates]
    different = list(dict.fromkeys(plans))
    rows = linear_rows(df, fixed["features"], fixed["label"], fixed["key"], fold)
    models = [(Model(p, f), i) for i, p in enumerate(different) for f in sorted(rows.moments)]
    return held_out_linear(rows, [m for m, _ in models], [i for _, i in models]), [different.index(p) for p in plans]


def knn_search_scores(
    df: DataFrame, base: Learner, candidates: Sequence[dict[str, Any]], fold: str = "fold", parallelism: int = PARALLELISM
) -> DataFrame:
    """The same for k-NN models: one search per fold and metric, with the most neighbours that any candidate asks for."""
    fixed = json.loads(base.getOrDefault(base.options))
    key, label, features = fixed["key"], fixed["label"], fixed["features"]
    merged = [{"n_neighbors": 5, "weights": "uniform", "p": 2, **fixed["params"], **c} for c in candidates]
    unknown = {k for c in merged for k in c} - {"n_neighbors", "weights", "p"}
    if unknown:
        raise ValueError(f"knn has no parameters {sorted(unknown)}")
    metrics = {p: {i: (c["n_neighbors"], c["weights"]) for i, c in enumerate(merged) if c["p"] == p} for p in {c["p"] for c in merged}}

    def search(f: int) -> DataFrame:
        train = df.where(F.col(fold) != f)
        scaler = PopulationScaler(features=features, out="_scaled").fit(train)
        flat = scaler.transform(df).select(F.col(key).alias("id"), vector_to_array("_scaled").alias("v"), F.col(label).alias("label"), F.col(fold).alias("fold"))
        rows = write_once(flat, "knn_rows")
        known, asked = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        parts = []
        for p, readings in metrics.items():
            near = nearest_neighbours(asked.select("id", "v"), known.select("id", "v"), max(k for k, _ in readings.values()), p)
            pairs = near.join(known.select(F.col("id").alias("base_id"), "label"), "base_id")
            own = asked.select(F.col("id").alias("query_id"), "label", F.lit(f).alias("fold"))
            parts.append(knn_readings(pairs, readings, []).join(own, "query_id").select("candidate", "fold", "label", "p"))
        return write_once(reduce(DataFrame.unionByName, parts), "knn_scores")

    return reduce(DataFrame.unionByName, in_parallel([lambda f=f: search(f) for f in fold_numbers(df, fold)], parallelism))


def _mean_and_deviation(scores: DataFrame) -> dict[int, tuple[float, float]]:
    """Mean and deviation of the folds' areas per candidate of (candidate, fold, label, p)."""
    found = rank_metrics(scores, ["candidate", "fold"]).groupBy("candidate").agg(
        F.avg("roc_auc").alias("mean"), F.stddev_pop("roc_auc").alias("std")
    )
    return {r["candidate"]: (r["mean"], r["std"]) for r in found.collect()}  # one row per candidate


CANDIDATES = "candidate int, params string, mean_auc double, std_auc double"


def cross_validated_search(
    df: DataFrame,
    base: Learner,
    candidates: Sequence[dict[str, Any]],
    fold: str = "fold",
    parallelism: int = PARALLELISM,
) -> tuple[PipelineModel, dict[str, Any], DataFrame]:
    """(best model refitted on all rows, its parameters, table of candidates).

    The table holds (candidate, params as JSON, mean and deviation of the folds' exact AUC). Tree and linear models of all candidates
    and folds are fitted side by side in one job; candidates that come to one model are fitted once and all listed.
    """
    fixed = json.loads(base.getOrDefault(base.options))
    merged = [{**fixed["params"], **c} for c in candidates]
    if fixed["kind"] in TREES:
        areas = _mean_and_deviation(write_once(tree_search_scores(df, base, candidates, fold), "search_scores"))
    elif fixed["kind"] in LINEAR:
        scores, place = linear_search_scores(df, base, candidates, fold)
        found = _mean_and_deviation(write_once(scores, "search_scores"))
        areas = {i: found[p] for i, p in enumerate(place)}
    elif fixed["kind"] == "knn":
        areas = _mean_and_deviation(knn_search_scores(df, base, candidates, fold, parallelism))
    else:
        areas = _search_by_fits(df, base, merged, fold, parallelism)
    rows = [(i, json.dumps(c, sort_keys=True), *areas[i]) for i, c in enumerate(candidates)]
    best = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
    table = df.sparkSession.createDataFrame(rows, CANDIDATES)
    model = base.copy({base.options: json.dumps({**fixed, "params": merged[best]})}).fit(df)
    return model, dict(candidates[best]), table


def _search_by_fits(
    df: DataFrame, base: Learner, merged: Sequence[dict[str, Any]], fold: str, parallelism: int
) -> dict[int, tuple[float, float]]:
    """Mean and deviation of the folds' areas per candidate, with one fit per model and fold."""
    fixed = json.loads(base.getOrDefault(base.options))
    marks = [json.dumps(c, sort_keys=True) for c in merged]
    place = {mark: i for i, mark in enumerate(dict.fromkeys(marks))}
    models = [Learner(**{**fixed, "params": merged[marks.index(mark)], "name": f"m{i}"}) for mark, i in place.items()]
    scores = out_of_fold(df, models, fixed["key"], fixed["label"], fold, parallelism=parallelism)
    numbered = scores.select(F.expr("cast(substr(model, 2) as int)").alias("candidate"), F.col(fold).alias("fold"),
                             F.col(fixed["label"]).alias("label"), "p")
    areas = _mean_and_deviation(numbered)
    return {i: areas[place[mark]] for i, mark in enumerate(marks)}


def halving_search(
    df: DataFrame,
    base: Learner,
    candidates: Sequence[dict[str, Any]],
    fold: str = "fold",
    shares: Sequence[float] = (1 / 9, 1 / 3, 1.0),
    keep: int = 3,
) -> tuple[PipelineModel, dict[str, Any], DataFrame]:
    """Adaptive search over boosted trees: (best model refitted on all rows, its parameters, table of candidates).

    All candidates boost for the first share of their rounds, the best one in ``keep`` goes on to the next share, and so forth to the whole;
    the candidates of a rung grow in one job, on the same bins, and go on from the trees that they have (a table too large for one task begins anew). The table tells for each candidate the last rung it took part in and its areas there:
    (candidate, params, rung, rounds, mean_auc, std_auc). Ties go to the earlier candidate.
    """
    fixed = json.loads(base.getOrDefault(base.options))
    name = "iterations" if "iterations" in candidates[0] else "n_estimators"
    rounds = [plan_of(fixed["kind"], {**fixed["params"], **c}).rounds for c in candidates]
    alive, rows = list(range(len(candidates))), {}
    binned, grown = bin_rows(df, fixed["features"], fixed["label"], fixed["key"], fold), None
    for rung, share in enumerate(shares):
        some = [{**candidates[i], name: max(1, math.ceil(rounds[i] * share))} for i in alive]
        plans = [plan_of(fixed["kind"], {**fixed["params"], **c}, fixed["seed"]) for c in some]
        trials = families(plans, sorted({f for f, _ in binned.counts}))
        if binned.fits() and plans[0].boosted:
            scores = write_once(grown_scores(binned, trials, grown), "search_scores")
            grown, scores = (scores.where("packed is not null").select("place", "packed"), trials), scores.where("packed is null")
        else:
            scores = write_once(held_out_scores(binned, trials), "search_scores")
        areas = _mean_and_deviation(scores)
        for place, i in enumerate(alive):
            rows[i] = (i, json.dumps(candidates[i], sort_keys=True), rung, some[place][name], *areas[place])
        if rung + 1 < len(shares):
            alive = sorted(sorted(alive, key=lambda i: (-rows[i][4], i))[: math.ceil(len(alive) / keep)])
    best = max(alive, key=lambda i: (rows[i][4], -i))
    table = df.sparkSession.createDataFrame([rows[i] for i in sorted(rows)], "candidate int, params string, rung int, rounds int, mean_auc double, std_auc double")
    model = base.copy({base.options: json.dumps({**fixed, "params": {**fixed["params"], **candidates[best]}})}).fit(df)
    return model, dict(candidates[best]), table
