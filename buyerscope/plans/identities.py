"""What must hold for fitted models whatever their coefficients, as queries with exact answers.

SQL cannot fit the models, but it can say which rows a model has to score, in which fold, which candidates a search has to
list, and that a logistic regression has no slope left. Each query fits its models on the same tables as the query it belongs to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerscope.features.rfm import POWER_COLUMNS
from buyerscope.models.boosting import NO_FOLD
from buyerscope.models.learners import GRIDS, learner, probability
from buyerscope.models.linear import Design, Model, fit_models, linear_plan, linear_rows
from buyerscope.models.stacking import fit_vote
from buyerscope.models.trees import sigmoid
from buyerscope.models.validation import SPACES, draw_from_space, expand_grid, out_of_fold
from buyerscope.operators.transform import PowerTransform
from buyerscope.plans import catalog
from buyerscope.plans.oracles import md5_order, part, sql, yeo_johnson

# Queries of (key, label, model, p) over the held-out rows, with the model's name in them.
SCORED = {
    "lr": "logistic_regression", "rf": "random_forest", "gbt": "gradient_boosting", "xgb_preset": "xgboost", "dt": "decision_tree",
    "svc_linear": "svm", "svc_rbf": "svm", "knn_model": "knn", "mlp": "mlp", "stack": "stack", "stack_mlp": "stack", "model_vote": "vote",
}
# Queries of (ID, p, prediction) over all raw records.
DECIDED = ["score_batch", "subset_model", "final_train"]
TOLERANCE = 1e-3


def _is_share(p: str) -> Column:
    return F.coalesce(F.col(p).between(0.0, 1.0), F.lit(False))


def _counts() -> list[Column]:
    return [F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"), F.sum(_is_share("p").cast("long")).alias("n_valid")]


def scored(name: str) -> catalog.Query:
    """Held-out rows per class: all of them, each once, with a share as score."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return catalog.queries()[name](spark, folder).groupBy("model", "label").agg(*_counts())

    return run


def decided(name: str) -> catalog.Query:
    """Raw records scored, and whether one threshold parts the decisions."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = catalog.queries()[name](spark, folder).withColumnRenamed("ID", "key")
        no, yes = (F.when(F.col("prediction") == x, F.col("p")) for x in (0, 1))
        return rows.agg(*_counts(), F.coalesce(F.max(no) <= F.min(yes), F.lit(True)).alias("parted"))

    return run


def oof_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every training row is scored once per base model, in its own fold."""
    found = out_of_fold(catalog.training(spark, folder), catalog._bases())
    return found.groupBy("model", "fold", "label").agg(*_counts())


def stack_rows(name: str) -> catalog.Query:
    """Every customer is scored once by the whole stack, in its own fold."""
    return lambda spark, folder: catalog.queries()[name](spark, folder).groupBy("model", "fold", "label").agg(*_counts())


def vote_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose vote is the weighted mean of its members' scores."""
    weights = {"logistic_regression": 0.6, "decision_tree": 0.2, "random_forest": 0.2}
    model = fit_vote(catalog.training(spark, folder), catalog._bases(), list(weights.values()))
    rows = model.transform(catalog.held_out(spark, folder))
    mean = sum((F.lit(w) * probability(name) for name, w in weights.items()), F.lit(0.0))
    same = F.abs(probability("vote") - mean) < 1e-9
    return rows.groupBy("label").agg(F.sum(same.cast("long")).alias("n_equal"))


def lr_slope(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients, intercept included, at which the penalized loss of the regression still has a slope."""
    train = catalog.training(spark, folder)
    model = learner("logistic_regression", tol=1e-9, max_iter=1000).fit(train)
    last = model.stages[-1]
    weights, penalty = last.coefficients.toArray().tolist(), last.getRegParam()
    rest = probability("logistic_regression") - F.col("label")
    x = F.concat(vector_to_array(last.getFeaturesCol()), F.array(F.lit(1.0)))
    rows = model.transform(train).select(rest.alias("rest"), F.posexplode(x).alias("j", "x"))
    own = F.array(*[F.lit(penalty * w) for w in [*weights, 0.0]])
    slopes = rows.groupBy("j").agg(F.avg(F.col("rest") * F.col("x")).alias("mean")).select((F.col("mean") + F.get(own, F.col("j"))).alias("slope"))
    return slopes.agg(F.sum((F.abs("slope") > TOLERANCE).cast("long")).alias("n_sloped"))


def lr_grid_slopes(spark: SparkSession, folder: str) -> DataFrame:
    """The same for every candidate of the grid, all fitted side by side: (params, n_sloped)."""
    grid = expand_grid(GRIDS["logistic_regression"])
    rows = linear_rows(catalog.training(spark, folder))
    models = [Model(replace(linear_plan("logistic_regression", c), tol=1e-9)) for c in grid]
    fitted, design = fit_models(rows, models), rows.design(models[0].plan, NO_FOLD)
    weights = np.array([rows.classes(m.plan, NO_FOLD) for m in models])
    thetas = np.array([found["theta"] for found in fitted])
    sums = rows.table.select("label", "x").mapInArrow(_slopes(design, thetas, weights), "candidate int, j int, s double")
    own = [
        (i, j, json.dumps(c, sort_keys=True), float(t / m.plan.c) if j + 1 < thetas.shape[1] or m.plan.intercept_too else 0.0)
        for i, (c, m, found) in enumerate(zip(grid, models, thetas, strict=True)) for j, t in enumerate(found)
    ]
    named = spark.createDataFrame(own, "candidate int, j int, params string, own double")
    slopes = sums.groupBy("candidate", "j").agg(F.sum("s").alias("s")).join(F.broadcast(named), ["candidate", "j"])
    return slopes.groupBy("params").agg(F.sum((F.abs(F.col("s") + F.col("own")) > TOLERANCE).cast("long")).alias("n_sloped"))


def _slopes(design: Design, thetas: np.ndarray, weights: np.ndarray):
    """Sums over the rows of a task of (score less label) x weight x column, by candidate and column: one row each, however many rows there are."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(thetas.shape), False
        for batch in (b for b in batches if b.num_rows):
            label = batch.column("label").to_numpy()
            z = design(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            rest = (sigmoid(z @ thetas.T) - label[:, None]) * np.where(label[:, None] == 1, weights[:, 1], weights[:, 0])
            total, seen = total + rest.T @ z, True
        if seen:
            i, j = np.indices(total.shape, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["candidate", "j", "s"])

    return add_up


def tree_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of a decision tree whose score is not the share of class 1 among their training rows, and rows that no leaf has."""
    train = catalog.training(spark, folder)
    scored = learner("decision_tree", "t", max_depth=6).fit(train).transform(train).select("label", probability("t").alias("p"))
    leaves = scored.groupBy("p").agg(F.avg("label").alias("share"), F.count("*").alias("n"))
    wrong = (F.abs(F.col("p") - F.col("share")) > 1e-9).cast("long")
    return leaves.agg(F.sum(wrong).alias("n_wrong"), F.sum("n").alias("n_rows"))


def importance_total(spark: SparkSession, folder: str) -> DataFrame:
    """Importances are shares: they sum to 1, none is negative, and no feature is listed twice."""
    table = catalog.model_importance(spark, folder)
    return table.agg(
        F.round(F.sum("Importance"), 6).alias("total"), F.sum((F.col("Importance") < 0).cast("long")).alias("n_negative"),
        (F.count("*") - F.count_distinct("Feature")).alias("n_repeated"),
    )


def power_peak(spark: SparkSession, folder: str) -> DataFrame:
    """Most likely lambda of the power transform with its defaults, to three digits: (col, lam)."""
    found = PowerTransform(columns=["Income", "TotalSpend"]).fit(catalog.explored(spark, folder)).lambdas()
    return spark.createDataFrame([(c, round(lam, 3)) for c, lam in found.items()], "col string, lam double")


def power_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, mean and deviation of every power-transformed feature: (col, n, mean, std)."""
    table = catalog.feat_scaled(spark, folder).select(*[f"{c}_norm" for c in POWER_COLUMNS])
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("x")) for c in table.columns])
    rows = table.select(F.inline(cells)).groupBy("col")
    return rows.agg(F.count("x").alias("n"), (F.round(F.avg("x"), 6) + 0.0).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


def candidates(name: str) -> catalog.Query:
    """Candidates of a search, each once, with a share as mean score."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = catalog.queries()[name](spark, folder)
        return found.groupBy("params").agg(F.count("*").alias("n"), F.min(_is_share("mean_auc")).alias("sound"))

    return run


def queries() -> dict[str, catalog.Query]:
    return {
        **{f"{name}_rows": scored(name) for name in SCORED},
        **{f"{name}_rows": decided(name) for name in DECIDED},
        "oof_rows": oof_rows,
        "lean_stack_rows": stack_rows("lean_stack"),
        "raw_stack_rows": stack_rows("raw_stack"),
        "vote_mean": vote_mean,
        "lr_slope": lr_slope,
        "lr_grid_slopes": lr_grid_slopes,
        "tree_leaves": tree_leaves,
        "importance_total": importance_total,
        "power_peak": power_peak,
        "power_moments": power_moments,
        "space_search_candidates": candidates("space_search"),
        "adaptive_search_candidates": candidates("adaptive_search"),
        "grid_search_candidates": candidates("grid_search"),
        "random_search_candidates": candidates("random_search"),
    }


def _listed(params: list[dict]) -> str:
    rows = ", ".join("('" + json.dumps(p, sort_keys=True) + "')" for p in params)
    return f"SELECT params, CAST(1 AS BIGINT) AS n, TRUE AS sound FROM (VALUES {rows}) AS v(params)"


def _refined_peak() -> str:
    """The likeliest lambda by ever finer grids: steps of 0.1 from -2 to 2, then 20 steps ten times finer around the best, down to 0.0001."""
    ll = f"-COUNT(*) / 2.0 * LN(VAR_POP({yeo_johnson('x', 'g')})) + (g - 1) * SUM(SIGN(x) * LN(ABS(x) + 1))"
    found = "SELECT col, 0.0::DOUBLE AS lam FROM v GROUP BY col"
    for step, reach in ((0.1, 20), (0.01, 10), (0.001, 10), (0.0001, 10)):
        grid = f"SELECT b.col, b.lam + {step} * i AS g FROM ({found}) b, (SELECT UNNEST(range(-{reach}, {reach} + 1)) AS i)"
        found = f"SELECT col, arg_max(g, ll) AS lam FROM (SELECT v.col AS col, g, {ll} AS ll FROM v JOIN ({grid}) s ON v.col = s.col GROUP BY v.col, g) GROUP BY col"
    long = "SELECT 'Income' AS col, COALESCE(Income, 0)::DOUBLE AS x FROM ed UNION ALL SELECT 'TotalSpend', COALESCE(TotalSpend, 0)::DOUBLE FROM ed"
    return f"SELECT col, ROUND(lam, 3) AS lam FROM ({found})".replace(" FROM v ", f" FROM ({long}) v ")


def oracle_sql() -> dict[str, str]:
    def per_class(model: str) -> str:
        body = f"SELECT '{model}' AS model, CAST(t AS DOUBLE) AS label, quota AS n, quota AS n_keys, quota AS n_valid FROM quotas"
        return sql(["quotas"], body)

    part(
        "trained",
        ["c360", "quotas"],
        f"""SELECT ID, Target, fold FROM (SELECT ID, Target, quota,
        CAST((ROW_NUMBER() OVER (ORDER BY Target, {md5_order('ID', 42)}, ID) - 1) % 5 AS INTEGER) AS fold,
        ROW_NUMBER() OVER (PARTITION BY Target ORDER BY {md5_order('ID', 42)}, ID) AS place
        FROM c360 JOIN quotas ON Target = t) WHERE place > quota""",
    )
    models = " UNION ALL ".join(f"SELECT '{m}' AS model" for m in ("logistic_regression", "decision_tree", "random_forest"))
    everyone = "SELECT COUNT(*) AS n, COUNT(DISTINCT ID) AS n_keys, COUNT(*) AS n_valid, TRUE AS parted FROM c360"
    grid = expand_grid(GRIDS["logistic_regression"])
    draws = [
        {"criterion": c, "max_depth": d, "min_samples_split": s} for c in ("gini", "entropy") for d in (3, 5) for s in (2, 10)
    ]
    return {
        **{f"{name}_rows": per_class(model) for name, model in SCORED.items()},
        **{f"{name}_rows": sql(["c360"], everyone) for name in DECIDED},
        "oof_rows": sql(
            ["trained"],
            f"""SELECT model, fold, CAST(Target AS DOUBLE) AS label, COUNT(*) AS n, COUNT(DISTINCT ID) AS n_keys, COUNT(*) AS n_valid
            FROM trained, ({models}) GROUP BY ALL""",
        ),
        **{f"{name}_rows": sql(["folds"], """SELECT 'stack' AS model, fold, CAST(Target AS DOUBLE) AS label, COUNT(*) AS n,
            COUNT(DISTINCT ID) AS n_keys, COUNT(*) AS n_valid FROM folds GROUP BY ALL""") for name in ("lean_stack", "raw_stack")},
        "vote_mean": sql(["quotas"], "SELECT CAST(t AS DOUBLE) AS label, quota AS n_equal FROM quotas"),
        "lr_slope": "SELECT CAST(0 AS BIGINT) AS n_sloped",
        "lr_grid_slopes": f"SELECT params, CAST(0 AS BIGINT) AS n_sloped FROM ({_listed(grid)})",
        "tree_leaves": sql(["trained"], "SELECT CAST(0 AS BIGINT) AS n_wrong, COUNT(*) AS n_rows FROM trained"),
        "space_search_candidates": _listed(draw_from_space(SPACES["catboost"], 30)),
        "adaptive_search_candidates": _listed(draw_from_space(SPACES["lightgbm"], 30)),
        "power_peak": sql(["ed"], _refined_peak()),
        "power_moments": sql(
            ["c360"],
            f"SELECT col, (SELECT COUNT(*) FROM c360) AS n, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS std FROM (SELECT UNNEST({[f'{c}_norm' for c in POWER_COLUMNS]!r}) AS col)",
        ),
        "importance_total": "SELECT 1.0::DOUBLE AS total, CAST(0 AS BIGINT) AS n_negative, CAST(0 AS BIGINT) AS n_repeated",
        "grid_search_candidates": _listed(grid),
        "random_search_candidates": _listed(draws),
    }
