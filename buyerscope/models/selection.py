"""Feature importance and feature selection."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerscope.models.boosting import Trial, TreesModel, bin_rows, families, fit_ensembles, held_out_scores, plan_of, swapped_scores
from buyerscope.models.learners import TREES, Learner, probability
from buyerscope.models.validation import PARALLELISM, out_of_fold
from buyerscope.operators.metrics import fold_scores, rank_metrics, score_spread
from buyerscope.operators.splits import rank_by_hash
from buyerscope.storage import write_once


def stages_of(model: Model) -> list:
    """All stages of a pipeline model, nested pipelines flattened."""
    if isinstance(model, PipelineModel):
        return [s for stage in model.stages for s in stages_of(stage)]
    return [model]


def classifier_of(model: Model):
    """The last stage with importances or coefficients."""
    for stage in reversed(stages_of(model)):
        if hasattr(stage, "featureImportances") or hasattr(stage, "coefficients"):
            return stage
    raise ValueError("no stage with importances or coefficients")


def importance_table(model: Model, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """(Feature, Importance), highest first: tree importances or absolute coefficients."""
    stage = classifier_of(model)
    if hasattr(stage, "featureImportances"):
        values = stage.featureImportances.toArray()
    else:
        values = abs(stage.coefficients.toArray())
    if len(values) != len(names):
        raise ValueError(f"{len(values)} importances for {len(names)} names")
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "Feature string, Importance double").orderBy(
        F.desc("Importance"), "Feature"
    )


def top_features(table: DataFrame, n: int) -> list[str]:
    """Names of the n most important features."""
    rows = table.orderBy(F.desc("Importance"), "Feature").limit(n).collect()
    return [r["Feature"] for r in rows]


def first_features(names: Sequence[str], n: int) -> list[str]:
    return list(names)[:n]


def linear_attribution(model: Model, df: DataFrame, names: Sequence[str], features: str = "features") -> DataFrame:
    """(Feature, Importance): mean absolute contribution coefficient * (x - mean) of a linear model.

    Uses the vector the linear stage reads, so ``df`` must hold ``features``; trees fall back
    on their importances.
    """
    stage = classifier_of(model)
    if not hasattr(stage, "coefficients"):
        return importance_table(model, names, df.sparkSession)
    scored = model.transform(df)
    x = vector_to_array(F.col(stage.getFeaturesCol()))
    cells = scored.select(F.posexplode(x).alias("i", "x"))
    # Deviations need the mean first; both passes reduce inside their tasks to one row per feature.
    means = cells.groupBy("i").agg(F.avg("x").alias("m")).collect()
    centre = [0.0] * len(names)
    for r in means:
        centre[r["i"]] = r["m"]
    centre_at = F.array(*[F.lit(float(m)) for m in centre])
    slope_at = F.array(*[F.lit(float(c)) for c in stage.coefficients.toArray()])
    label_at = F.array(*[F.lit(n) for n in names])
    share = F.abs(F.get(slope_at, F.col("i")) * (F.col("x") - F.get(centre_at, F.col("i"))))
    return (
        cells.groupBy("i")
        .agg(F.avg(share).alias("Importance"))
        .select(F.get(label_at, F.col("i")).alias("Feature"), "Importance")
        .orderBy(F.desc("Importance"), "Feature")
    )


def permutation_importance(
    model: Model,
    name: str,
    df: DataFrame,
    names: Sequence[str],
    key: str = "key",
    label: str = "label",
    features: str = "features",
    repeats: int = 10,
    seed: int = 42,
    metric: str = "roc_auc",
) -> DataFrame:
    """(Feature, Importance, std): mean drop of the metric when one feature is shuffled.

    A repeat pairs every row with another one by two hash orders, which is one join on unique
    ranks; each feature is then replaced by the partner's value in turn.
    """
    rows = df.select(key, label, vector_to_array(F.col(features)).alias("x"))
    base = _auc(model, name, rows.withColumn(features, array_to_vector("x")), key, label, [], metric).first()[0]
    drops, stages = None, stages_of(model)
    alone = stages[0] if len(stages) == 1 and isinstance(stages[0], TreesModel) else None
    for r in range(repeats):
        left = rank_by_hash(rows, key, f"{seed}-{r}-a", out="_i")
        right = rank_by_hash(rows.select(key, F.col("x").alias("other")), key, f"{seed}-{r}-b", out="_i").drop(key)
        paired = write_once(left.join(right, "_i").drop("_i"), "permuted")
        if alone and alone.opt("features") == features:
            # Trees score all swaps of a row in one pass, without a copy of the row per feature.
            scored = swapped_scores(alone, paired, label, len(names))
            found = rank_metrics(scored, ["j"]).select("j", F.col(metric).alias("value")).withColumn("repeat", F.lit(r))
        else:
            swapped = paired.select(
                key, label, F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("j"), "x", "other"
            ).withColumn(
                features,
                array_to_vector(F.transform("x", lambda v, i: F.when(i == F.col("j"), F.get(F.col("other"), i)).otherwise(v))),
            )
            found = _auc(model, name, swapped, key, label, ["j"], metric).withColumn("repeat", F.lit(r))
        drops = found if drops is None else drops.unionByName(found)
    label_at = F.array(*[F.lit(n) for n in names])
    drop = F.lit(base) - F.col("value")
    return (
        drops.groupBy("j")
        .agg(F.avg(drop).alias("Importance"), F.stddev_pop(drop).alias("std"))
        .select(F.get(label_at, F.col("j")).alias("Feature"), "Importance", "std")
        .orderBy(F.desc("Importance"), "Feature")
    )


def _auc(model, name, df, key, label, by, metric) -> DataFrame:
    scored = model.transform(df).select(*by, F.col(key), F.col(label).alias("label"), probability(name).alias("p"))
    return rank_metrics(scored, by).select(*by, F.col(metric).alias("value"))


def select_features(
    df: DataFrame,
    names: Sequence[str],
    method: str = "attribution",
    base: Learner | None = None,
    top_n: int = 30,
    seed: int = 42,
    **options,
) -> list[str]:
    """At most ``top_n`` feature names, most important first.

    ``method``: ``attribution`` or ``permutation`` rank with ``base`` fitted on ``df``; ``elimination`` keeps the best size of
    ``recursive_elimination`` (``df`` needs a fold column) and ranks what is left; ``first`` takes the names as they come, and so
    does a ranking without ``base``. ``options`` go to the method.
    """
    if method not in ("attribution", "permutation", "elimination", "first"):
        raise ValueError(f"unknown method {method}")
    if method == "elimination":
        base = base or Learner(kind="lightgbm", name="selector", seed=seed)
        kept, _ = recursive_elimination(df, base, names, **options)
        if len(kept) <= top_n:
            return kept
        part = slice_features(df, [list(names).index(c) for c in kept], base.opt("features"))
        return top_features(importance_table(base.fit(part), kept, df.sparkSession), top_n)
    if method == "first" or base is None:
        return first_features(names, top_n)
    model, name, features = base.fit(df), base.opt("name"), base.opt("features")
    if method == "permutation":
        found = permutation_importance(model, name, df, names, features=features, seed=seed, **options)
    else:
        found = linear_attribution(model, df, names, features, **options)
    return top_features(found, top_n)


def slice_features(df: DataFrame, indices: Sequence[int], features: str = "features") -> DataFrame:
    """Keep only some entries of the feature vector."""
    return (
        VectorSlicer(inputCol=features, outputCol="_kept", indices=list(indices))
        .transform(df)
        .drop(features)
        .withColumnRenamed("_kept", features)
    )


def recursive_elimination(
    df: DataFrame,
    base: Learner,
    names: Sequence[str],
    min_features: int | None = None,
    step: int = 1,
    key: str = "key",
    label: str = "label",
    fold: str = "fold",
    parallelism: int = PARALLELISM,
) -> tuple[list[str], DataFrame]:
    """(selected names, table (n_features, mean, std, features)).

    The least important features leave one step at a time; the size with the best
    cross-validated AUC wins, the smaller one on ties.
    """
    spark = df.sparkSession
    least = min_features or max(1, min(20, len(names) // 2))
    kept = list(range(len(names)))
    rows = []
    trees = _tree_steps(df, base, key, label, fold)
    while True:
        if trees:
            scores, order = trees(kept)
        else:
            part, order = slice_features(df, kept, base.opt("features")), None
            scores = out_of_fold(part, [base], key, label, fold, parallelism=parallelism).select(
                F.col(fold).alias("fold"), F.col(label).alias("label"), "p"
            )
        spread = score_spread(fold_scores(scores)).first()
        rows.append((len(kept), float(spread["mean"]), float(spread["std"]), [names[i] for i in kept]))
        if len(kept) <= least:
            break
        if order is None:
            ranked = importance_table(base.fit(part), [str(i) for i in kept], spark)
            order = [int(r["Feature"]) for r in ranked.collect()]
        kept = sorted(order[: max(least, len(kept) - step)])
    best = max(rows, key=lambda r: (r[1], -r[0]))
    table = spark.createDataFrame(rows, "n_features int, mean double, std double, features array<string>")
    return list(best[3]), table


def _tree_steps(df: DataFrame, base: Learner, key: str, label: str, fold: str) -> Callable[[list[int]], tuple[DataFrame, list[int]]] | None:
    """For trees: from the features that are left to their out-of-fold scores (fold, label, p) and their order by importance.

    Rows are binned once for all steps, and a step's folds grow side by side with the fit on all rows. None for other learners.
    """
    fixed = json.loads(base.getOrDefault(base.options))
    if fixed["kind"] not in TREES or (fixed["label"], fixed["key"]) != (label, key):
        return None
    table = bin_rows(df, fixed["features"], label, key, fold)
    plan, folds = plan_of(fixed["kind"], fixed["params"], fixed["seed"]), sorted({f for f, _ in table.counts})

    def step(kept: list[int]) -> tuple[DataFrame, list[int]]:
        part, trials = table.only(kept), families([plan], folds)
        *grown, whole = fit_ensembles(part, [*trials, Trial(plan)])
        scores = write_once(held_out_scores(part, trials, grown=grown).select("fold", "label", "p"), "out_of_fold")
        gains = dict(zip(kept, whole.gains(len(kept)).tolist(), strict=True))
        return scores.withColumn("label", F.col("label").cast(df.schema[label].dataType)), sorted(kept, key=lambda i: (-gains[i], str(i)))

    return step
