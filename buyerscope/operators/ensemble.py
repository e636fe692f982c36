"""Combining models through their score tables: (key, label, model, p[, fold])."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope.operators.metrics import rank_metrics
from buyerscope.operators.profile import best_row

WEIGHTS = [i / 10 for i in range(11)]


def side_by_side(scores: DataFrame, models: Sequence[str], keep: Sequence[str] = ("key", "label")) -> DataFrame:
    """One row per key with a column p_<model> per model."""
    return scores.groupBy(*keep).agg(
        *[F.max(F.when(F.col("model") == m, F.col("p"))).alias(f"p_{m}") for m in models]
    )


def weighted(models: dict[str, float]) -> Column:
    """Weighted mean of the models' scores; needs the columns p_<model>."""
    total = sum(models.values())
    terms = [F.col(f"p_{m}") * F.lit(w) for m, w in models.items()]
    return sum(terms[1:], terms[0]) / F.lit(total)


def soft_vote(
    scores: DataFrame, weights: dict[str, float], keep: Sequence[str] = ("key", "label")
) -> DataFrame:
    """(key, label, p, prediction): mean of the scores, equal or weighted; a tie is class 0."""
    wide = side_by_side(scores, list(weights), keep).withColumn("p", weighted(weights))
    return wide.select(*keep, "p", (F.col("p") > 0.5).cast("int").alias("prediction"))


def weight_grid(
    wide: DataFrame, first: str, second: str, weights: Sequence[float] = WEIGHTS, **options
) -> DataFrame:
    """(weight, roc_auc) for weight * first + (1 - weight) * second.

    All weights are evaluated in one grouped query over the stored scores.
    """
    tried = F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight")
    mixed = wide.select(
        "key", "label", F.col(f"p_{first}").alias("a"), F.col(f"p_{second}").alias("b"), tried
    ).select(
        "key", "label", "weight",
        (F.col("a") * F.col("weight") + F.col("b") * (F.lit(1.0) - F.col("weight"))).alias("p"),
    )
    return rank_metrics(mixed, ["weight"], **options).select("weight", "roc_auc")


def best_weight(grid: DataFrame) -> DataFrame:
    """The weight with the highest area, the lowest weight on ties."""
    return best_row(grid, "roc_auc", "weight")


def subsets(models: Sequence[str], smallest: int = 2) -> list[tuple[str, ...]]:
    """All combinations of at least ``smallest`` models, small ones first."""
    return [c for size in range(smallest, len(models) + 1) for c in combinations(models, size)]


def subset_search(wide: DataFrame, models: Sequence[str], smallest: int = 2, **options) -> DataFrame:
    """(position, models, roc_auc) for the equal vote of every subset of the models."""
    tried = []
    for i, chosen in enumerate(subsets(models, smallest)):
        tried.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit("+".join(chosen)).alias("models"),
                weighted({m: 1.0 for m in chosen}).alias("p"),
            )
        )
    mixed = wide.select("key", "label", F.inline(F.array(*tried)))
    return rank_metrics(mixed, ["position", "models"], **options).select("position", "models", "roc_auc")


def best_subset(found: DataFrame) -> DataFrame:
    """The subset with the highest area, the first tried on ties."""
    return best_row(found, "roc_auc", "position")
