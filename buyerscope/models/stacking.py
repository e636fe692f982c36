"""Stacked and voting ensembles as plain pipeline models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerscope.models.learners import Learner, WeightedVote
from buyerscope.models.validation import (
    PARALLELISM, fold_numbers, in_parallel, out_of_fold, score_with,
)
from buyerscope.operators.ensemble import side_by_side
from buyerscope.operators.splits import stratified_folds
from buyerscope.storage import write_once

# Rows up to which whole stacks are fitted side by side; beyond, the trees of one keep all cores busy and fill the driver.
TOGETHER = 1 << 17


def _assembled(names: Sequence[str], out: str) -> list[Transformer]:
    """Stages that collect the class-1 scores of fitted learners into one vector."""
    slices = [VectorSlicer(inputCol=f"prob_{n}", outputCol=f"p1_{n}", indices=[1]) for n in names]
    return [*slices, VectorAssembler(inputCols=[f"p1_{n}" for n in names], outputCol=out)]


def fit_stack(
    df: DataFrame,
    bases: Sequence[Learner],
    meta: Learner,
    key: str = "key",
    label: str = "label",
    fold: str = "fold",
    parallelism: int = PARALLELISM,
    scores: DataFrame | None = None,
) -> PipelineModel:
    """Bases fitted on all rows, and ``meta`` fitted on their out-of-fold scores.

    ``meta`` must read the column ``meta_<its name>``. ``scores`` reuses out-of-fold scores that
    are already there.
    """
    names = [b.opt("name") for b in bases]
    features = f"meta_{meta.opt('name')}"
    # The fits on all rows do not wait for those outside the folds.
    known = [lambda: out_of_fold(df, bases, key, label, fold, parallelism=parallelism) if scores is None else scores]
    found, *fitted = in_parallel([*known, *[lambda b=b: b.fit(df) for b in bases]], parallelism)
    wide = side_by_side(found, names, [key, label])
    training = write_once(
        VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol=features).transform(wide), "meta_train"
    )
    return PipelineModel([*fitted, *_assembled(names, features), meta.fit(training)])


def meta_learner(kind: str = "logistic_regression", name: str = "stack", **params) -> Learner:
    """A learner over the stacked scores."""
    return Learner(kind=kind, name=name, params=params, features=f"meta_{name}")


def stack_out_of_fold(
    df: DataFrame,
    bases: Sequence[Learner],
    meta: Learner,
    key: str = "key",
    label: str = "label",
    fold: str = "fold",
    inner_folds: int = 5,
    seed: int = 42,
    parallelism: int = PARALLELISM,
) -> DataFrame:
    """(key, label, fold, model, p): the whole stack refitted without each outer fold.

    Outer folds run side by side up to ``TOGETHER`` rows: the last long fits of one leave room for the others. Scores are written fold by
    fold, so that no more stacks are held than run.
    """

    def outer(f: int) -> DataFrame:
        train = stratified_folds(
            df.where(F.col(fold) != f), key, label, inner_folds, seed + 1 + f, out="_inner"
        )
        model = fit_stack(write_once(train, "inner"), bases, meta, key, label, "_inner", parallelism)
        return write_once(score_with(model, meta.opt("name"), df.where(F.col(fold) == f), [key, label, fold]), "stack_out_of_fold")

    few = df.count() <= TOGETHER
    return reduce(DataFrame.unionByName, in_parallel([lambda f=f: outer(f) for f in fold_numbers(df, fold)], parallelism + 1 if few else 1))


def fit_vote(
    df: DataFrame, learners: Sequence[Learner], weights: Sequence[float] | None = None, name: str = "vote",
    parallelism: int = PARALLELISM,
) -> PipelineModel:
    """Soft vote of learners fitted on all rows; equal weights by default."""
    fitted = in_parallel([lambda b=b: b.fit(df) for b in learners], parallelism)
    return join_vote(fitted, [b.opt("name") for b in learners], weights, name)


def join_vote(
    fitted: Sequence[PipelineModel], names: Sequence[str], weights: Sequence[float] | None = None, name: str = "vote"
) -> PipelineModel:
    """Soft vote of models that are already fitted."""
    weights = weights or [1.0] * len(names)
    return PipelineModel([*fitted, WeightedVote(weights=dict(zip(names, weights)), name=name)])
