"""Classifiers by name: one estimator, ``Learner``, whose parameters use the familiar names.

``Learner`` fits Spark ML stages and returns them as a pipeline model. Its output columns carry
the learner's name (``prob_<name>``, ``raw_<name>``, ``pred_<name>``), so fitted learners can be
chained into one ensemble pipeline.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml import classification as C
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope.models.boosting import fit_trees, plan_of
from buyerscope.models.knn import KnnModel
from buyerscope.models.linear import cosine_directions, fit_linear, linear_plan
from buyerscope.operators.base import JsonEstimator, JsonModel, JsonTransformer
from buyerscope.storage import write_once

# Parameter grids of the model benchmark.
GRIDS: dict[str, dict[str, list[Any]]] = {
    "logistic_regression": {
        "C": [0.01, 0.1, 1.0, 10.0],
        "penalty": ["l2"],
        "solver": ["liblinear", "saga"],
        "class_weight": [None, "balanced"],
    },
    "random_forest": {
        "n_estimators": [100, 200],
        "max_depth": [None, 10, 20],
        "min_samples_split": [2, 5, 10],
        "class_weight": [None, "balanced", "balanced_subsample"],
    },
    "gradient_boosting": {
        "n_estimators": [100, 200],
        "learning_rate": [0.01, 0.1],
        "max_depth": [3, 5],
        "subsample": [0.8, 1.0],
    },
    "xgboost": {
        "n_estimators": [100, 200],
        "learning_rate": [0.01, 0.1],
        "max_depth": [3, 5],
        "subsample": [0.8, 1.0],
        "colsample_bytree": [0.8, 1.0],
    },
    "lightgbm": {
        "n_estimators": [100, 200],
        "learning_rate": [0.01, 0.1],
        "max_depth": [3, 5, -1],
        "subsample": [0.8, 1.0],
        "class_weight": [None, "balanced"],
    },
    "svm": {"C": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]},
    "knn": {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"], "p": [1, 2]},
    "decision_tree": {
        "max_depth": [None, 10, 20],
        "min_samples_split": [2, 5, 10],
        "criterion": ["gini", "entropy"],
        "class_weight": [None, "balanced"],
    },
}
KINDS = [*GRIDS, "catboost", "mlp"]
LINEAR = ["logistic_regression", "svm"]
TREES = ["random_forest", "gradient_boosting", "xgboost", "lightgbm", "decision_tree", "catboost"]


def probability(name: str) -> Column:
    """Score of class 1 from a fitted learner's output."""
    return vector_to_array(F.col(f"prob_{name}"))[1]


class PopulationScaler(JsonEstimator):
    """Standardize a vector column with the population deviation; constant features become 0."""

    DEFAULTS = {"features": "features", "out": "scaled"}

    def _fit(self, df: DataFrame) -> PipelineModel:
        out = self.opt("out")
        scaler = StandardScaler(inputCol=self.opt("features"), outputCol=f"{out}_sample", withMean=True).fit(df)
        n = df.count()
        # Spark divides by the sample deviation, which is larger by sqrt(n / (n - 1)).
        factor = float(np.sqrt(n / (n - 1))) if n > 1 else 1.0
        size = scaler.mean.size
        stretch = ElementwiseProduct(
            scalingVec=Vectors.dense([factor] * size), inputCol=f"{out}_sample", outputCol=out
        )
        return PipelineModel([scaler, stretch])


class FourierFeatures(JsonTransformer):
    """Random cosine features whose inner products approximate the Gaussian kernel."""

    DEFAULTS = {"features": "scaled", "out": "lifted", "gamma": 1.0, "size": 0, "dims": 256, "seed": 42}

    def _transform(self, df: DataFrame) -> DataFrame:
        size, dims = self.opt("size"), self.opt("dims")
        directions, shifts = cosine_directions(self.opt("gamma"), size, dims, self.opt("seed"))

        @F.pandas_udf("array<double>")
        def lift(vectors: pd.Series) -> pd.Series:
            x = np.array(vectors.tolist(), dtype="float64").reshape(len(vectors), size)
            return pd.Series(list(np.sqrt(2.0 / dims) * np.cos(x @ directions + shifts)))

        lifted = array_to_vector(lift(vector_to_array(F.col(self.opt("features")))))
        return df.withColumn(self.opt("out"), lifted)


class WeightedVote(JsonTransformer):
    """Weighted mean of learners' class-1 scores; a tie is class 0."""

    DEFAULTS = {"weights": {}, "name": "vote"}

    def _transform(self, df: DataFrame) -> DataFrame:
        weights, name = self.opt("weights"), self.opt("name")
        terms = [probability(m) * F.lit(w) for m, w in weights.items()]
        p = sum(terms[1:], terms[0]) / F.lit(sum(weights.values()))
        return df.withColumn(f"prob_{name}", array_to_vector(F.array(F.lit(1.0) - p, p))).withColumn(
            f"pred_{name}", (p > 0.5).cast("double")
        )


class AtThreshold(JsonTransformer):
    """Final decision: ``probability`` and ``prediction`` = score reaches the threshold."""

    DEFAULTS = {"name": "vote", "threshold": 0.5, "strict": False}

    def _transform(self, df: DataFrame) -> DataFrame:
        p, t = probability(self.opt("name")), F.lit(float(self.opt("threshold")))
        hit = p > t if self.opt("strict") else p >= t
        return df.withColumn("score", p).withColumn("prediction", hit.cast("int"))


OPTIONS = {
    "kind": "logistic_regression",
    "name": "model",
    "params": {},
    "features": "features",
    "label": "label",
    "key": "key",
    "seed": 42,
}


class Learner(JsonEstimator):
    """Fit the classifier ``kind`` with ``params``; returns a pipeline model."""

    DEFAULTS = OPTIONS

    def columns(self) -> dict[str, str]:
        name = self.opt("name")
        return {
            "labelCol": self.opt("label"),
            "probabilityCol": f"prob_{name}",
            "rawPredictionCol": f"raw_{name}",
            "predictionCol": f"pred_{name}",
        }

    def _fit(self, df: DataFrame) -> PipelineModel:
        kind, params = self.opt("kind"), dict(self.opt("params"))
        if kind in TREES:
            plan = plan_of(kind, params, self.opt("seed"))
            model = fit_trees(df, plan, self.opt("name"), self.opt("features"), self.opt("label"), self.opt("key"))
            return PipelineModel([model])
        if kind in (*LINEAR, "knn"):
            out = f"scaled_{self.opt('name')}"
            scaler = PopulationScaler(features=self.opt("features"), out=out).fit(df)
            fit = self._knn if kind == "knn" else self._linear
            stages = [scaler, *fit(scaler.transform(df), out, params)]
        elif kind == "mlp":
            stages = [self._mlp(df, params).fit(df)]
        else:
            raise ValueError(f"unknown learner: {kind}")
        return PipelineModel(stages)

    def _mlp(self, df: DataFrame, params: dict) -> C.MultilayerPerceptronClassifier:
        size = df.select(self.opt("features")).first()[0].size
        return C.MultilayerPerceptronClassifier(
            layers=[size, *params.get("hidden", [64, 32]), 2],
            maxIter=params.get("max_iter", 100),
            seed=self.opt("seed"),
            featuresCol=self.opt("features"),
            **self.columns(),
        )

    def _linear(self, df: DataFrame, features: str, params: dict) -> list:
        """A penalized regression, or a margin machine, on cosine features for the Gaussian kernel, with a logistic curve over its margins."""
        plan, stages = linear_plan(self.opt("kind"), params, self.opt("seed")), []
        if plan.gamma is not None:
            lift = self._kernel(df, features, params)
            df, features = lift.transform(df), lift.opt("out")
            stages.append(lift)
        return [*stages, fit_linear(df, plan, self.opt("name"), features, self.opt("label"), self.opt("key"))]

    def _kernel(self, df: DataFrame, features: str, params: dict) -> FourierFeatures:
        row = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")).first()["s"]
        size, n = row["mean"].size, row["count"]
        if params.get("gamma", "scale") == "auto":
            gamma = 1.0 / size
        else:
            # Variance over all entries of the matrix.
            within = float(np.mean(row["variance"].toArray())) * (n - 1) / n
            spread = within + float(np.var(row["mean"].toArray()))
            gamma = 1.0 / (size * spread) if spread > 0 else 1.0
        return FourierFeatures(
            features=features, out=f"lifted_{self.opt('name')}", gamma=gamma, size=size,
            dims=params.get("dims", 256), seed=self.opt("seed"),
        )

    def _knn(self, df: DataFrame, features: str, params: dict) -> list:
        base = df.select(
            F.col(self.opt("key")).alias("id"), vector_to_array(F.col(features)).alias("v"),
            F.col(self.opt("label")).alias("label"),
        )
        model = KnnModel(
            {"data": None}, features=features, key=self.opt("key"), name=self.opt("name"),
            k=params.get("n_neighbors", 5), weights=params.get("weights", "uniform"), p=params.get("p", 2),
        )
        return [model.with_data(write_once(base, "knn_train"))]


def learner(kind: str, name: str | None = None, **params) -> Learner:
    """Shorthand: a learner with the default columns."""
    return Learner(kind=kind, name=name or kind, params=params)


__all__ = ["GRIDS", "KINDS", "Learner", "WeightedVote", "AtThreshold", "learner", "probability", "JsonModel"]
