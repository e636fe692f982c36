"""k-nearest-neighbour classifier as a model stage. Its training rows are a stored table."""

from __future__ import annotations

import json

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerscope.operators.base import JsonModel
from buyerscope.operators.neighbours import classify


class KnnModel(JsonModel):
    """Scores rows by their nearest training rows; needs a unique key column."""

    DEFAULTS = {
        "features": "features", "key": "key", "name": "knn", "k": 5, "weights": "uniform", "p": 2,
    }

    def with_data(self, table: DataFrame) -> KnnModel:
        """Point the model at a stored table of (id, v, label)."""
        self._set(learned=json.dumps({"data": table.inputFiles()[0].rsplit("/", 1)[0]}))
        return self

    def data(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.state()["data"])

    def _transform(self, df: DataFrame) -> DataFrame:
        key, name = self.opt("key"), self.opt("name")
        asked = df.select(F.col(key).alias("id"), vector_to_array(F.col(self.opt("features"))).alias("v"))
        found = classify(
            asked, self.data(df.sparkSession), self.opt("k"), self.opt("weights"), self.opt("p")
        )
        p = F.col("p")
        return df.join(
            found.select(
                F.col("query_id").alias(key),
                array_to_vector(F.array(F.lit(1.0) - p, p)).alias(f"prob_{name}"),
                F.col("prediction").cast("double").alias(f"pred_{name}"),
            ),
            key,
        )

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


def knn_readings(pairs: DataFrame, candidates: dict[int, tuple[int, str]], keep: list[str]) -> DataFrame:
    """(candidate, keep..., p) for several numbers of neighbours and weightings, read off one search.

    ``pairs`` holds (keep..., query_id, rank, distance, label) with as many neighbours as the largest candidate asks for; a candidate is
    (neighbours, ``uniform`` or ``distance``). Exact matches among a candidate's neighbours decide alone when distances weigh.
    """
    for _, weights in candidates.values():
        if weights not in ("uniform", "distance"):
            raise ValueError(f"unknown weights: {weights}")
    asked = [F.struct(F.lit(i).alias("candidate"), F.lit(k).alias("k"), F.lit(w == "uniform").alias("even")) for i, (k, w) in candidates.items()]
    each = pairs.select("*", F.inline(F.array(*asked))).where("rank <= k")
    one = (F.col("label") == 1).cast("double")
    exact, near = (F.col("distance") == 0).cast("double"), F.coalesce(F.try_divide(F.lit(1.0), F.col("distance")), F.lit(0.0))
    votes = each.groupBy("candidate", *keep, "query_id").agg(
        F.max("even").alias("even"), F.avg(one).alias("plain"), F.sum(exact).alias("n_exact"), F.sum(exact * one).alias("exact_one"),
        F.sum(near).alias("near"), F.sum(near * one).alias("near_one"),
    )
    weighed = F.when(F.col("n_exact") > 0, F.col("exact_one") / F.col("n_exact")).otherwise(F.try_divide(F.col("near_one"), F.col("near")))
    return votes.select("candidate", *keep, "query_id", F.when(F.col("even"), F.col("plain")).otherwise(weighed).alias("p"))


class _Writer(MLWriter):
    """Metadata plus a copy of the training rows."""

    def __init__(self, model: KnnModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.data(self.sparkSession).write.parquet(f"{path}/rows")


class _Reader(MLReader):
    def __init__(self, cls: type[KnnModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> KnnModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._set(learned=json.dumps({"data": f"{path}/rows"}))
        return model
