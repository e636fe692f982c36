"""Writers: tables, predictions, metric logs, experiment records, samples, templates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buyerscope import schema as S


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the table at ``path``; CSV output carries a header."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def prediction_table(
    scored: DataFrame,
    key: str = S.KEY,
    prediction: str = "prediction",
    probability: str | None = None,
    out: str = S.LABEL,
) -> DataFrame:
    """(key, predicted label[, probability])."""
    columns: list[Column] = [F.col(key), F.col(prediction).cast("int").alias(out)]
    if probability:
        columns.append(F.col(probability).cast("double").alias("Probability"))
    return scored.select(*columns)


def fill_template(
    template: DataFrame, predictions: DataFrame, key: str = S.KEY, out: str = S.LABEL
) -> DataFrame:
    """Every template row with its prediction, matched on the key."""
    return template.select(key).join(predictions.select(key, out), key, "left")


def append_metrics(
    metrics: DataFrame,
    path: str,
    model: str,
    cv_folds: int | None = None,
    at: dt.datetime | None = None,
) -> None:
    """Add rows to the metric log without reading it back."""
    rows = metrics.withColumn("model", F.lit(model)).withColumn("timestamp", F.lit(run_stamp(at)))
    if cv_folds is not None:
        rows = rows.withColumn("cv_folds", F.lit(cv_folds))
    rows.write.mode("append").parquet(path)


def run_stamp(at: dt.datetime | None = None, pattern: str = "%Y-%m-%d %H:%M:%S") -> str:
    return (at or dt.datetime.now()).strftime(pattern)


EXPERIMENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("best_model", T.StringType()),
        T.StructField("feature_count", T.IntegerType()),
        T.StructField("train_samples", T.LongType()),
        T.StructField("test_samples", T.LongType()),
        T.StructField("positive_predictions", T.LongType()),
        T.StructField("positive_rate", T.DoubleType()),
        T.StructField("best_metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("features", T.ArrayType(T.StringType())),
    ]
)


def experiment_record(spark: SparkSession, **values) -> DataFrame:
    """One row describing a run; missing fields stay null."""
    return spark.createDataFrame([{f.name: values.get(f.name) for f in EXPERIMENT_SCHEMA}], EXPERIMENT_SCHEMA)


def write_experiment(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def head_sample(df: DataFrame, key: str = S.KEY, n: int = 10) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(key).limit(n)
