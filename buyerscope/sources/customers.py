"""Customer files: typed CSV scans with missing-value tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buyerscope import schema as S
from buyerscope.functions.dates import DEFAULT_FORMATS, parse_dates
from buyerscope.functions.expressions import quoted
from buyerscope.operators.cleaning import POSITION
from buyerscope.operators.splits import stratified_split


def _typed(field: T.StructField, tokens: Sequence[str], strict: bool) -> Column:
    text = F.col(quoted(field.name))
    value = F.when(text.isin(list(tokens)), F.lit(None)).otherwise(text)
    typed = value.try_cast(field.dataType)
    if not strict:
        return typed.alias(field.name)
    misfit = value.isNotNull() & typed.isNull()
    typed = F.when(
        misfit,
        F.raise_error(F.concat(F.lit(f"{field.name}: not a {field.dataType.simpleString()}: "), value)),
    ).otherwise(typed)
    if not field.nullable:
        typed = F.when(typed.isNull(), F.raise_error(F.lit(f"{field.name}: missing value"))).otherwise(typed)
    return typed.alias(field.name)


def read_customers(
    spark: SparkSession,
    path: str | list[str],
    with_label: bool = True,
    layout: T.StructType | None = None,
    null_tokens: Sequence[str] = (*S.NULL_TOKENS, *S.DEFAULT_NULL_TOKENS),
    strict: bool = True,
    keep_position: bool = False,
) -> DataFrame:
    """Read customer CSV files with declared types.

    ``strict`` fails on a value that does not fit its type and on a missing value in a
    required column; otherwise such values become null. ``keep_position`` adds the order
    of the rows in the files, which "keep the first" de-duplication needs.
    """
    layout = layout or S.raw_schema(with_label)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in layout.fields])
    raw = spark.read.csv(path, header=True, schema=text, enforceSchema=False)
    columns = [_typed(f, null_tokens, strict) for f in layout.fields]
    if keep_position:
        columns.append(
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias(POSITION)
        )
    return raw.select(*columns)


def read_inferred(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with inferred types. Costs one more pass over the files than ``read_customers``."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_dated(
    spark: SparkSession,
    path: str | list[str],
    with_label: bool = True,
    date_column: str = "Dt_Customer",
    formats: Sequence[str] = DEFAULT_FORMATS,
    **options,
) -> DataFrame:
    """``read_customers`` with the date column parsed by the first fitting format."""
    df = read_customers(spark, path, with_label, **options)
    return df.withColumn(date_column, parse_dates(date_column, formats))


def read_bundle(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    sample_path: str,
    val_size: float = 0.2,
    seed: int = 42,
    key: str = S.KEY,
    label: str = S.LABEL,
) -> tuple[DataFrame, DataFrame | None, DataFrame, DataFrame]:
    """Train, validation, test and template frames; validation is a stratified share of train."""
    train = read_inferred(spark, train_path)
    test = read_inferred(spark, test_path)
    sample = read_inferred(spark, sample_path)
    if val_size <= 0:
        return train, None, test, sample
    parts = stratified_split(train, key, label, val_size, seed)
    return (
        parts.where(F.col("split") == "train").drop("split"),
        parts.where(F.col("split") == "test").drop("split"),
        test,
        sample,
    )
