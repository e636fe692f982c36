"""Data-quality reports: nulls, duplicates, bounds, key overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope import schema as S
from buyerscope.functions.expressions import quoted


def wide_to_rows(counted: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    """Turn a one-row frame with a column per name into (column, value) rows."""
    pairs = [
        F.struct(F.lit(n).alias("column"), F.col(quoted(n)).alias(value)) for n in names
    ]
    return counted.select(F.inline(F.array(*pairs)))


def null_counts(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """(column, n_null) for all columns, in one pass."""
    counted = df.agg(*[F.count_if(F.col(quoted(c)).isNull()).alias(c) for c in df.columns])
    rows = wide_to_rows(counted, df.columns, "n_null")
    return rows.where(F.col("n_null") > 0) if only_missing else rows


def null_profile(df: DataFrame) -> DataFrame:
    """(column, count, percentage) of the columns with nulls, worst first."""
    total = "_rows"
    counted = df.agg(
        *[F.count_if(F.col(quoted(c)).isNull()).alias(c) for c in df.columns],
        F.count(F.lit(1)).alias(total),
    )
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(quoted(c)).alias("count"),
            F.round(F.try_divide(F.col(quoted(c)) * 100.0, F.col(total)), 2).alias("percentage"),
        )
        for c in df.columns
    ]
    return (
        counted.select(F.inline(F.array(*pairs)))
        .where(F.col("count") > 0)
        .orderBy(F.desc("percentage"), "column")
    )


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n_rows, n_keys, n_duplicates)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def out_of_bounds(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(column, n_outside): rows below the lower or above the upper bound."""

    def outside(c: str, low, high) -> Column:
        test = F.lit(False)
        if low is not None:
            test = test | (F.col(c) < low)
        if high is not None:
            test = test | (F.col(c) > high)
        return F.count_if(test).alias(c)

    counted = df.agg(*[outside(c, low, high) for c, (low, high) in bounds.items()])
    return wide_to_rows(counted, list(bounds), "n_outside")


def shared_keys(left: DataFrame, right: DataFrame, key: str = S.KEY) -> DataFrame:
    """Keys that occur in both frames, once each."""
    return left.select(key).intersect(right.select(key))


def leakage_check(train: DataFrame, test: DataFrame, key: str = S.KEY) -> DataFrame:
    """(n_train, n_test, n_overlap) over distinct keys.

    One aggregation by key over both frames: no join, and repeated keys collapse before the shuffle.
    """
    both = (
        train.select(key, F.lit(1).alias("in_train"), F.lit(0).alias("in_test"))
        .unionByName(test.select(key, F.lit(0).alias("in_train"), F.lit(1).alias("in_test")))
        .groupBy(key)
        .agg(F.max("in_train").alias("in_train"), F.max("in_test").alias("in_test"))
    )
    return both.agg(
        F.coalesce(F.sum("in_train"), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum("in_test"), F.lit(0)).alias("n_test"),
        F.count_if((F.col("in_train") == 1) & (F.col("in_test") == 1)).alias("n_overlap"),
    )


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that lists the missing columns."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def align_schema(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``keep`` + ``features`` in that order: absent features are 0, others are dropped."""
    have = set(df.columns)
    return df.select(
        *keep, *[F.col(quoted(c)) if c in have else F.lit(0).alias(c) for c in features]
    )


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def column_difference(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str]]:
    """(columns only in left, columns only in right)."""
    a, b = set(left.columns), set(right.columns)
    return [c for c in left.columns if c not in b], [c for c in right.columns if c not in a]


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def append_rows(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows added to a log; columns missing on either side become null."""
    return log.unionByName(rows, allowMissingColumns=True)
