"""Pearson correlation over all pairs of numeric columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerscope import schema as S
from buyerscope.functions.expressions import quoted
from buyerscope.operators.cleaning import numeric_columns

_SUMS = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature_x, feature_y, correlation) for every ordered pair.

    A pair uses the rows where both values are present; a constant column gives null. Each task
    reduces its rows to sums per pair, so only columns x columns numbers per task are shuffled.
    """
    columns = list(columns or numeric_columns(df))
    d = len(columns)
    numbers = df.select(*[F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    # Values are taken relative to the column means: large offsets would cost digits.
    centre = np.array([v or 0.0 for v in numbers.agg(*[F.avg(c) for c in numbers.columns]).first()])

    def pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((6, d, d))
        for batch in batches:
            x = batch.to_numpy(dtype="float64") - centre
            present = ~np.isnan(x)
            x = np.where(present, x, 0.0)
            m = present.astype("float64")
            xx = x * x
            totals += np.stack([m.T @ m, x.T @ m, m.T @ x, xx.T @ m, m.T @ xx, x.T @ x])
        if totals[0].any():
            i, j = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
            cols = [i.ravel(), j.ravel(), *[t.ravel() for t in totals]]
            yield pd.DataFrame(dict(zip(["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"], cols)))

    sums = numbers.mapInPandas(pair_sums, _SUMS).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    n = F.col("n")
    var_x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    var_y = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    # Rounding leaves a constant column with a variance of about 1e-16 of its squares.
    varies = (var_x > F.col("sxx") * 1e-12) & (var_y > F.col("syy") * 1e-12)
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.element_at(names, F.col("i") + 1).alias("feature_x"),
        F.element_at(names, F.col("j") + 1).alias("feature_y"),
        F.when(varies, cov / F.sqrt(F.when(varies, var_x * var_y).otherwise(1.0))).alias("correlation"),
    )


def target_correlations(df: DataFrame, label: str = S.LABEL, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, correlation) with the label, highest first, nulls last."""
    columns = list(columns or numeric_columns(df))
    matrix = correlation_matrix(df, columns).where(F.col("feature_y") == label)
    return matrix.select(F.col("feature_x").alias("feature"), "correlation").orderBy(
        F.desc_nulls_last("correlation"), "feature"
    )


def correlation_extremes(ranked: DataFrame, label: str = S.LABEL, n: int = 5) -> DataFrame:
    """(side, feature, correlation): the n highest and n lowest, the label itself left out."""
    known = ranked.where((F.col("feature") != label) & F.col("correlation").isNotNull())
    top = known.orderBy(F.desc("correlation"), "feature").limit(n).withColumn("side", F.lit("top"))
    bottom = known.orderBy("correlation", "feature").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom).select("side", "feature", "correlation")
