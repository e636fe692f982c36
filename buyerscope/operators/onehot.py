"""Indicator columns and codes for categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope.operators.base import JsonEstimator, JsonModel

# More levels than this are taken for a key or free text; a parameter of every stage that encodes.
MAX_LEVELS = 1000


def fit_vocabulary(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column; too many are an error, not a cut."""
    out: dict[str, list[str]] = {}
    if not columns:
        return out
    pairs = F.array(
        *[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]
    )
    levels = df.select(F.inline(pairs)).where(F.col("v").isNotNull()).distinct()
    # One number per column tells which of them are too wide before any value is fetched.
    counts = {r["c"]: r["count"] for r in levels.groupBy("c").count().collect()}
    large = {c: n for c, n in counts.items() if n > max_levels}
    if large:
        raise ValueError(f"more than {max_levels} levels: {large}; raise max_levels if they are categories")
    rows = levels.collect()
    for c in columns:
        out[c] = sorted(r["v"] for r in rows if r["c"] == c)
    return out


def dummies(c: str, levels: Sequence[str], null_column: bool = False) -> dict[str, Column]:
    """{column_level: 0/1}; an unseen value gives zeros, a null its own column if asked."""
    out = {f"{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0) for v in levels}
    if null_column:
        out[f"{c}_nan"] = F.col(c).isNull().cast("int")
    return out


OPTIONS = {"columns": [], "drop_first": False, "null_column": False, "keep_original": False, "max_levels": MAX_LEVELS}


class OneHot(JsonEstimator):
    """One-hot encoding with a vocabulary learned once; unseen values become all zeros."""

    DEFAULTS = OPTIONS

    def _fit(self, df: DataFrame) -> OneHotModel:
        return OneHotModel.from_estimator(self, fit_vocabulary(df, self.opt("columns"), self.opt("max_levels")))


class OneHotModel(JsonModel):
    DEFAULTS = OPTIONS

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, levels in self.state().items():
            kept = levels[1:] if self.opt("drop_first") else levels
            out.update(dummies(c, kept, self.opt("null_column")))
        encoded = df.withColumns(out) if out else df
        return encoded if self.opt("keep_original") else encoded.drop(*self.state())
