"""Fitted transformers over plain columns: scaling, power transform, imputation, column sets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope import schema as S
from buyerscope.functions.expressions import quoted, yeo_johnson, yeo_johnson_slopes
from buyerscope.operators.base import JsonEstimator, JsonModel
from buyerscope.operators.onehot import OneHot
from buyerscope.operators.quantiles import medians
from buyerscope.storage import write_once


def fit_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float | None]]:
    """Mean and population standard deviation per column, nulls skipped, in one pass."""
    row = df.agg(
        *[f(F.col(quoted(c)).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]
    ).first()
    return {c: [row[2 * i], row[2 * i + 1]] for i, c in enumerate(columns)}


def standardized(c: str, mean: float | None, std: float | None) -> Column:
    """(value - mean) / population deviation; a constant column becomes 0."""
    x = F.col(quoted(c)).cast("double") - F.lit(mean if mean is not None else 0.0)
    return x / F.lit(float(std) if std else 1.0)


SCALER_OPTIONS = {"columns": [], "suffix": ""}


class StandardScale(JsonEstimator):
    """Standardize columns, in place or under ``suffix``."""

    DEFAULTS = SCALER_OPTIONS

    def _fit(self, df: DataFrame) -> StandardScaleModel:
        return StandardScaleModel.from_estimator(self, fit_moments(df, self.opt("columns")))


class StandardScaleModel(JsonModel):
    DEFAULTS = SCALER_OPTIONS

    def _transform(self, df: DataFrame) -> DataFrame:
        suffix = self.opt("suffix")
        return df.withColumns(
            {f"{c}{suffix}": standardized(c, *ms) for c, ms in self.state().items()}
        )


POWER_OPTIONS = {"columns": [], "suffix": "_norm", "step": None, "standardize": True}
POWER_START = 1.0
POWER_STRIDE = 2.0  # longest step while one side of the peak is open
POWER_TOLERANCE = 1e-9  # change of lambda that ends the search
POWER_PASSES = 100


@dataclass(frozen=True)
class Likelihood:
    """Log likelihood of a column's lambda, per row, with its first and second derivative."""

    value: float
    slope: float
    bend: float


@dataclass
class Peak:
    """Where a column's best lambda lies: the search stays between the last lambdas known to lie below and above it."""

    at: float = POWER_START
    low: float = -math.inf
    high: float = math.inf
    last: float = POWER_START  # the last lambda whose likelihood is finite
    done: bool = False

    def move(self, found: Likelihood | None) -> None:
        """A Newton step where it stays inside the bounds and the likelihood bends down, half of the interval or a long step elsewhere."""
        if found is None:  # a constant column is as likely with any lambda; powers beyond the doubles bound the search
            if self.at == self.last:
                self.done = True
                return
            self.low, self.high = (self.low, self.at) if self.at > self.last else (self.at, self.high)
            self.at = (self.at + self.last) / 2
            return
        self.last = self.at
        if found.slope == 0:
            self.done = True
            return
        self.low, self.high = (self.at, self.high) if found.slope > 0 else (self.low, self.at)
        step = -found.slope / found.bend if found.bend < 0 else math.copysign(POWER_STRIDE, found.slope)
        step = max(-POWER_STRIDE, min(POWER_STRIDE, step))
        aim = self.at + step
        if not self.low < aim < self.high:
            aim = (self.low + self.high) / 2
        self.done = abs(aim - self.at) <= POWER_TOLERANCE
        self.at = aim


class PowerTransform(JsonEstimator):
    """Yeo-Johnson with the most likely lambda, then standardized. Nulls count as 0.

    The log likelihood has one peak (it is concave in lambda), so its slope tells on which side a lambda lies. Each pass sums the
    transform's derivatives of all columns in one aggregate and moves every lambda by a Newton step, kept between the bounds
    found so far. With ``step`` the result is the likeliest multiple of it. A column of one value, or with values that are not finite,
    keeps lambda 1.
    """

    DEFAULTS = POWER_OPTIONS

    def _fit(self, df: DataFrame) -> PowerTransformModel:
        columns = self.opt("columns")
        if not columns:
            return PowerTransformModel.from_estimator(self, {})
        # Every pass reads these columns alone, not what they were computed from.
        filled = write_once(df.select(*[F.coalesce(F.col(quoted(c)).cast("double"), F.lit(0.0)).alias(c) for c in columns]), "power")
        best = self._rounded(filled, likeliest_lambdas(filled, columns))
        powered = filled.select(*[yeo_johnson(F.col(quoted(c)), best[c]).alias(c) for c in columns])
        moments = fit_moments(powered, columns)
        return PowerTransformModel.from_estimator(
            self, {c: [best[c], *moments[c]] for c in columns}
        )

    def _rounded(self, df: DataFrame, best: dict[str, float]) -> dict[str, float]:
        step = self.opt("step")
        if step is None:
            return best
        sides = [{c: round(side(lam / step) * step, 10) for c, lam in best.items()} for side in (math.floor, math.ceil)]
        lower, upper = (likelihoods(df, lams) for lams in sides)
        least = Likelihood(-math.inf, 0.0, 0.0)
        return {c: sides[(upper[c] or least).value > (lower[c] or least).value][c] for c in best}


def likelihoods(df: DataFrame, lams: dict[str, float]) -> dict[str, Likelihood | None]:
    """Log likelihood per column at its lambda, one aggregate for all; None where no finite variance is left."""
    totals, sizes = [], 6
    for c, lam in lams.items():
        x = F.col(quoted(c))
        y, first, second = yeo_johnson_slopes(x, lam)
        totals += [
            F.var_pop(y), F.covar_pop(y, first), F.var_pop(first), F.covar_pop(y, second),
            F.avg(F.signum(x) * F.log1p(F.abs(x))), F.count(x),
        ]
    row = df.agg(*[t.alias(f"t{i}") for i, t in enumerate(totals)]).first()
    found: dict[str, Likelihood | None] = {}
    for i, (c, lam) in enumerate(lams.items()):
        variance, cross, spread, bent, logs, n = row[sizes * i : sizes * (i + 1)]
        numbers = (variance, cross, spread, bent, logs)
        if not n or any(v is None or not math.isfinite(v) for v in numbers) or variance <= 0:
            found[c] = None
            continue
        change = 2 * cross / variance
        found[c] = Likelihood(
            -math.log(variance) / 2 + (lam - 1) * logs, logs - change / 2, -(2 * (spread + bent) / variance - change * change) / 2
        )
    return found


def likeliest_lambdas(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Lambda at the peak of each column's likelihood."""
    peaks = {c: Peak() for c in columns}
    for _ in range(POWER_PASSES):
        todo = {c: p.at for c, p in peaks.items() if not p.done}
        if not todo:
            break
        for c, found in likelihoods(df, todo).items():
            peaks[c].move(found)
    return {c: p.at for c, p in peaks.items()}


class PowerTransformModel(JsonModel):
    DEFAULTS = POWER_OPTIONS

    def lambdas(self) -> dict[str, float]:
        return {c: v[0] for c, v in self.state().items()}

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (lam, mean, std) in self.state().items():
            x = yeo_johnson(F.coalesce(F.col(quoted(c)).cast("double"), F.lit(0.0)), lam)
            if self.opt("standardize"):
                x = (x - F.lit(mean or 0.0)) / F.lit(std if std else 1.0)
            out[f"{c}{self.opt('suffix')}"] = x
        return df.withColumns(out)


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per text column, the lowest one on ties."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("c"), F.col(quoted(c)).cast("string").alias("v")) for c in columns]
    )
    counts = (
        df.select(F.inline(pairs)).where(F.col("v").isNotNull())
        .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    rows = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v")).collect()
    found = {r["c"]: r["v"] for r in rows}
    return {c: found.get(c) for c in columns}


IMPUTE_OPTIONS = {"columns": [], "strategy": "median", "value": S.UNKNOWN}


class FillMissing(JsonEstimator):
    """Fill nulls by the exact median, the most frequent value (lowest on ties) or a constant."""

    DEFAULTS = IMPUTE_OPTIONS

    def _fit(self, df: DataFrame) -> FillMissingModel:
        columns, strategy = self.opt("columns"), self.opt("strategy")
        if not columns:
            learned = {}
        elif strategy == "median":
            learned = medians(df, columns)
        elif strategy == "most_frequent":
            learned = most_frequent(df, columns)
        elif strategy == "constant":
            learned = {c: self.opt("value") for c in columns}
        else:
            raise ValueError(f"unknown strategy: {strategy}")
        return FillMissingModel.from_estimator(self, learned)


class FillMissingModel(JsonModel):
    DEFAULTS = IMPUTE_OPTIONS

    def _transform(self, df: DataFrame) -> DataFrame:
        filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.state().items() if v is not None}
        return df.withColumns(filled) if filled else df


ASSEMBLE_OPTIONS = {"skip": [], "out": "features"}


class AssembleNumbers(JsonEstimator):
    """Collect all numeric columns but ``skip`` into one vector, remembering their names."""

    DEFAULTS = ASSEMBLE_OPTIONS

    def _fit(self, df: DataFrame) -> AssembleNumbersModel:
        from buyerscope.operators.cleaning import numeric_columns

        names = numeric_columns(df, skip=self.opt("skip"))
        return AssembleNumbersModel.from_estimator(self, {"features": names})


class AssembleNumbersModel(JsonModel):
    DEFAULTS = ASSEMBLE_OPTIONS

    def feature_names(self) -> list[str]:
        return self.state()["features"]

    def _transform(self, df: DataFrame) -> DataFrame:
        """Columns absent from ``df`` count as 0, and so do nulls."""
        names, out = self.feature_names(), self.opt("out")
        have = set(df.columns)
        parts = df.withColumns(
            {
                f"_x{i}": F.coalesce(F.col(quoted(c)).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
                for i, c in enumerate(names)
            }
        )
        cols = [f"_x{i}" for i in range(len(names))]
        return VectorAssembler(inputCols=cols, outputCol=out).transform(parts).drop(*cols)


def column_transformer(
    numbers: Sequence[str],
    texts: Sequence[str],
    text_strategy: str = "constant",
    keep: Sequence[str] = (S.KEY, S.LABEL),
    features: str = "features",
) -> Pipeline:
    """Impute and scale numbers, impute and encode texts, assemble all into one vector."""
    return Pipeline(
        stages=[
            FillMissing(columns=list(numbers), strategy="median"),
            StandardScale(columns=list(numbers)),
            FillMissing(columns=list(texts), strategy=text_strategy),
            OneHot(columns=list(texts)),
            AssembleNumbers(skip=list(keep), out=features),
        ]
    )
