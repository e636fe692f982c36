"""Cleaning of the customer record: fitted on training data, applied to any data.

Order: date -> tenure -> income -> categories -> negatives -> income cap -> birth year ->
binary flags -> de-duplication -> remaining nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buyerscope import schema as S
from buyerscope.functions.dates import as_of_days
from buyerscope.functions.expressions import at_least, at_most
from buyerscope.operators.base import JsonEstimator, JsonModel
from buyerscope.operators.quantiles import exact_quantiles, medians
from buyerscope.storage import write_once

# Column with the order of the rows in their files, where the reader kept it.
POSITION = "ingest_pos"

OPTIONS = {
    "as_of": "2025-04-23",
    "key": S.KEY,
    "dedupe": True,
    "order": None,
    "date": "Dt_Customer",
    "tenure": "Days_Since_Registration",
    "income": "Income",
    "income_cap": 0.995,
    "birth_year": "Year_Birth",
    "ages": [18, 100],
    "categories": S.CATEGORIES,
    "counts": S.COUNTS,
    "amounts": S.SPEND,
    "binary": [*S.BINARY, S.LABEL],
}


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def fill_median_tenure(date: str, median_day: float | None, as_of: str) -> Column:
    """Whole days from the date, or from the median date where it is missing, to ``as_of``."""
    day = F.unix_date(F.col(date)).cast("double")
    if median_day is not None:
        day = F.coalesce(day, F.lit(float(median_day)))
    return F.floor(F.lit(float(as_of_days(as_of))) - day).cast("int")


def fill_unknown(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(S.UNKNOWN))


def clamp(c: str, low: int, high: int) -> Column:
    return at_most(at_least(c, low), high)


def to_binary(c: str) -> Column:
    """1 for positive values, else 0."""
    return F.when(F.col(c) > 0, F.lit(1)).otherwise(F.lit(0))


def is_binary(c: str) -> Column:
    """True while every value is 0, 1 or null (an aggregate)."""
    return F.coalesce(F.every(F.col(c).isin(0, 1) | F.col(c).isNull()), F.lit(True))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``.

    A minimum per key, so that a key with very many copies is reduced before the shuffle
    rather than sorted in one task. Ordered by all its columns, a row is its own order and travels once.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*rest)
    picked = F.min(row) if list(order) == rest else F.min_by(row, F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_first")).select(*keys, "_first.*").select(*df.columns)


def fill_remaining(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Replace nulls of numeric columns by fitted medians."""
    kept = {c: v for c, v in values.items() if v is not None and c in df.columns}
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v))
            for c, v in kept.items()
        }
    ) if kept else df


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def _holes(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of the columns that hold nulls."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first() if names else ()
    return [c for c, n in zip(names, nulls) if n]


class Cleaner(JsonEstimator):
    """Learns medians, the income cap and which flags need coercion from training data."""

    DEFAULTS = OPTIONS

    def _fit(self, df: DataFrame) -> CleanerModel:
        date, income = self.opt("date"), self.opt("income")
        first = {}
        if date in df.columns:
            first["date"] = (F.unix_date(date), [0.5])
        if income in df.columns:
            first["income"] = (income, [0.5])
        learned: dict = {k: v[0] for k, v in exact_quantiles(df, first).items()}
        if income in df.columns:
            filled = F.coalesce(F.col(income), F.lit(learned["income"]))
            cap = exact_quantiles(df, {"cap": (filled, [self.opt("income_cap")])})
            learned["income_cap"] = cap["cap"][0]
        flags = _present(df, self.opt("binary"))
        row = df.agg(*[is_binary(c).alias(c) for c in flags]).first() if flags else ()
        learned["coerced"] = [c for c, ok in zip(flags, row) if not ok]
        model = CleanerModel.from_estimator(self, learned)
        # Only columns that still hold nulls need a median; the label is never imputed. Fewer rows hold no more nulls, so
        # rows are reduced to one per key only where all of them hold some, once for all passes.
        rows = model.steps(df)
        holes = _holes(rows, numeric_columns(rows, skip=[self.opt("key"), S.LABEL]))
        if holes and self.opt("dedupe") and self.opt("key") in df.columns:
            rows = write_once(model.transform(df).select(*holes), "clean_holes")
            holes = _holes(rows, holes)
        learned["residual"] = medians(rows, holes) if holes else {}
        return CleanerModel.from_estimator(self, learned)


class CleanerModel(JsonModel):
    """Applies the cleaning steps with the learned values."""

    DEFAULTS = OPTIONS

    def steps(self, df: DataFrame) -> DataFrame:
        """Everything up to the birth-year clamp and flag coercion: one projection per layer."""
        learned, out = self.state(), {}
        date, income = self.opt("date"), self.opt("income")
        if date in df.columns:
            out[self.opt("tenure")] = fill_median_tenure(date, learned["date"], self.opt("as_of"))
        if income in df.columns:
            filled = F.coalesce(F.col(income), F.lit(learned["income"]))
            out[income] = at_most(filled, learned["income_cap"])
        for c in _present(df, self.opt("categories")):
            out[c] = fill_unknown(c)
        for c in _present(df, [*self.opt("counts"), *self.opt("amounts")]):
            out[c] = at_least(c, 0)
        birth = self.opt("birth_year")
        if birth in df.columns:
            year = int(self.opt("as_of")[:4])
            youngest, oldest = self.opt("ages")
            out[birth] = clamp(birth, year - oldest, year - youngest)
        for c in _present(df, learned["coerced"]):
            out[c] = to_binary(c)
        return df.withColumns(out).drop(date)

    def _transform(self, df: DataFrame) -> DataFrame:
        out, key = self.steps(df), self.opt("key")
        if self.opt("dedupe") and key in df.columns:
            # Without a known order any fixed order will do: that of the other columns.
            known = self.opt("order") or _present(df, [POSITION])
            out = keep_first(out, [key], known or [c for c in out.columns if c != key])
        out = out.drop(POSITION)
        return fill_remaining(out, self.state().get("residual", {}))

    def audit(self, df: DataFrame) -> DataFrame:
        """(step, column, n_changed): how many values each step touches in ``df``."""
        learned = self.state()
        date, income, birth, key = (self.opt(o) for o in ("date", "income", "birth_year", "key"))
        year = int(self.opt("as_of")[:4])
        youngest, oldest = self.opt("ages")
        checks: list[tuple[str, str, Column]] = []
        for c in _present(df, [date]):
            checks.append(("fill_date", c, F.count_if(F.col(c).isNull())))
        for c in _present(df, [income]):
            checks.append(("fill_income", c, F.count_if(F.col(c).isNull())))
        for c in _present(df, self.opt("categories")):
            checks.append(("fill_unknown", c, F.count_if(F.col(c).isNull())))
        for c in _present(df, [*self.opt("counts"), *self.opt("amounts")]):
            checks.append(("clip_negative", c, F.count_if(F.col(c) < 0)))
        for c in _present(df, [income]):
            filled = F.coalesce(F.col(c), F.lit(learned["income"]))
            checks.append(("cap_income", c, F.count_if(filled > F.lit(learned["income_cap"]))))
        for c in _present(df, [birth]):
            outside = ~F.col(c).between(year - oldest, year - youngest)
            checks.append(("clamp_birth_year", c, F.count_if(outside)))
        for c in _present(df, self.opt("binary")):
            checks.append(("coerce_binary", c, F.count_if(~F.col(c).isin(0, 1))))
        counted = df.agg(
            *[c.alias(f"c{i}") for i, (_, _, c) in enumerate(checks)],
            F.count(F.lit(1)).alias("n"),
            F.count_distinct(F.col(key)).alias("keys"),
        )
        rows = [
            F.struct(F.lit(s).alias("step"), F.lit(c).alias("column"), F.col(f"c{i}").alias("n_changed"))
            for i, (s, c, _) in enumerate(checks)
        ]
        rows.append(
            F.struct(
                F.lit("drop_duplicates").alias("step"),
                F.lit(key).alias("column"),
                (F.col("n") - F.col("keys")).alias("n_changed"),
            )
        )
        return counted.select(F.inline(F.array(*rows)))
