"""Column expressions shared by the feature sets. All stay inside code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(c: str | Column) -> Column:
    return col(c).cast("double")


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Sum across columns of one row; a null counts as nothing."""
    return reduce(add, [F.coalesce(_num(c), F.lit(0.0)) for c in cols])


def row_count(cols: Sequence[str | Column]) -> Column:
    """Number of non-null columns of one row."""
    return reduce(add, [col(c).isNotNull().cast("int") for c in cols])


def row_mean(cols: Sequence[str | Column]) -> Column:
    n = row_count(cols)
    return F.when(n > 0, row_sum(cols) / F.greatest(n, F.lit(1)))


def row_std(cols: Sequence[str | Column]) -> Column:
    """Sample standard deviation across columns of one row, nulls skipped.

    Deviations are taken from the row mean, so large nearly equal values keep their digits.
    """
    n, mean = row_count(cols), row_mean(cols)
    squares = reduce(add, [F.coalesce(F.pow(_num(c) - mean, F.lit(2)), F.lit(0.0)) for c in cols])
    return F.when(n > 1, F.sqrt(squares / F.greatest(n - 1, F.lit(1))))


def nonzero(c: str | Column) -> Column:
    """A divisor with 0 replaced by 1; null stays null."""
    c = _num(c)
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b where a zero divisor counts as 1."""
    return _num(a) / nonzero(b)


def smoothed_ratio(a: str | Column, b: str | Column, top: float = 0.0) -> Column:
    """(a + top) / (b + 1); null where b is -1."""
    return F.try_divide(_num(a) + F.lit(top), _num(b) + F.lit(1.0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def at_least(c: str | Column, low) -> Column:
    """Raise values below ``low``; null stays null."""
    c = col(c)
    return F.when(c < F.lit(low), F.lit(low)).otherwise(c)


def at_most(c: str | Column, high) -> Column:
    """Lower values above ``high``; null stays null, and a null bound changes nothing."""
    c = col(c)
    return F.when(c > F.lit(high), F.lit(high)).otherwise(c)


def lookup(c: str | Column, mapping: dict[str, int | float], default) -> Column:
    """Value of ``c`` in a fixed mapping, else ``default``."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), F.lit(default))


def quoted(name: str) -> str:
    """Column name safe to pass to F.col even with spaces or dots."""
    return "`" + name.replace("`", "``") + "`"


def hash_unit(*parts: str | Column) -> Column:
    """Number in [0, 1) fixed by the text of ``parts``; the same in any SQL engine with md5."""
    text = F.concat_ws("-", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def hash_text(*parts: str | Column) -> Column:
    """md5 of the parts joined by '-', used to order rows reproducibly."""
    return F.md5(F.concat_ws("-", *[col(p).cast("string") for p in parts]))


SERIES_BELOW = 0.1
SERIES_TERMS = 10


def yeo_johnson(c: str | Column, lam: float) -> Column:
    """Yeo-Johnson transform of a column for one lambda."""
    x = _num(c)
    if abs(lam) < 1e-12:
        positive = F.log1p(F.abs(x))
    else:
        positive = (F.pow(F.abs(x) + 1, F.lit(lam)) - 1) / lam
    if abs(lam - 2) < 1e-12:
        negative = -F.log1p(F.abs(x))
    else:
        negative = -(F.pow(F.abs(x) + 1, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, positive).otherwise(negative)


def yeo_johnson_slopes(x: Column, lam: float) -> tuple[Column, Column, Column]:
    """Yeo-Johnson transform and its first and second derivative by lambda.

    They are the integrals of e^(vt), t e^(vt) and t^2 e^(vt) for t from 0 to log(1 + |x|), with v = lambda or, below 0, 2 - lambda;
    a power series replaces the closed forms where v is too near 0 for them.
    """
    below = x < 0
    u = F.log1p(F.abs(x))
    v = F.when(below, F.lit(2.0 - lam)).otherwise(F.lit(float(lam)))
    z = v * u
    near = F.abs(z) < SERIES_BELOW
    divisor = F.when(near, F.lit(1.0)).otherwise(v)

    def series(k: int) -> Column:
        total = F.lit(0.0)
        for j in range(SERIES_TERMS, -1, -1):
            total = total * z + F.lit(1.0 / (math.factorial(j) * (j + k + 1)))
        return total * F.pow(u, F.lit(k + 1))

    grown = F.exp(z)
    zeroth = F.when(near, series(0)).otherwise(F.expm1(z) / divisor)
    first = F.when(near, series(1)).otherwise((u * grown - zeroth) / divisor)
    second = F.when(near, series(2)).otherwise((u * u * grown - F.lit(2.0) * first) / divisor)
    sign = F.when(below, F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign * zeroth, first, sign * second
