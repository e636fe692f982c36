"""Exact quantiles with linear interpolation, by one method on tables of any size.

A sketch brackets each wanted order statistic, one pass counts the rows below and inside all brackets, and only the values
inside are looked at, again in one pass. The counts prove the brackets right, so the result is exact whatever the sketch says.
Values are ranked as Spark orders them: minus infinity, finite numbers, infinity, NaN; only the finite ones need a search.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one bracket that may be sorted in one task.
BRACKET_ROWS = 1_000_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Bracket:
    """The finite value of rank ``rank`` (0-based) lies in [low, high]."""

    column: Column
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None
    name: str = ""

    def member(self) -> Column:
        keep = self.column.isNotNull()
        if self.low is not None:
            keep = keep & self.column.between(self.low, self.high)
        return keep


def exact_quantiles(
    df: DataFrame,
    specs: dict[str, tuple[Column | str, Sequence[float]]],
    bracket_rows: int = BRACKET_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float | None]]:
    """Quantiles of several columns: {name: (column, [q, ...])} -> {name: [value, ...]}.

    Nulls are skipped; a column without values gives nulls. ``bracket_rows`` and ``accuracy`` change the number of passes and never
    the result.
    """
    if not specs:
        return {}
    columns = {
        n: ((F.col(c) if isinstance(c, str) else c).cast("double"), list(qs))
        for n, (c, qs) in specs.items()
    }
    infinity = F.lit(math.inf)
    counts = df.agg(
        *[
            count
            for i, (c, _) in enumerate(columns.values())
            for count in (
                F.count(c).alias(f"n{i}"), F.count_if(c == -infinity).alias(f"l{i}"),
                F.count_if(c == infinity).alias(f"h{i}"), F.count_if(F.isnan(c)).alias(f"x{i}"),
            )
        ]
    ).first()
    wanted: dict[tuple[str, int], _Bracket] = {}
    fixed: dict[tuple[str, int], float] = {}
    for i, (name, (column, qs)) in enumerate(columns.items()):
        n, low, high, nan = counts[4 * i : 4 * i + 4]
        finite = F.when(~F.isnan(column) & (F.abs(column) < infinity), column)
        for q in qs if n else ():
            for rank in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))}:
                if rank < low:
                    fixed[name, rank] = -math.inf
                elif rank >= n - nan:
                    fixed[name, rank] = math.nan
                elif rank >= n - nan - high:
                    fixed[name, rank] = math.inf
                else:
                    wanted[name, rank] = _Bracket(finite, rank - low, n - low - high - nan, name=name)
    while wide := [b for b in wanted.values() if b.value is None and b.inside > bracket_rows]:
        _narrow(df, wide, accuracy)
    _pick(df, [b for b in wanted.values() if b.value is None])
    fixed |= {key: b.value for key, b in wanted.items()}
    return {
        name: [_between(fixed, name, q * (counts[4 * i] - 1)) if counts[4 * i] else None for q in qs]
        for i, (name, (_, qs)) in enumerate(columns.items())
    }


def _between(values: dict[tuple[str, int], float], name: str, at: float) -> float:
    """The value at a fractional rank."""
    first, last = math.floor(at), math.ceil(at)
    a, b = values[name, first], values[name, last]
    return a if first == last or a == b else (last - at) * a + (at - first) * b


def _shared(brackets: list[_Bracket]) -> list[list[_Bracket]]:
    """Brackets that are one interval of one column, together: a row meets the interval once, however many ranks lie in it."""
    groups: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        groups.setdefault((b.name, b.low, b.high), []).append(b)
    return list(groups.values())


def _narrow(df: DataFrame, brackets: list[_Bracket], accuracy: int) -> None:
    """Shrink each bracket to the sketch's neighbourhood of its ranks, then count to check it; one sketch per interval serves all its ranks."""
    slack = 2.0 / accuracy
    groups = _shared(brackets)
    brackets = [b for some in groups for b in some]

    def ends(b: _Bracket) -> list[float]:
        return [max(0.0, (b.rank - b.below) / b.inside - slack), min(1.0, (b.rank - b.below + 1) / b.inside + slack)]

    found = df.agg(
        *[
            F.percentile_approx(F.when(some[0].member(), some[0].column), [p for b in some for p in ends(b)], accuracy).alias(f"s{i}")
            for i, some in enumerate(groups)
        ]
    ).first()
    sketch = [(found[i][2 * k], found[i][2 * k + 1]) for i, some in enumerate(groups) for k in range(len(some))]
    counts = df.agg(
        *[
            c
            for i, b in enumerate(brackets)
            for c in (
                F.count_if(b.column < sketch[i][0]).alias(f"b{i}"),
                F.count_if(b.column.between(sketch[i][0], sketch[i][1])).alias(f"i{i}"),
            )
        ]
    ).first()
    for i, b in enumerate(brackets):
        below, inside = counts[2 * i], counts[2 * i + 1]
        if below <= b.rank < below + inside and inside < b.inside:
            (b.low, b.high), b.below, b.inside = sketch[i], below, inside
            if b.low == b.high:
                b.value = float(b.low)
        else:
            _halve(df, b)


def _halve(df: DataFrame, b: _Bracket) -> None:
    """Fallback where the sketch did not help: find the order statistic by bisection on values.

    Every step is one count and moves an end of the interval to another value of the column; the interval's width halves or it is left
    with one value, so that the doubles' range bounds the number of steps.
    """
    ends = df.where(b.member()).agg(F.min(b.column), F.max(b.column)).first()
    low, high = float(ends[0]), float(ends[1])
    while low < high:
        middle = low / 2 + high / 2
        if not low <= middle < high:  # neighbours
            middle = low
        row = df.agg(
            F.count_if(b.column <= middle),
            F.max(F.when(b.column <= middle, b.column)),
            F.min(F.when(b.column > middle, b.column)),
        ).first()
        if row[0] > b.rank:
            high = float(row[1])
        else:
            low = float(row[2])
    b.value = low


def _pick(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Value at each bracket's rank, from running counts over the distinct values of each interval.

    All intervals share one pass and all ranks of an interval its running count; each holds few rows by now and is sorted on its own.
    """
    if not brackets:
        return
    groups = _shared(brackets)
    cells = F.array(
        *[F.struct(F.lit(i).alias("b"), F.when(some[0].member(), some[0].column).alias("v")) for i, some in enumerate(groups)]
    )
    counts = (
        df.select(F.inline(cells)).where(F.col("v").isNotNull())
        .groupBy("b", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("upto", F.sum("n").over(order))

    def rank(k: int) -> Column:
        """The k-th rank of an interval, counted inside it; null where it has fewer."""
        inside = [F.lit(some[k].rank - some[k].below if k < len(some) else None).cast("long") for some in groups]
        return F.get(F.array(*inside), F.col("b"))

    most = max(len(some) for some in groups)
    found = running.groupBy("b").agg(*[F.min(F.when(F.col("upto") > rank(k), F.col("v"))).alias(f"v{k}") for k in range(most)])
    for r in found.collect():
        for k, b in enumerate(groups[r["b"]]):
            b.value = float(r[f"v{k}"])


def medians(df: DataFrame, columns: Sequence[str], **options) -> dict[str, float | None]:
    """Exact median of each column, nulls skipped."""
    found = exact_quantiles(df, {c: (c, [0.5]) for c in columns}, **options)
    return {c: v[0] for c, v in found.items()}
