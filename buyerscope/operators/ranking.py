"""Running totals over a sorted score, without sorting everything in one task.

Rows are first merged per distinct score. Distinct scores are then cut into ranges, and ranges that are still too large
into ranges of their own, as often as the counts demand. Each range is summed; sums of the ranges before, level by level,
give its starting totals, and the running totals are formed inside the smallest ranges. No task sorts more than a range or
the ranges of one range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buyerscope.storage import write_once

ROWS_PER_RANGE = 1_000_000
FAN = 512  # ranges that one range is cut into, at most; more come from further levels


def score_edges(scores: DataFrame, score: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Cut points that leave about ``rows_per_range`` rows between neighbours; none if few rows."""
    n = scores.count()
    ranges = min(FAN, math.ceil(n / rows_per_range))
    if ranges <= 1:
        return []
    grid = [i / ranges for i in range(1, ranges)]
    found = scores.agg(F.percentile_approx(score, grid, 20 * ranges)).first()[0]
    return sorted(set(found or []))


def _first_ranges(df: DataFrame, score: str, edges: Sequence[float]) -> DataFrame:
    splits = [-math.inf, *edges, math.inf]
    return Bucketizer(splits=splits, inputCol=score, outputCol="_range0").transform(df)


def _place(edges: Column, score: Column) -> Column:
    """How many of the sorted edges the score reaches, by binary search."""
    widest = 1 << max(0, (FAN - 1).bit_length() - 1)
    steps = [widest >> i for i in range(widest.bit_length())]
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: at + F.when(F.get(edges, at + step - 1) <= score, step).otherwise(0),
    )


def _with_ranges(tied: DataFrame, score: str, edges: Sequence[float], rows_per_range: int) -> tuple[DataFrame, list[str]]:
    """Adds one column per level, the path to a row's range; the names of these columns. A range may exceed the wanted size by half."""
    if not edges:
        return tied, []
    path = ["_range0"]
    tied = write_once(_first_ranges(tied, score, edges), "ranges")
    largest = math.inf
    while True:
        size = tied.groupBy(*path).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if size <= 1.5 * rows_per_range or size >= largest:  # groups that share a score cannot be cut
            return tied, path
        largest, cuts = size, min(FAN, math.ceil(size / rows_per_range))
        grid = [i / cuts for i in range(1, cuts)]
        found = F.array_sort(F.array_distinct(F.percentile_approx(score, grid, 20 * cuts)))
        inner = tied.groupBy(*path).agg(found.alias("_edges"))
        level = f"_range{len(path)}"
        tied = write_once(tied.join(inner, path).withColumn(level, _place(F.col("_edges"), F.col(score)).cast("double")).drop("_edges"), "ranges")
        path.append(level)


def _starts(tied: DataFrame, by: Sequence[str], path: Sequence[str]) -> DataFrame:
    """Per group and range: rows in all ranges above it, and rows of the group. Sums run over the ranges of one range at a time."""
    sums = tied.groupBy(*by, *path).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    keys = [*by, *path]
    found = None
    for level in range(len(path), 0, -1):
        parent, own = [*by, *path[: level - 1]], path[level - 1]
        group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        above = group.orderBy(F.desc(own)).rowsBetween(Window.unboundedPreceding, -1)
        levels = sums.groupBy(*parent, own).agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
        before = levels.select(
            *[F.col(c).alias(f"_by_{c}") for c in (*parent, own)],
            F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_tp1"),
            F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("_fp1"),
            *([F.sum("_pos").over(group).alias("n_pos"), F.sum("_neg").over(group).alias("n_neg")] if level == 1 else []),
        )
        if found is None:
            found = sums.select(*keys, F.lit(0).cast("long").alias("_tp0"), F.lit(0).cast("long").alias("_fp0"))
        joined = found.join(before, _same([*parent, own]))
        found = joined.select(
            *keys, (F.col("_tp0") + F.col("_tp1")).alias("_tp0"), (F.col("_fp0") + F.col("_fp1")).alias("_fp0"),
            *(["n_pos", "n_neg"] if level == 1 else []),
        )
    return found.withColumnsRenamed({c: f"_by_{c}" for c in keys})


def _same(columns: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return same


def running_counts(
    scores: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "p",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per distinct score and group, highest score first.

    Adds ``pos``/``neg`` (rows at this score), ``tp``/``fp`` (rows at or above it) and
    ``n_pos``/``n_neg`` (rows of the group).
    """
    edges = score_edges(scores, score, rows_per_range)
    tied = scores.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    tied, path = _with_ranges(tied, score, edges, rows_per_range)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    inside = Window.partitionBy(*by, *path) if path else group
    upto = inside.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    if not path:
        return tied.withColumns(
            {
                "tp": F.sum("pos").over(upto),
                "fp": F.sum("neg").over(upto),
                "n_pos": F.sum("pos").over(group),
                "n_neg": F.sum("neg").over(group),
            }
        )
    return (
        tied.withColumns({"_tp": F.sum("pos").over(upto), "_fp": F.sum("neg").over(upto)})
        .join(_starts(tied, by, path), _same([*by, *path]))
        .select(
            *by, score, "pos", "neg",
            (F.col("_tp") + F.col("_tp0")).alias("tp"),
            (F.col("_fp") + F.col("_fp0")).alias("fp"),
            "n_pos", "n_neg",
        )
    )
