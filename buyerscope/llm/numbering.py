"""Gapless numbers over a whole table in a given order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buyerscope.llm.common import free_names
from buyerscope.storage import write_once

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row of the partition below


def number_rows(df: DataFrame, order: list[Column], number: str) -> DataFrame:
    """``df`` with ``number``: 0, 1, 2, ... in ``order`` over all rows.

    Rows are dealt to ranges of the order, sorted there, and written; every range starts at the count of the ranges before it.
    Rows that are equal in ``order`` may lie in several ranges and their numbers are interchangeable. An empty table stays empty.
    """
    tie, place, part, rows, start = free_names(df, "number_tie", "number_place", "number_part", "number_rows", "number_start")
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    ranges = tied.repartitionByRange(*order, F.col(tie)).sortWithinPartitions(*order, tie)
    placed = write_once(ranges.drop(tie).withColumn(place, F.monotonically_increasing_id()), "numbered")
    counts = placed.groupBy(F.shiftright(place, _ROW_BITS).alias(part)).agg(F.count("*").alias(rows))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = counts.select(part, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(start))
    numbered = placed.withColumn(part, F.shiftright(place, _ROW_BITS)).join(starts, part)
    return numbered.withColumn(number, F.col(start) + F.col(place).bitwiseAND((1 << _ROW_BITS) - 1)).drop(part, place, start)
