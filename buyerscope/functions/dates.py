"""Date parsing, tenure and calendar parts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from buyerscope.functions.expressions import col

# Day-first, in the two spellings that occur in the files.
DEFAULT_FORMATS = ("dd-MM-yyyy", "d/M/yyyy")


def parse_dates(c: str | Column, formats: Sequence[str] = DEFAULT_FORMATS) -> Column:
    """First format that fits wins; text that fits none becomes null."""
    c = col(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def as_of_literal(as_of: str | dt.date) -> Column:
    return F.lit(str(as_of)).cast("date")


def as_of_days(as_of: str | dt.date) -> int:
    """Days from 1970-01-01 to the reference date."""
    return (dt.date.fromisoformat(str(as_of)) - dt.date(1970, 1, 1)).days


def tenure_days(c: str | Column, as_of: str | dt.date) -> Column:
    return F.datediff(as_of_literal(as_of), col(c))


def tenure_months(days: str | Column) -> Column:
    return col(days) / F.lit(30.44)


def tenure_years(days: str | Column) -> Column:
    return col(days) / F.lit(365.25)


def calendar_parts(c: str | Column, prefix: str = "Enroll_") -> dict[str, Column]:
    """Year, month, quarter, day, weekday (Monday 0) and weekend flag."""
    c = col(c)
    weekday = F.weekday(c)
    return {
        f"{prefix}Year": F.year(c),
        f"{prefix}Month": F.month(c),
        f"{prefix}Quarter": F.quarter(c),
        f"{prefix}Day": F.dayofmonth(c),
        f"{prefix}DayOfWeek": weekday,
        f"{prefix}Weekend": F.when(weekday >= 5, 1).otherwise(0),
    }


def month_cycle(c: str | Column, name: str = "EnrollMonth") -> dict[str, Column]:
    """Month as a point on a circle."""
    import math

    angle = F.month(col(c)) * F.lit(2 * math.pi) / F.lit(12)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
