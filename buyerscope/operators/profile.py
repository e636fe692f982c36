"""Tables of the exploratory analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope import schema as S
from buyerscope.functions.expressions import quoted
from buyerscope.operators.binning import equal_width_bin
from buyerscope.operators.cleaning import numeric_columns
from buyerscope.operators.quality import wide_to_rows
from buyerscope.operators.quantiles import exact_quantiles

PURCHASE_LABELS = {0: "No Purchase", 1: "Purchase"}


def purchase_name(label: str) -> Column:
    return F.when(F.col(label) == 0, PURCHASE_LABELS[0]).when(F.col(label) == 1, PURCHASE_LABELS[1])


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    """(column, type)."""
    pairs = [F.struct(F.lit(n).alias("column"), F.lit(t).alias("type")) for n, t in df.dtypes]
    return df.sparkSession.range(1).select(F.inline(F.array(*pairs)))


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(column, value as text, keep...): one row per row and column, so several columns share one pass."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells)), *keep)


def value_counts(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """(column, value, n, ratio, percentage) of one or several columns."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    counts = long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumns({"ratio": F.col("n") / total, "percentage": F.col("n") * 100 / total})


def describe(df: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) with exact quartiles."""
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, {c: (quoted(c), [0.25, 0.5, 0.75]) for c in columns}, **options)
    moments = df.agg(
        *[
            F.struct(
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            ).alias(f"m{i}")
            for i, x in enumerate(F.col(quoted(c)).cast("double") for c in columns)
        ]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"m{i}.{f}").alias(f) for f in ("count", "mean", "std", "min")],
            *[F.lit(q).cast("double").alias(n) for n, q in zip(("q25", "q50", "q75"), quartiles[c])],
            F.col(f"m{i}.max").alias("max"),
        )
        for i, c in enumerate(columns)
    ]
    return moments.select(F.inline(F.array(*rows)))


def target_rate(df: DataFrame, column: str, label: str = S.LABEL) -> DataFrame:
    """(value, n, rate): mean label per value, highest first."""
    return (
        df.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"))
        .orderBy(F.desc("rate"), "value")
    )


def crosstab(
    df: DataFrame, columns: str | Sequence[str], label: str = S.LABEL, classes: Sequence[int] = (0, 1)
) -> DataFrame:
    """(column, value, n, share_<class>...): label shares within each value of one or several columns."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    counts = long_values(df, columns, [F.col(label).alias("_label")]).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_label") == c).alias(f"_c{c}") for c in classes]
    )
    return counts.select(
        "column", "value", "n", *[(F.col(f"_c{c}") / F.col("n")).alias(f"share_{c}") for c in classes]
    )


def group_size(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def composition(df: DataFrame, columns: Sequence[str], strip: Sequence[str] = ("Mnt", "Products")) -> DataFrame:
    """(category, total, percentage) of column totals."""
    totals = df.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in columns])
    everything = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))
    rows = [
        F.struct(
            F.lit(strip_name(c, strip)).alias("category"),
            F.col(c).alias("total"),
            F.try_divide(F.col(c) * 100.0, everything).alias("percentage"),
        )
        for c in columns
    ]
    return totals.select(F.inline(F.array(*rows)))


def strip_name(name: str, parts: Sequence[str]) -> str:
    for part in parts:
        name = name.replace(part, "")
    return name


def campaign_rates(df: DataFrame, campaigns: Sequence[str] = S.CAMPAIGNS) -> DataFrame:
    """(Campaign, Acceptance_Rate)."""
    means = df.agg(*[F.avg(c).alias(c) for c in campaigns])
    return wide_to_rows(means, list(campaigns), "Acceptance_Rate").select(
        F.regexp_replace("column", "AcceptedCmp", "Campaign ").alias("Campaign"), "Acceptance_Rate"
    )


def means_by_label(
    df: DataFrame, columns: Sequence[str], label: str = S.LABEL, name: str = "column", value: str = "mean"
) -> DataFrame:
    """(name, Purchase, value): mean of each column per class."""
    means = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns]
    return means.select(purchase_name(label).alias("Purchase"), F.inline(F.array(*pairs))).select(
        name, "Purchase", value
    )


def campaign_by_label(df: DataFrame, campaigns: Sequence[str] = S.CAMPAIGNS, label: str = S.LABEL) -> DataFrame:
    rows = means_by_label(df, campaigns, label, "Campaign", "Acceptance_Rate")
    return rows.withColumn("Campaign", F.regexp_replace("Campaign", "AcceptedCmp", "Campaign "))


def channel_by_label(
    df: DataFrame,
    columns: Sequence[str] = ("WebProportion", "CatalogProportion", "StoreProportion"),
    label: str = S.LABEL,
) -> DataFrame:
    rows = means_by_label(df, columns, label, "Channel", "Proportion")
    return rows.withColumn("Channel", F.replace("Channel", F.lit("Proportion"), F.lit("")))


def melt_spend(df: DataFrame, columns: Sequence[str] = S.SPEND, label: str = S.LABEL) -> DataFrame:
    """(label, Category, Amount): one row per customer and category."""
    long = df.select(label, *columns).unpivot([label], list(columns), "Category", "Amount")
    return long.withColumn("Category", F.regexp_replace("Category", "Mnt|Products", ""))


def histogram(
    df: DataFrame, columns: Sequence[str], bins: int = 20, label: str | None = None
) -> DataFrame:
    """(column[, label], bin, lower, upper, n): equal-width bins over each column's range."""
    ends = df.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)]).first()
    items, kept = [], []
    for i, c in enumerate(columns):
        low, high = ends[2 * i], ends[2 * i + 1]
        if low is None:
            continue
        kept.append((c, low, high) if high > low else (c, low - 0.5, high + 0.5))
        items.append(F.struct(F.lit(c).alias("column"), equal_width_bin(c, low, high, bins).alias("bin")))
    by = ["column", *([label] if label else []), "bin"]
    counts = (
        df.select(*([label] if label else []), F.inline(F.array(*items)))
        .where(F.col("bin").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    )
    low, width = F, F
    for c, lo, hi in kept:
        low = low.when(F.col("column") == c, F.lit(lo))
        width = width.when(F.col("column") == c, F.lit((hi - lo) / bins))
    return counts.select(
        *by, (low + F.col("bin") * width).alias("lower"), (low + (F.col("bin") + 1) * width).alias("upper"), "n"
    )


def density(
    df: DataFrame, column: str, points: int = 200, label: str | None = None, bandwidth: float | None = None
) -> DataFrame:
    """([label,] x, density): Gaussian kernel estimate on an even grid over the column's range.

    The default bandwidth is the sample deviation times n ** (-1/5), per class. Every row adds to the fixed grid inside its own
    task; only one row per grid point and class leaves a task.
    """
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(*([label] if label else []), x.alias("x"))
    ends = rows.agg(F.min("x"), F.max("x")).first()
    group = [label] if label else []
    stats = (rows.groupBy(*group) if group else rows.groupBy()).agg(
        F.count("x").alias("n"), F.stddev_samp("x").alias("s")
    ).collect()
    low, high = ends
    if low is None:
        return rows.select(*group, "x", F.lit(0.0).alias("density")).limit(0)
    step = (high - low) / (points - 1)
    width, size = F, F
    for r in stats:
        test = F.col(label).eqNullSafe(F.lit(r[label])) if label else F.lit(True)
        h = bandwidth or (r["s"] or 0.0) * r["n"] ** -0.2
        width = width.when(test, F.lit(h if h > 0 else 1.0))
        size = size.when(test, F.lit(float(r["n"])))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    at = F.lit(low) + F.col("i") * F.lit(step)
    z = (at - F.col("x")) / width
    kernel = F.exp(-z * z / 2) / (width * F.lit((2 * 3.141592653589793) ** 0.5) * size)
    return (
        rows.select(*group, "x", grid)
        .groupBy(*group, "i")
        .agg(F.sum(kernel).alias("density"))
        .select(*group, at.alias("x"), "density")
    )


def boxplot(
    df: DataFrame, columns: Sequence[str], label: str = S.LABEL, classes: Sequence[int] = (0, 1), **options
) -> DataFrame:
    """(column, label, n, q1, median, q3, low_whisker, high_whisker, n_outliers) per class.

    Whiskers are the outermost values within 1.5 interquartile ranges of the box.
    """
    cells = [(c, k) for c in columns for k in classes]
    value = {(c, k): F.when(F.col(label) == k, F.col(c).cast("double")) for c, k in cells}
    found = exact_quantiles(
        df, {f"{c}|{k}": (value[c, k], [0.25, 0.5, 0.75]) for c, k in cells}, **options
    )
    aggregates, rows = [], []
    for i, (c, k) in enumerate(cells):
        q1, q2, q3 = found[f"{c}|{k}"]
        if q1 is None:
            continue
        reach = 1.5 * (q3 - q1)
        x = value[c, k]
        inside = x.between(q1 - reach, q3 + reach)
        aggregates.append(
            F.struct(
                F.count(x).alias("n"),
                F.min(F.when(inside, x)).alias("lo"),
                F.max(F.when(inside, x)).alias("hi"),
                F.count_if(~inside).alias("out"),
            ).alias(f"b{i}")
        )
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(k).alias("label"),
                F.col(f"b{i}.n").alias("n"),
                F.lit(q1).alias("q1"),
                F.lit(q2).alias("median"),
                F.lit(q3).alias("q3"),
                F.col(f"b{i}.lo").alias("low_whisker"),
                F.col(f"b{i}.hi").alias("high_whisker"),
                F.col(f"b{i}.out").alias("n_outliers"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column): numeric columns with at most one value."""
    columns = list(columns or numeric_columns(df))
    ends = df.agg(
        *[(F.min(quoted(c)).eqNullSafe(F.max(quoted(c)))).alias(c) for c in columns]
    )
    return wide_to_rows(ends, columns, "constant").where("constant").select("column")


def top_values(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """The n rows with the highest value; equal values in the order of ``tie``."""
    return df.orderBy(F.desc(value), tie).limit(n)


def best_row(df: DataFrame, value: str, tie: str) -> DataFrame:
    """The row with the highest value, the lowest ``tie`` on equal values."""
    return df.agg(
        F.min_by(F.struct(*df.columns), F.struct(-F.col(value), F.col(tie))).alias("best")
    ).select("best.*")
