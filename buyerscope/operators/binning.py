"""Right-closed binning by fixed or fitted edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope.functions.expressions import col
from buyerscope.operators.quantiles import exact_quantiles


def cut_index(c: str | Column, edges: Sequence[float], clamp: bool = False, include_lowest: bool = False) -> Column:
    """Index of the bin (edge i, edge i+1] that holds the value; outside is null.

    ``clamp`` puts values outside into the first or last bin instead.
    """
    c = col(c).cast("double")
    inner = edges[1:-1]
    index = F.lit(0)
    for edge in inner:
        index = index + (c > F.lit(float(edge))).cast("int")
    if clamp:
        return F.when(c.isNotNull(), index)
    low = c >= F.lit(float(edges[0])) if include_lowest else c > F.lit(float(edges[0]))
    return F.when(low & (c <= F.lit(float(edges[-1]))), index)


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str], **options) -> Column:
    """Label of the bin that holds the value; outside is null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin")
    return label_at(cut_index(c, edges, **options), labels)


def label_at(index: Column, labels: Sequence[str]) -> Column:
    """The label at a 0-based index; null stays null."""
    out = F
    for i, name in enumerate(labels):
        out = out.when(index == i, name)
    return out


def quantile_edges(
    df: DataFrame,
    wanted: dict[str, tuple[Column | str, int, bool]],
    **options,
) -> dict[str, list[float]]:
    """Edges of equal-frequency bins: {name: (column, bins, drop_duplicates)}.

    Equal edges are merged when ``drop_duplicates`` is set, else they are an error.
    """
    return merged_edges(exact_quantiles(df, edge_specs(wanted), **options), wanted)


def edge_specs(wanted: dict[str, tuple[Column | str, int, bool]]) -> dict[str, tuple[Column | str, list[float]]]:
    """Quantiles that equal-frequency bins need."""
    return {n: (c, [i / q for i in range(q + 1)]) for n, (c, q, _) in wanted.items()}


def merged_edges(
    found: dict[str, list[float | None]], wanted: dict[str, tuple[Column | str, int, bool]]
) -> dict[str, list[float]]:
    """Bin edges from quantiles, equal ones merged where that is allowed."""
    out = {}
    for name, (_, _, drop) in wanted.items():
        edges = found[name]
        if edges[0] is None:
            raise ValueError(f"{name}: no values to bin")
        unique = sorted(set(edges))
        if len(unique) < len(edges) and not drop:
            raise ValueError(f"{name}: bin edges must be unique: {edges}")
        out[name] = unique
    return out


def equal_width_bin(c: str | Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of ``bins`` equal parts of [low, high]; the last bin is closed."""
    c = col(c).cast("double")
    if high == low:
        # One value: the range is widened by a half on both sides.
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    return F.when(
        c.isNotNull(),
        F.least(F.floor((c - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int"),
    )
