"""Evaluation of score tables: (key, label 0/1, p[, fold][, model]).

``by`` names grouping columns (fold, model, weight, ...); every function works per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buyerscope.operators.binning import equal_width_bin
from buyerscope.operators.ranking import ROWS_PER_RANGE, running_counts

# Thresholds of the standard sweep and of the dense F1 sweep.
SWEEP = [0.1 + i * 0.05 for i in range(18)]
DENSE_SWEEP = [0.1 + i * (0.8 / 99) for i in range(99)] + [0.9]
SWEEP_METRICS = ["accuracy", "balanced_accuracy", "f1"]


def predicted(p: str | Column, threshold: float = 0.5) -> Column:
    """1 where the score reaches the threshold."""
    p = F.col(p) if isinstance(p, str) else p
    return (p >= F.lit(threshold)).cast("int")


def _div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _total(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def cell_counts(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn per group."""
    hit, truth = F.col("p") >= F.lit(threshold), F.col("label") == 1
    return _total(
        scores,
        by,
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & truth).alias("fn"),
        F.count_if(~hit & ~truth).alias("tn"),
    )


def rates() -> dict[str, Column]:
    """Classification metrics from the columns tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    recall, specificity = _div(tp, tp + fn), _div(tn, tn + fp)
    # A class that does not occur does not count towards the balanced accuracy.
    classes = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    expected = _div((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    observed = _div(tp + tn, n)
    return {
        "accuracy": observed,
        "balanced_accuracy": _div(recall + specificity, classes),
        "precision": _div(tp, tp + fp),
        "recall": recall,
        "f1": _div(2 * tp, 2 * tp + fp + fn),
        "cohen_kappa": _div(observed - expected, F.lit(1.0) - expected),
    }


def confusion_matrix(
    scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), normalize: bool = False
) -> DataFrame:
    """All four (label, prediction) cells; ``normalize`` adds the share of the label's rows."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    row = {0: F.col("tn") + F.col("fp"), 1: F.col("fn") + F.col("tp")}
    items = []
    for label, pred, name in cells:
        fields = [F.lit(label).alias("label"), F.lit(pred).alias("prediction"), F.col(name).alias("n")]
        if normalize:
            fields.append(_div(F.col(name), row[label]).alias("share"))
        items.append(F.struct(*fields))
    return cell_counts(scores, threshold, by).select(*by, F.inline(F.array(*items)))


def rank_metrics(
    scores: DataFrame, by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """roc_auc (ties count half) and average_precision per group; null with one class only."""
    steps = running_counts(scores, by, rows_per_range=rows_per_range)
    pos, neg, tp = (F.col(c).cast("double") for c in ("pos", "neg", "tp"))
    n_pos, n_neg = F.max("n_pos").cast("double"), F.max("n_neg").cast("double")
    area = F.sum(neg * (tp - pos / 2))
    precision = tp / (F.col("tp") + F.col("fp"))
    both = (n_pos > 0) & (n_neg > 0)
    return _total(
        steps,
        by,
        F.when(both, F.try_divide(area, n_pos * n_neg)).alias("roc_auc"),
        F.try_divide(F.sum(pos * precision), n_pos).alias("average_precision"),
    )


def roc_auc(scores: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    return rank_metrics(scores, by, **options).select(*by, "roc_auc")


def binary_metrics(
    scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), **options
) -> DataFrame:
    """All threshold and ranking metrics, one row per group."""
    at_threshold = cell_counts(scores, threshold, by).select(
        *by, *[c.alias(n) for n, c in rates().items()]
    )
    ranking = rank_metrics(scores, by, **options)
    # One row per group on either side; without groups the ranking is a one-row subquery.
    if by:
        return at_threshold.join(ranking, list(by))
    return _beside(at_threshold, ranking)


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of the one-row frame ``right`` added to ``left``."""
    row = right.select(F.struct(*right.columns)).scalar()
    return left.withColumn("_row", row).select(*left.columns, "_row.*")


def roc_curve(scores: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """(threshold, fpr, tpr), highest threshold first; (null, 0, 0) starts the curve."""
    steps = running_counts(scores, by, **options)
    points = steps.select(
        *by,
        F.col("p").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )
    origin = (scores.select(*by).distinct() if by else scores.select().limit(1)).select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return origin.unionByName(points)


def pr_curve(scores: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """(threshold, precision, recall, baseline); (null, 1, 0) ends the curve."""
    steps = running_counts(scores, by, **options)
    total = F.col("n_pos") + F.col("n_neg")
    points = steps.select(
        *by,
        F.col("p").alias("threshold"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("n_pos")), F.lit(1.0)).alias("recall"),
        F.try_divide(F.col("n_pos"), total).alias("baseline"),
    )
    rate = F.avg((F.col("label") == 1).cast("double")).alias("baseline")
    end = _total(scores.where(F.col("p").isNotNull()), by, rate).select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        "baseline",
    )
    return points.unionByName(end)


def curve_areas(scores: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """Trapezoid areas under both curves.

    The step before a score is its own running count without the rows at that score, so the
    trapezoids need no second window.
    """
    steps = running_counts(scores, by, **options)
    tp, fp, pos, neg, n_pos, n_neg = (
        F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg", "n_pos", "n_neg")
    )
    roc = F.sum(neg / n_neg * (tp + (tp - pos)) / 2 / n_pos)
    rows_before = tp + fp - pos - neg
    before = F.when(rows_before > 0, (tp - pos) / F.greatest(rows_before, F.lit(1.0))).otherwise(1.0)
    pr = F.sum(pos / n_pos * (tp / (tp + fp) + before) / 2)
    return _total(
        steps.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0)),
        by, roc.alias("roc_area"), pr.alias("pr_area"),
    )


def calibration_curve(scores: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(bin, n, mean_predicted, fraction_positive) for the nonempty right-closed bins of [0, 1]."""
    index = F.greatest(F.ceil(F.col("p") * F.lit(bins)) - 1, F.lit(0)).cast("int")
    return (
        scores.groupBy(*by, index.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("p").alias("mean_predicted"),
            F.avg((F.col("label") == 1).cast("double")).alias("fraction_positive"),
        )
    )


def classification_report(
    scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """(name, precision, recall, f1, support) for both classes and their averages."""
    cells = cell_counts(scores, threshold, by)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    per_class = {
        "0": (_div(tn, tn + fn), _div(tn, tn + fp), _div(2 * tn, 2 * tn + fp + fn), tn + fp),
        "1": (_div(tp, tp + fp), _div(tp, tp + fn), _div(2 * tp, 2 * tp + fp + fn), tp + fn),
    }
    n = tp + fp + fn + tn
    low, high = per_class["0"], per_class["1"]
    accuracy = _div(tp + tn, n)
    rows = {
        **per_class,
        "accuracy": (accuracy, accuracy, accuracy, n),
        "macro avg": (*[(low[i] + high[i]) / 2 for i in range(3)], n),
        "weighted avg": (*[_div(low[i] * low[3] + high[i] * high[3], n) for i in range(3)], n),
    }
    items = [
        F.struct(
            F.lit(name).alias("name"),
            *[c.alias(f) for c, f in zip(values[:3], ("precision", "recall", "f1"))],
            values[3].cast("bigint").alias("support"),
        )
        for name, values in rows.items()
    ]
    return cells.select(*by, F.inline(F.array(*items)))


def threshold_counts(scores: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn at each threshold.

    Each row is placed once, by how many thresholds its score reaches, so the table is
    aggregated to one row per step before anything is compared with the grid.
    """
    grid = sorted(float(t) for t in thresholds)
    reached = F.lit(0)
    for t in grid:
        reached = reached + (F.col("p") >= F.lit(t)).cast("int")
    steps = (
        scores.where(F.col("p").isNotNull())
        .groupBy(*by, reached.alias("reached"))
        .agg(
            F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
        )
    )
    index = F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "threshold")
    hit = F.col("reached") > F.col("i")
    return (
        steps.select(*by, "reached", "pos", "neg", index)
        .groupBy(*by, "threshold")
        .agg(
            *[
                F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).alias(name)
                for name, c, test in (
                    ("tp", "pos", hit), ("fp", "neg", hit), ("fn", "pos", ~hit), ("tn", "neg", ~hit),
                )
            ]
        )
    )


def threshold_sweep(
    scores: DataFrame, thresholds: Sequence[float] = SWEEP, by: Sequence[str] = ()
) -> DataFrame:
    """(threshold, accuracy, balanced_accuracy, precision, recall, f1)."""
    kept = ["accuracy", "balanced_accuracy", "precision", "recall", "f1"]
    found = rates()
    return threshold_counts(scores, thresholds, by).select(
        *by, "threshold", *[found[m].alias(m) for m in kept]
    )


def f1_sweep(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 over 100 thresholds."""
    return threshold_sweep(scores, DENSE_SWEEP, by).select(*by, "threshold", "f1")


def best_thresholds(sweep: DataFrame, metrics: Sequence[str] = SWEEP_METRICS, by: Sequence[str] = ()) -> DataFrame:
    """(metric, threshold, value): the lowest threshold with the highest value."""
    best = [
        F.max_by(F.struct(F.col("threshold"), F.col(m).alias("value")), F.struct(F.col(m), -F.col("threshold"))).alias(m)
        for m in metrics
    ]
    items = [
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}.threshold").alias("threshold"), F.col(f"{m}.value").alias("value"))
        for m in metrics
    ]
    return _total(sweep, by, *best).select(*by, F.inline(F.array(*items)))


def fold_thresholds(
    scores: DataFrame, metric: str = "f1", fold: str = "fold", **options
) -> DataFrame:
    """Per fold the score that maximizes the metric as a threshold (lowest on ties)."""
    steps = running_counts(scores, [fold], **options)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pos")), F.lit(1.0))
    value = {
        "f1": 2 * (precision * recall) / (precision + recall + F.lit(1e-8)),
        "precision": precision,
        "recall": recall,
        "geometric_mean": F.sqrt(precision * recall),
    }[metric]
    return (
        steps.withColumn("value", value)
        .groupBy(fold)
        .agg(F.max_by("p", F.struct(F.col("value"), -F.col("p"))).alias("threshold"), F.max("value").alias("value"))
    )


def cv_threshold(scores: DataFrame, metric: str = "f1", fold: str = "fold", **options) -> DataFrame:
    """(threshold): the folds' best thresholds averaged."""
    return fold_thresholds(scores, metric, fold, **options).agg(F.avg("threshold").alias("threshold"))


def fold_scores(scores: DataFrame, scoring: str = "roc_auc", fold: str = "fold", **options) -> DataFrame:
    """(fold, score) for roc_auc, average_precision or f1."""
    if scoring in ("roc_auc", "average_precision"):
        found = rank_metrics(scores, [fold], **options)
    else:
        found = cell_counts(scores, by=[fold]).select(fold, rates()[scoring].alias(scoring))
    return found.select(fold, F.col(scoring).alias("score"))


def score_spread(folds: DataFrame) -> DataFrame:
    """(mean, std): average and population deviation of the fold scores."""
    return folds.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def score_histogram(scores: DataFrame, bins: int = 20, by: Sequence[str] = ("label",)) -> DataFrame:
    """Histogram of scores per actual class, with the class's own range."""
    ranges = scores.groupBy(*by).agg(F.min("p").alias("lo"), F.max("p").alias("hi")).collect()
    cases = F
    for r in ranges:
        test = F.lit(True)
        for b in by:
            test = test & F.col(b).eqNullSafe(F.lit(r[b]))
        cases = cases.when(test, equal_width_bin("p", r["lo"], r["hi"], bins))
    if not ranges:
        return scores.select(*by, F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    return scores.groupBy(*by, cases.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def prediction_summary(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(n, positives, positive_rate, min_p, max_p, mean_p)."""
    hit = F.col("p") >= F.lit(threshold)
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("positives"),
        F.avg(hit.cast("double")).alias("positive_rate"),
        F.min("p").alias("min_p"),
        F.max("p").alias("max_p"),
        F.avg("p").alias("mean_p"),
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, balanced, scale_pos_weight, fixed).

    ``balanced`` is n / (2 n_c); ``scale_pos_weight`` is n_0 / n_1 for class 1 and 1 for
    class 0; ``fixed`` is the constant 0.61 / 0.39 for class 1.
    """
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    zeros = F.sum(F.when(F.col("label") == 0, F.col("n"))).over(every)
    positive = F.col("label") == 1
    return counts.select(
        "label",
        "n",
        (F.sum("n").over(every) / (2 * F.col("n"))).alias("balanced"),
        F.when(positive, zeros / F.col("n")).otherwise(1.0).alias("scale_pos_weight"),
        F.when(positive, F.lit(0.61 / 0.39)).otherwise(1.0).alias("fixed"),
    )


def evaluation_summary(
    test: DataFrame, out_of_fold: DataFrame | None = None, model: str = "model", **options
) -> DataFrame:
    """One row: test metrics, cross-validated accuracy, F1 and AUC, best F1 threshold."""
    kept = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "average_precision"]
    row = binary_metrics(test, **options).select(F.lit(model).alias("model"), *kept)
    if out_of_fold is not None:
        row = _beside(row, cv_metrics(out_of_fold, **options).select("cv_accuracy", "cv_f1", "cv_roc_auc"))
    best = best_thresholds(threshold_sweep(test), ["f1"])
    return _beside(row, best.select(F.col("threshold").alias("optimal_f1_threshold")))


def cv_metrics(out_of_fold: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Metrics over all out-of-fold rows together, prefixed ``cv_``."""
    found = binary_metrics(out_of_fold, threshold, **options)
    return found.select(*[F.col(c).alias(f"cv_{c}") for c in found.columns])
