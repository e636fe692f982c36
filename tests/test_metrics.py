import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from buyerscope.operators import metrics as M
from buyerscope.operators import ranking
from buyerscope.operators.ranking import running_counts


def score_frame(spark, labels, p, **extra):
    return spark.createDataFrame(pd.DataFrame({"key": range(len(p)), "label": labels, "p": p, **extra}))


def brute_auc(labels, p):
    pos, neg = p[labels == 1], p[labels == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    labels = (rng.uniform(size=300) < 0.3).astype(int)
    p = np.round(np.clip(rng.normal(0.3 + 0.3 * labels, 0.2), 0, 1), 2)
    return labels, p


def test_auc_and_average_precision(spark, sample):
    labels, p = sample
    df = score_frame(spark, labels, p)
    got = M.rank_metrics(df).first()
    assert got["roc_auc"] == pytest.approx(brute_auc(labels, p))
    order = sorted(set(p), reverse=True)
    recall, ap = 0.0, 0.0
    for t in order:
        hit = p >= t
        r = labels[hit].sum() / labels.sum()
        ap += (r - recall) * labels[hit].mean()
        recall = r
    assert got["average_precision"] == pytest.approx(ap)
    spark_auc = BinaryClassificationEvaluator(rawPredictionCol="p", numBins=0).evaluate(df)
    assert got["roc_auc"] == pytest.approx(spark_auc)
    assert M.curve_areas(df).first()["roc_area"] == pytest.approx(spark_auc)


def test_ranges_give_the_same_running_counts(spark, sample):
    labels, p = sample
    df = score_frame(spark, labels, p, fold=np.arange(len(p)) % 3)
    def table(**o):
        return sorted(tuple(r) for r in running_counts(df, ["fold"], **o).select("fold", "p", "tp", "fp", "n_pos", "n_neg").collect())
    assert table(rows_per_range=25) == table()


@pytest.mark.parametrize("by", [[], ["fold"]])
def test_ranges_of_ranges_give_the_same_running_counts(spark, monkeypatch, by):
    """Ranges of about ten rows, three at a time, in several levels; a third of the rows share one score, and a group has no name."""
    rng = np.random.default_rng(6)
    p = np.where(np.arange(700) % 3 == 0, 0.25, rng.uniform(size=700) ** 3)
    labels = (rng.uniform(size=700) < p).astype(int)
    df = score_frame(spark, labels, p, fold=np.arange(700) % 2).withColumn("fold", F.when(F.col("fold") == 1, 1))
    monkeypatch.setattr(ranking, "FAN", 3)
    tied = df.groupBy(*by, "p").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    placed, path = ranking._with_ranges(tied, "p", ranking.score_edges(df, "p", 10), 10)
    assert len(path) >= 3 and placed.count() == tied.count()
    assert placed.groupBy(*path).count().agg(F.max("count")).first()[0] <= 15
    got = [tuple(r) for r in running_counts(df, by, rows_per_range=10).select(*by, "p", "tp", "fp", "n_pos", "n_neg").collect()]
    groups = [r[0] if by else 0 for r in df.select(*(by or ["p"])).collect()]
    frame = [(g if by else 0, r["p"], r["label"]) for g, r in zip(groups, df.collect(), strict=True)]
    want = set()
    for g, score, _ in frame:
        own = [(s, y) for h, s, y in frame if h == g]
        tp, fp = sum(y == 1 for s, y in own if s >= score), sum(y != 1 for s, y in own if s >= score)
        want.add((*([g] if by else []), score, tp, fp, sum(y == 1 for _, y in own), sum(y != 1 for _, y in own)))
    assert len(got) == len(want) and set(got) == want


def test_one_hot_score_among_many(spark):
    # A third of the rows share one score.
    rng = np.random.default_rng(2)
    p = np.where(np.arange(900) % 3 == 0, 0.5, rng.uniform(size=900))
    labels = (rng.uniform(size=900) < p).astype(int)
    df = score_frame(spark, labels, p)
    assert M.roc_auc(df, rows_per_range=50).first()[0] == pytest.approx(brute_auc(labels, p))


def test_confusion_and_rates(spark):
    df = score_frame(spark, [1, 1, 0, 0, 0], [0.9, 0.4, 0.5, 0.1, 0.2])
    cells = {(r["label"], r["prediction"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    m = M.binary_metrics(df).first()
    assert m["accuracy"] == 0.6 and m["precision"] == 0.5 and m["recall"] == 0.5 and m["f1"] == 0.5
    assert m["balanced_accuracy"] == pytest.approx((0.5 + 2 / 3) / 2)
    assert m["cohen_kappa"] == pytest.approx((0.6 - 0.52) / 0.48)


def test_edges(spark):
    one_class = M.binary_metrics(score_frame(spark, [0, 0], [0.1, 0.6])).first()
    assert one_class["roc_auc"] is None and one_class["balanced_accuracy"] == 0.5
    none_predicted = M.binary_metrics(score_frame(spark, [1, 0], [0.1, 0.2])).first()
    assert none_predicted["precision"] == 0.0 and none_predicted["f1"] == 0.0
    ends = {r["bin"] for r in M.calibration_curve(score_frame(spark, [1, 0, 1, 0], [0.0, 0.5, 1.0, 0.1])).collect()}
    assert ends == {0, 4, 9}
    assert M.predicted(F.lit(0.5)) is not None


def test_threshold_sweep_matches_direct_metrics(spark, sample):
    labels, p = sample
    df = score_frame(spark, labels, p)
    sweep = {round(r["threshold"], 6): r for r in M.threshold_sweep(df).collect()}
    assert len(sweep) == 18
    for t in M.SWEEP:
        direct = M.rates()
        row = M.cell_counts(df, t).select(*[c.alias(n) for n, c in direct.items()]).first()
        assert sweep[round(t, 6)]["f1"] == pytest.approx(row["f1"])
        assert sweep[round(t, 6)]["balanced_accuracy"] == pytest.approx(row["balanced_accuracy"])
    assert M.f1_sweep(df).count() == 100


def test_best_threshold_prefers_the_lowest(spark):
    df = score_frame(spark, [1, 0], [0.9, 0.05])
    best = {r["metric"]: r["threshold"] for r in M.best_thresholds(M.threshold_sweep(df)).collect()}
    assert best["f1"] == pytest.approx(0.1)


def test_fold_threshold(spark):
    df = score_frame(spark, [1, 0, 1, 0], [0.8, 0.3, 0.6, 0.7], fold=[0, 0, 1, 1])
    got = {r["fold"]: r["threshold"] for r in M.fold_thresholds(df).collect()}
    assert got == {0: 0.8, 1: 0.6}
    assert M.cv_threshold(df).first()[0] == pytest.approx(0.7)


def test_report_and_summary(spark, sample):
    labels, p = sample
    df = score_frame(spark, labels, p, fold=np.arange(len(p)) % 3)
    report = {r["name"]: r for r in M.classification_report(df).collect()}
    assert report["0"]["support"] + report["1"]["support"] == len(p)
    assert report["macro avg"]["f1"] == pytest.approx((report["0"]["f1"] + report["1"]["f1"]) / 2)
    summary = M.evaluation_summary(df, df, "m").first()
    assert summary["model"] == "m" and summary["cv_f1"] == pytest.approx(summary["f1"])
    spread = M.score_spread(M.fold_scores(df)).first()
    assert 0.5 < spread["mean"] < 1 and spread["std"] >= 0
    assert M.roc_curve(df).where("threshold is null").count() == 1
    assert M.pr_curve(df).where("threshold is null").first()["baseline"] == pytest.approx(labels.mean())
    assert sum(r["n"] for r in M.score_histogram(df).collect()) == len(p)


def test_class_weights(spark):
    df = score_frame(spark, [1, 0, 0, 0], [0.1] * 4)
    got = {r["label"]: r for r in M.class_weights(df).collect()}
    assert got[1]["balanced"] == 2.0 and got[1]["scale_pos_weight"] == 3.0 and got[0]["scale_pos_weight"] == 1.0
