"""End-to-end jobs: prepare, benchmark, train, evaluate, score, report."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerscope import schema as S
from buyerscope.features.core import CoreFeatures, eda_columns
from buyerscope.models.learners import GRIDS, AtThreshold, Learner
from buyerscope.models.selection import importance_table, linear_attribution, top_features
from buyerscope.models.stacking import fit_stack, join_vote, meta_learner
from buyerscope.models.validation import (
    PARALLELISM, SPACES, cross_validated_search, draw_from_space, expand_grid, halving_search, in_parallel, out_of_fold, score_with,
)
from buyerscope.operators import ensemble as E
from buyerscope.operators import metrics as M
from buyerscope.operators import profile as P
from buyerscope.operators import quality as Q
from buyerscope.operators.cleaning import Cleaner
from buyerscope.operators.correlation import correlation_matrix, target_correlations
from buyerscope.operators.smote import oversample_vectors
from buyerscope.operators.splits import stratified_folds, stratified_split
from buyerscope.operators.transform import AssembleNumbers, AssembleNumbersModel
from buyerscope.sources import sinks
from buyerscope.sources.customers import read_dated
from buyerscope.storage import write_once


@dataclass
class Prepared:
    """Fitted cleaning and feature stages, and the training table they give."""

    stages: list[Transformer]
    train: DataFrame

    @property
    def names(self) -> list[str]:
        last = self.stages[-1]
        assert isinstance(last, AssembleNumbersModel)
        return last.feature_names()


def prepare(
    train: DataFrame,
    as_of: str = "2025-04-23",
    feature_stage=None,
    clean: bool = True,
    key: str = S.KEY,
    label: str = S.LABEL,
) -> Prepared:
    """Clean, derive features and assemble vectors; everything is learned from ``train``.

    The result's table has (key, label, features) and is written once for all later fits.
    """
    stages: list[Transformer] = []
    df = train
    if clean:
        stages.append(Cleaner(as_of=as_of).fit(df))
        df = write_once(stages[-1].transform(df), "prepared_clean")
    features = (feature_stage or CoreFeatures(as_of_year=int(as_of[:4]))).fit(df)
    stages.append(features)
    derived = features.transform(df)
    stages.append(AssembleNumbers(skip=[key, label]).fit(derived))
    table = stages[-1].transform(derived).select(
        F.col(key).alias("key"), F.col(label).cast("double").alias("label"), "features"
    )
    return Prepared(stages, write_once(table, "prepared"))


def vectors(prepared: Prepared, df: DataFrame, key: str = S.KEY) -> DataFrame:
    """Other rows through the fitted stages: (key, features)."""
    return PipelineModel(prepared.stages).transform(df).withColumn("key", F.col(key))


def load_and_prepare(
    spark: SparkSession, train_path: str, test_path: str, as_of: str = "2025-04-23"
) -> tuple[Prepared, DataFrame]:
    """Both files through stages fitted on the first: (prepared train, test vectors)."""
    train, test = _read_both(spark, train_path, test_path)
    prepared = prepare(train, as_of)
    return prepared, vectors(prepared, test)


def _read_both(spark: SparkSession, train_path: str, test_path: str) -> tuple[DataFrame, DataFrame]:
    return (
        read_dated(spark, train_path, True, keep_position=True),
        read_dated(spark, test_path, False, keep_position=True),
    )


# --- benchmark ----------------------------------------------------------------------------------


@dataclass
class Benchmark:
    """Model comparison and the model with the best cross-validated score."""

    table: DataFrame
    best_name: str | None
    models: dict[str, PipelineModel] = field(default_factory=dict)
    searches: dict[str, DataFrame] = field(default_factory=dict)


COMPARISON = (
    "Model string, Accuracy double, Precision double, Recall double, F1 double, `ROC AUC` double, "
    "cv_auc double, params string, error string"
)


def benchmark(
    df: DataFrame,
    kinds: Sequence[str] | None = None,
    grids: dict[str, dict[str, Sequence[Any]]] | None = None,
    test_size: float = 0.2,
    folds: int = 5,
    seed: int = 42,
    parallelism: int = PARALLELISM,
) -> Benchmark:
    """Grid-search every model on the training part and report it on the held-out part.

    The winner is chosen by its cross-validated score; the held-out rows only report. A model
    that fails is listed with its error.
    """
    grids = grids or GRIDS
    split = write_once(stratified_split(df, "key", "label", test_size, seed), "split")
    train = write_once(
        stratified_folds(split.where("split = 'train'"), "key", "label", folds, seed), "benchmark_train"
    )
    test = split.where("split = 'test'")
    out = Benchmark(df, None)

    def compare(kind: str) -> tuple:
        base = Learner(kind=kind, name=kind, seed=seed)
        try:
            model, params, table = cross_validated_search(
                train, base, expand_grid(grids[kind]), parallelism=parallelism
            )
            scored = score_with(model, kind, test, ["key", "label"])
            m = M.binary_metrics(write_once(scored, "benchmark_scores")).first()
            cv = table.agg(F.max("mean_auc")).first()[0]
            out.models[kind], out.searches[kind] = model, table
            return kind, m["accuracy"], m["precision"], m["recall"], m["f1"], m["roc_auc"], cv, str(params), None
        except Exception as error:  # noqa: BLE001 - one failing model must not stop the others
            return kind, None, None, None, None, None, None, None, str(error)

    # Searches run side by side: the long last fits of one leave room for the others.
    rows = in_parallel([lambda k=k: compare(k) for k in kinds or list(grids)], parallelism)
    out.models, out.searches = ({r[0]: own[r[0]] for r in rows if r[0] in own} for own in (out.models, out.searches))
    out.table = df.sparkSession.createDataFrame(rows, COMPARISON)
    fine = [r for r in rows if r[6] is not None]
    out.best_name = max(fine, key=lambda r: r[6])[0] if fine else None
    return out


# --- final training --------------------------------------------------------------------------------


# (rows, learner, candidates) -> (best model, its parameters, table of candidates)
Search = Callable[[DataFrame, Learner, list[dict[str, Any]]], tuple[PipelineModel, dict[str, Any], DataFrame]]


@dataclass
class Trained:
    """A scorer over raw rows, its threshold, the features it uses and its out-of-fold scores."""

    scorer: PipelineModel
    threshold: float
    features: list[str]
    scores: DataFrame


def balanced(df: DataFrame, features: str = "features", seed: int = 42) -> DataFrame:
    """Oversampled training rows (key, label, features) with unique keys."""
    flat = df.select("key", "label", vector_to_array(features).alias("v"))
    grown = oversample_vectors(flat, "key", "label", seed=seed)
    return grown.select(
        F.concat_ws("-", F.col("key").cast("string"), F.col("synthetic").cast("string")).alias("key"),
        "label",
        array_to_vector("v").alias(features),
    )


def train_final(
    prepared: Prepared,
    trials: int = 30,
    n_features: int = 50,
    select: bool = True,
    calibrate: bool = True,
    spaces: dict[str, dict[str, Any]] | None = None,
    folds: int = 5,
    seed: int = 42,
    parallelism: int = PARALLELISM,
    search: Search = halving_search,
) -> Trained:
    """Search, select features, oversample, stack, vote and tune the threshold.

    ``search`` finds the parameters of each base among ``trials`` points of its space: adaptively in rungs, or every point in full with
    ``cross_validated_search``.

    The vote is 0.6 stack, 0.2 for each of the first two base models. The threshold comes from
    out-of-fold scores of models trained on oversampled folds; the model that is returned is
    fitted on all rows.
    """
    spaces = spaces or SPACES
    df = write_once(stratified_folds(prepared.train, "key", "label", folds, seed), "final_train")
    # Searches, and later the ensembles of the folds, run side by side: the long last trials of one leave room for the others.
    found = in_parallel(
        [lambda k=k, x=x: search(df, Learner(kind=k, name=k, seed=seed), draw_from_space(x, trials, seed)) for k, x in spaces.items()], parallelism
    )
    best = {kind: params for kind, (_, params, _) in zip(spaces, found)}
    names, stages = prepared.names, list(prepared.stages)
    used = "chosen" if select else "features"
    if select:
        first, params = next(iter(best.items()))
        model = Learner(kind=first, name=first, params=params, seed=seed).fit(df)
        chosen = top_features(linear_attribution(model, df, names), min(n_features, len(names)))
        indices = sorted(names.index(c) for c in chosen)
        stages.append(VectorSlicer(inputCol="features", outputCol=used, indices=indices))
        df = write_once(stages[-1].transform(df).select("key", "label", "fold", used), "final_chosen")
        names = [names[i] for i in indices]
    bases = [Learner(kind=k, name=k, params=p, features=used, seed=seed) for k, p in best.items()]
    meta = meta_learner("logistic_regression", "stack", C=0.1, class_weight="balanced")

    def ensemble(rows: DataFrame) -> PipelineModel:
        grown = write_once(
            stratified_folds(balanced(rows, used, seed), "key", "label", folds, seed, out="_inner"), "balanced"
        )
        stack = fit_stack(grown, bases, meta, "key", "label", "_inner", parallelism)
        return join_vote([stack], ["stack", *list(best)[:2]], [0.6, 0.2, 0.2])

    outside = list(range(folds)) if calibrate else []
    *fold_models, final = in_parallel([lambda f=f: ensemble(df.where(F.col("fold") != f)) for f in outside] + [lambda: ensemble(df)], parallelism + 2)
    if calibrate:
        parts = [score_with(m, "vote", df.where(F.col("fold") == f), ["key", "label", "fold"]) for f, m in zip(outside, fold_models)]
        scores = write_once(reduce(DataFrame.unionByName, parts), "final_scores")
        threshold = float(M.cv_threshold(scores).first()["threshold"])
    else:
        scores, threshold = score_with(final, "vote", df, ["key", "label", "fold"]), 0.5
    scorer = PipelineModel([*stages, final, AtThreshold(name="vote", threshold=threshold)])
    return Trained(scorer, threshold, names, scores)


# --- ensembles chosen on validation rows ---------------------------------------------------------------


@dataclass
class Chosen:
    """A vote chosen on validation rows and refitted on all rows: a scorer over raw rows, its weights and every candidate's area."""

    scorer: PipelineModel
    weights: dict[str, float]
    candidates: DataFrame


def validation_scores(
    df: DataFrame, bases: Sequence[Learner], val_size: float = 0.2, seed: int = 42, parallelism: int = PARALLELISM
) -> DataFrame:
    """(key, label, p_<name>...) of the validation rows; every base is fitted once, on the other rows."""
    split = write_once(stratified_split(df, "key", "label", val_size, seed), "choice_split")
    train, asked = split.where("split = 'train'"), split.where("split = 'test'")
    names = [b.opt("name") for b in bases]
    fitted = in_parallel([lambda b=b: b.fit(train) for b in bases], parallelism)
    scores = [score_with(m, n, asked, ["key", "label"]) for m, n in zip(fitted, names)]
    return write_once(E.side_by_side(reduce(DataFrame.unionByName, scores), names), "choice_scores")


def _refit(
    prepared: Prepared, bases: Sequence[Learner], weights: dict[str, float], candidates: DataFrame, parallelism: int
) -> Chosen:
    """The chosen vote, its members fitted on all rows; a score of one half is class 0."""
    used = [b for b in bases if b.opt("name") in weights]
    fitted = in_parallel([lambda b=b: b.fit(prepared.train) for b in used], parallelism)
    names = [b.opt("name") for b in used]
    vote = join_vote(fitted, names, [weights[n] for n in names])
    scorer = PipelineModel([*prepared.stages, vote, AtThreshold(name="vote", threshold=0.5, strict=True)])
    return Chosen(scorer, weights, candidates)


def choose_subset(
    prepared: Prepared, bases: Sequence[Learner], smallest: int = 2, val_size: float = 0.2, seed: int = 42,
    parallelism: int = PARALLELISM,
) -> Chosen:
    """The equal vote of at least ``smallest`` bases with the highest validation area, the first tried on ties.

    A soft vote is a mean of its members' scores, so all votes share one fit per base.
    """
    names = [b.opt("name") for b in bases]
    scores = validation_scores(prepared.train, bases, val_size, seed, parallelism)
    found = write_once(E.subset_search(scores, names, smallest), "subsets")
    best = E.subsets(names, smallest)[E.best_subset(found).first()["position"]]
    return _refit(prepared, bases, dict.fromkeys(best, 1.0), found, parallelism)


def choose_weight(
    prepared: Prepared, first: Learner, second: Learner, weights: Sequence[float] = E.WEIGHTS, val_size: float = 0.2,
    seed: int = 42, parallelism: int = PARALLELISM,
) -> Chosen:
    """The vote of two bases with the best weight of the first, the lowest weight on ties."""
    names = [first.opt("name"), second.opt("name")]
    scores = validation_scores(prepared.train, [first, second], val_size, seed, parallelism)
    found = write_once(E.weight_grid(scores, *names, weights), "weights")
    w = float(E.best_weight(found).first()["weight"])
    return _refit(prepared, [first, second], {names[0]: w, names[1]: 1.0 - w}, found, parallelism)


def vote_bases(seed: int = 42) -> list[Learner]:
    """The four bases of the subset search with their own default parameters."""
    return [Learner(kind=k, name=k, seed=seed) for k in ("svm", "lightgbm", "xgboost", "logistic_regression")]


# --- scoring and evaluation -------------------------------------------------------------------------


def evaluate(
    test: DataFrame, out_of_fold_scores: DataFrame | None = None, model: str = "model"
) -> dict[str, DataFrame]:
    """All evaluation tables of a score table (key, label, p)."""
    sweep = M.threshold_sweep(test)
    out = {
        "metrics": M.binary_metrics(test),
        "confusion": M.confusion_matrix(test, normalize=True),
        "report": M.classification_report(test),
        "roc": M.roc_curve(test),
        "pr": M.pr_curve(test),
        "areas": M.curve_areas(test),
        "calibration": M.calibration_curve(test),
        "histogram": M.score_histogram(test),
        "thresholds": sweep,
        "best_thresholds": M.best_thresholds(sweep),
        "f1": M.f1_sweep(test),
        "summary": M.evaluation_summary(test, out_of_fold_scores, model),
    }
    if out_of_fold_scores is not None:
        out["cv"] = M.cv_metrics(out_of_fold_scores)
    return out


def save_scorer(scorer: PipelineModel, path: str) -> None:
    """Store features, model and threshold together."""
    scorer.write().overwrite().save(path)


def load_scorer(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(scorer: PipelineModel, df: DataFrame, key: str = S.KEY) -> DataFrame:
    """(key, prediction, p) of raw rows; feature stages are part of the scorer."""
    if "key" not in df.columns:
        df = df.withColumn("key", F.col(key))
    scored = scorer.transform(df)
    # Some feature sets drop the raw key; its copy stays.
    own = F.col(key if key in scored.columns else "key").alias(key)
    return scored.select(own, "prediction", F.col("score").alias("p"))


def score_file(
    spark: SparkSession, model_path: str, test_path: str, out_path: str, fmt: str = "csv", with_probability: bool = False
) -> DataFrame:
    """Scoring alone: a stored scorer applied to a file; writes the predictions and returns their summary."""
    return score_and_write(
        load_scorer(model_path), read_dated(spark, test_path, False, keep_position=True), out_path, fmt=fmt,
        with_probability=with_probability,
    )


def score_and_write(
    scorer: PipelineModel, df: DataFrame, path: str, key: str = S.KEY, fmt: str = "csv", with_probability: bool = False
) -> DataFrame:
    """Write (key, Target[, Probability]) and return the summary of the scores."""
    scored = write_once(score(scorer, df, key), "scored")
    table = sinks.prediction_table(scored, key, "prediction", "p" if with_probability else None)
    sinks.write_table(table, path, fmt)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("prediction") == 1).alias("positives"),
        F.avg("prediction").alias("positive_rate"),
        F.min("p").alias("min_p"),
        F.max("p").alias("max_p"),
        F.avg("p").alias("mean_p"),
    )


def eda_report(df: DataFrame, label: str = S.LABEL, as_of_year: int = 2025) -> dict[str, DataFrame]:
    """Every exploratory table of a cleaned record, as lazy frames."""
    e = eda_columns(df, as_of_year)
    boxes = ["Income", "YearsSinceRegistration", "TotalSpend", *S.SPEND, "Recency", S.DEALS, S.VISITS, "WebConversionRatio"]
    return {
        "shape": P.shape(df),
        "types": P.column_types(df),
        "nulls": Q.null_counts(df, only_missing=False),
        "describe": P.describe(df),
        "value_counts": P.value_counts(e, [label, *S.CATEGORIES, "FamilySize", "Complain", S.DEALS, S.VISITS]),
        "rate_Education": P.target_rate(e, "Education", label),
        "shares": P.crosstab(e, ["Education", "FamilySize", "Complain", "TotalAcceptedCampaigns"], label),
        "size_Complain": P.group_size(e, "Complain"),
        "histogram": P.histogram(e, ["Age", "Income", "YearsSinceRegistration", "TotalSpend", "Recency"], 20, label),
        "density_Age": P.density(e, "Age", label=label),
        "boxes": P.boxplot(e, boxes, label),
        "spend_mix": P.composition(e, S.SPEND),
        "channel_mix": P.composition(e, S.CHANNELS, ("Num", "Purchases")),
        "spend_long": P.melt_spend(e, label=label),
        "campaigns": P.campaign_rates(e),
        "campaigns_by_label": P.campaign_by_label(e, label=label),
        "channels_by_label": P.channel_by_label(e, label=label),
        "correlations": correlation_matrix(df),
        "target_correlations": target_correlations(df, label),
    }


def run(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    out_path: str,
    as_of: str = "2025-04-23",
    explore: bool = True,
    kinds: Sequence[str] | None = None,
    grids: dict[str, dict[str, Sequence[Any]]] | None = None,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Load, explore, benchmark, evaluate, score the test file and record the run.

    Tables, the best model, every other fitted model and the predictions are written below ``out_path``.
    """
    train, test = _read_both(spark, train_path, test_path)
    prepared = prepare(train, as_of)
    tables: dict[str, DataFrame] = {}
    if explore:
        cleaned = prepared.stages[0].transform(train)
        tables.update({f"eda/{n}": t for n, t in eda_report(cleaned, as_of_year=int(as_of[:4])).items()})
    found = benchmark(prepared.train, kinds, grids, seed=seed)
    if found.best_name is None:
        raise ValueError("no model could be fitted")
    best = found.models[found.best_name]
    split = stratified_split(prepared.train, "key", "label", seed=seed)
    held_out = write_once(
        score_with(best, found.best_name, split.where("split = 'test'"), ["key", "label"]), "held_out"
    )
    folds = stratified_folds(split.where("split = 'train'"), "key", "label", seed=seed)
    tuned = Learner(kind=found.best_name, name=found.best_name, params=_best_params(found), seed=seed)
    oof = out_of_fold(write_once(folds, "folds"), [tuned])
    tables.update({f"evaluation/{n}": t for n, t in evaluate(held_out, oof, found.best_name).items()})
    tables["comparison"] = found.table
    # A cosine margin or a neighbour table has no importances; trees and linear models do.
    try:
        tables["importance"] = importance_table(best, prepared.names, spark)
    except ValueError:
        pass
    for name, table in tables.items():
        sinks.write_table(table, f"{out_path}/{name}")
    # The held-out rows were scored at >= 0.5; hard labels give a tie to class 0.
    scorer = PipelineModel([*prepared.stages, best, AtThreshold(name=found.best_name, threshold=0.5, strict=True)])
    save_scorer(scorer, f"{out_path}/model")
    for name, model in found.models.items():
        each = AtThreshold(name=name, threshold=0.5, strict=True)
        save_scorer(PipelineModel([*prepared.stages, model, each]), f"{out_path}/models/{name}")
    summary = score_and_write(scorer, test, f"{out_path}/predictions").first()
    metrics = tables["evaluation/metrics"].first().asDict()
    record = sinks.experiment_record(
        spark,
        timestamp=sinks.run_stamp(pattern="%Y%m%d_%H%M%S"),
        best_model=found.best_name,
        feature_count=len(prepared.names),
        train_samples=prepared.train.count(),
        test_samples=summary["n"],
        positive_predictions=summary["positives"],
        positive_rate=summary["positive_rate"],
        best_metrics={k: float(v) for k, v in metrics.items() if v is not None},
        features=prepared.names,
    )
    sinks.write_experiment(record, f"{out_path}/experiments")
    sinks.append_metrics(tables["evaluation/metrics"], f"{out_path}/model_metrics", found.best_name)
    sinks.append_metrics(tables["evaluation/cv"], f"{out_path}/cv_metrics", found.best_name, 5)
    tables["experiment"] = record
    return tables


def _best_params(found: Benchmark) -> dict[str, Any]:
    table = found.searches[found.best_name]
    return json.loads(P.best_row(table, "mean_auc", "candidate").first()["params"])
