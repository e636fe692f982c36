"""Registered queries: each takes (spark, folder of the tables) and returns a DataFrame.

All of them read the tables of the folder in full. Doubles are rounded to six digits so that
results can be compared with those of another engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buyerscope import schema as S
from buyerscope.features.core import CoreFeatures, eda_columns
from buyerscope.features.rfm import RfmFeatures
from buyerscope.features.variants import CompactFeatures, LeanFeatures
from buyerscope.functions import dates as D
from buyerscope.functions.expressions import hash_unit, lookup, quoted
from buyerscope.models.learners import GRIDS, AtThreshold, Learner, learner
from buyerscope.models.selection import (
    importance_table, linear_attribution, permutation_importance, recursive_elimination, select_features,
)
from buyerscope.models.stacking import fit_stack, fit_vote, meta_learner, stack_out_of_fold
from buyerscope.models.validation import (
    SPACES, cross_validated_search, draw_from_grid, draw_from_space, expand_grid, halving_search, out_of_fold,
    score_with,
)
from buyerscope.operators import metrics as M
from buyerscope.operators import profile as P
from buyerscope.operators import quality as Q
from buyerscope.operators.binning import cut, cut_index, quantile_edges
from buyerscope.operators.cleaning import Cleaner, clamp, keep_first, to_binary
from buyerscope.operators.correlation import correlation_extremes, correlation_matrix, target_correlations
from buyerscope.operators.ensemble import best_subset, best_weight, soft_vote, subset_search, weight_grid
from buyerscope.operators.neighbours import classify, nearest_neighbours
from buyerscope.operators.onehot import OneHot
from buyerscope.operators.quantiles import exact_quantiles
from buyerscope.operators.smote import oversample
from buyerscope.operators.splits import down_sample, split_with_folds, stratified_folds, stratified_split
from buyerscope.operators.transform import FillMissing, PowerTransform, StandardScale, column_transformer
from buyerscope.sources.sinks import fill_template, prediction_table
from buyerscope.sources.wide import CUTOFF, TABLES, customer_360, table
from buyerscope.plans.jobs import (
    Prepared, balanced, benchmark, choose_subset, choose_weight, load_scorer, prepare, save_scorer, score, train_final,
)
from buyerscope.plans.tuned import TunedStack, lean_stack, raw_stack
from buyerscope.storage import shared_root, write_once

Query = Callable[[SparkSession, str], DataFrame]

YEAR = int(CUTOFF[:4])
CORR_COLUMNS = [
    "Income", "Kidhome", "Teenhome", "Recency", *S.SPEND, S.DEALS, *S.CHANNELS, S.VISITS,
    *S.CAMPAIGNS, "Complain", *S.CONSTANTS, "Days_Since_Registration", S.LABEL,
]

_tables: dict[tuple[str, str, str], DataFrame] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded half up, dates as text.

    Rounding is spelled out in plain arithmetic so that other engines can repeat it exactly.
    """
    scale = F.lit(float(10**digits))
    out = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.floor(c.cast("double") * scale + F.lit(0.5)) / scale
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def stored(name: str, build: Query) -> Query:
    """A table that several queries read: built and written once per session and folder."""

    def get(spark: SparkSession, folder: str) -> DataFrame:
        slot = (spark.sparkContext.applicationId, folder, name)
        if slot not in _tables:
            _tables[slot] = write_once(build(spark, folder), name)
        return _tables[slot]

    return get


wide = stored("customer_360", customer_360)
# What was known at the cutoff: the only form that models may read.
history = stored("history_360", lambda spark, folder: customer_360(spark, folder, CUTOFF, events_before=CUTOFF))


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    df = wide(spark, folder)
    return Cleaner(as_of=CUTOFF).fit(df).transform(df)


cleaned = stored("cleaned", _clean)
explored = stored("explored", lambda spark, folder: eda_columns(cleaned(spark, folder), YEAR))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Three fixed scores per customer: recent buyers, frequent buyers, noise."""
    df = wide(spark, folder)
    often = F.col(S.CHANNELS[0]) + F.col(S.CHANNELS[1]) + F.col(S.CHANNELS[2])
    folds = stratified_folds(df, k=5)
    return folds.select(
        F.col(S.KEY).alias("key"),
        F.col(S.LABEL).alias("label"),
        "fold",
        F.coalesce(F.round(90.0 / (90.0 + F.col("Recency")), 3), F.lit(0.0)).alias("p_recent"),
        F.round(often / (often + F.lit(5.0)), 3).alias("p_often"),
        F.round(hash_unit(S.KEY, F.lit("noise")), 4).alias("p_noise"),
    )


score_table = stored("scores", _scores)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_table(spark, folder).select("key", "label", "fold", F.col("p_recent").alias("p"))


def long_scores(spark: SparkSession, folder: str) -> DataFrame:
    names = ["recent", "often", "noise"]
    pairs = [F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("p")) for n in names]
    return score_table(spark, folder).select("key", "label", "fold", F.inline(F.array(*pairs)))


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Label quality against a score from the text length: an imbalanced case."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    marks = table(spark, folder, "labels").select("doc_id", "quality")
    size = F.col("n_chars").cast("double")
    return docs.join(marks, "doc_id").select(
        F.col("doc_id").alias("key"),
        F.col("quality").alias("label"),
        F.round(size / (size + 2000.0), 3).alias("p"),
    )


# --- cleaning and quality -----------------------------------------------------------------


def dataset_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row per numeric column: size of the table, type, nulls and summary statistics."""
    df = wide(spark, folder)
    stats = P.describe(df)
    nulls = Q.null_counts(df, only_missing=False)
    types = P.column_types(df)
    size = df.agg(F.count(F.lit(1))).scalar()
    return (
        stats.join(nulls, "column")
        .join(types, "column")
        .withColumns({"n_rows": size, "n_columns": F.lit(len(df.columns))})
    )


def cleaning_audit(spark: SparkSession, folder: str) -> DataFrame:
    df = wide(spark, folder)
    return Cleaner(as_of=CUTOFF).fit(df).audit(df)


def clean_clip(spark: SparkSession, folder: str) -> DataFrame:
    from buyerscope.functions.expressions import at_least

    df = table(spark, folder, "customer")
    return df.select("c_custkey", at_least("c_acctbal", 0.0).alias("balance"))


def clean_winsorize(spark: SparkSession, folder: str) -> DataFrame:
    from buyerscope.functions.expressions import at_most

    df = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    cap = exact_quantiles(df, {"cap": ("l_extendedprice", [0.995])})["cap"][0]
    return df.withColumn("capped", at_most("l_extendedprice", cap)).withColumn(
        "changed", (F.col("l_extendedprice") > F.lit(cap)).cast("int")
    )


def clean_clamp(spark: SparkSession, folder: str) -> DataFrame:
    low, high = YEAR - 100, YEAR - 18
    df = wide(spark, folder)
    return df.select(
        "ID",
        clamp("Year_Birth", low, high).alias("Year_Birth"),
        (~F.col("Year_Birth").between(low, high)).cast("int").alias("changed"),
    )


def clean_binary(spark: SparkSession, folder: str) -> DataFrame:
    return wide(spark, folder).select("ID", *[to_binary(c).alias(c) for c in [S.DEALS, *S.CHANNELS, S.VISITS]])


def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    first = keep_first(df, ["l_orderkey", "l_linenumber"], order)
    return first.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def impute_strategies(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("by_median"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("by_mode"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("by_constant"),
    )
    for strategy, c in (("median", "by_median"), ("most_frequent", "by_mode"), ("constant", "by_constant")):
        df = FillMissing(columns=[c], strategy=strategy).fit(df).transform(df)
    return df


def date_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written in two formats and some garbage, parsed back."""
    orders = table(spark, folder, "orders")
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "dd-MM-yyyy"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "d/M/yyyy"))
        .otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("?")))
    )
    parsed = orders.select("o_orderkey", D.parse_dates(text).alias("day"))
    days = D.tenure_days("day", CUTOFF)
    return parsed.select(
        "o_orderkey",
        "day",
        days.alias("tenure_days"),
        D.tenure_months(days).alias("tenure_months"),
        D.tenure_years(days).alias("tenure_years"),
        *[c.alias(n.lower()) for n, c in D.calendar_parts("day").items()],
        *[c.alias(n.lower()) for n, c in D.month_cycle("day").items()],
    )


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_split(wide(spark, folder).select(S.KEY, S.LABEL))


def leakage_check(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with history against customers with an order after the cutoff."""
    orders = table(spark, folder, "orders")
    before = F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")
    return Q.leakage_check(orders.where(before), orders.where(~before), "o_custkey")


def shared_customers(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    before = F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")
    return Q.shared_keys(orders.where(before), orders.where(~before), "o_custkey")


def append_union(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey")
    return Q.append_rows(customers, suppliers)


def align_columns(spark: SparkSession, folder: str) -> DataFrame:
    return Q.align_schema(
        wide(spark, folder), ["Income", "Absent", "Recency", "MntWines"], keep=["ID"]
    )


def template_fill(spark: SparkSession, folder: str) -> DataFrame:
    split = _split(spark, folder)
    template = split.where(F.col("split") == "test").select("ID")
    scored = scores(spark, folder).select(
        F.col("key").alias("ID"), M.predicted("p").alias("prediction"), "p"
    )
    return fill_template(template, prediction_table(scored))


# --- features -----------------------------------------------------------------------------


def feat_core(spark: SparkSession, folder: str) -> DataFrame:
    df = cleaned(spark, folder)
    return CoreFeatures(as_of_year=YEAR).fit(df).transform(df)


def _rfm(spark: SparkSession, folder: str, **options) -> DataFrame:
    df = wide(spark, folder)
    return RfmFeatures(as_of=CUTOFF, **options).fit(df).transform(df)


RFM_SETS = {
    "feat_tenure": [
        "Customer_Tenure_Days", "Customer_Tenure_Months", "Customer_Tenure_Years", "Enroll_Year",
        "Enroll_Month", "Enroll_Quarter", "Enroll_Day", "Enroll_DayOfWeek", "Enroll_Weekend",
        "Recency_Tenure_Ratio",
    ],
    "feat_lifecycle": [
        "Age", "Age_Bin", "Total_Children", "Has_Partner", "Family_Size", "Is_Parent",
        "Empty_Nester", "Family_Lifecycle",
    ],
    "feat_spend_mix": [
        "Total_Spent", "Luxury_Ratio", "Food_Ratio", *[f"{c}_Ratio" for c in S.SPEND],
        "Spent_Per_Person", "Spending_CV", "Wine_And_Meat", "Sweet_And_Gold", "Total_Purchases",
        *[f"{c}_Ratio" for c in S.CHANNELS], "Web_Store_Ratio", "Catalog_Store_Ratio",
        "Avg_Spent_Per_Purchase", "Deal_Usage_Rate", "Web_Visits_Per_Purchase", "Web_Conversion_Rate",
    ],
    "feat_income": [
        "Income", "Income_Per_Family_Member", "Spending_Income_Ratio", "Luxury_Income_Ratio",
        "Income_Quantile", "Campaign_Accepted_Count", "Campaign_Response_Rate",
        "Recent_Campaign_Success", "Early_Campaign_Success", "Customer_Satisfaction", "Income_X_Age",
        "Recency_X_Spending", "Recent_High_Spender", "Campaign_Success_X_Spending",
    ],
    "feat_rfm": [
        "R_Score", "F_Score", "M_Score", "RFM_Score", "Customer_Value", "Is_Active", "Education_Ordinal",
    ],
}


def _rfm_query(names: list[str]) -> Query:
    return lambda spark, folder: _rfm(spark, folder, encode=False, scale=False).select("ID", *names)


def feat_scaled(spark: SparkSession, folder: str) -> DataFrame:
    full = _rfm(spark, folder)
    return full.select("ID", *[c for c in full.columns if c.endswith(("_scaled", "_norm"))])


def scaled_ratios(spark: SparkSession, folder: str) -> DataFrame:
    full = _rfm(spark, folder)
    return full.select("ID", *[c for c in full.columns if c.endswith("_scaled")])


def feat_onehot(spark: SparkSession, folder: str) -> DataFrame:
    full = _rfm(spark, folder, scale=False)
    prefixes = ("Marital_Status_", "Education_", "Age_Bin_", "Family_Lifecycle_", "Customer_Value_")
    return full.select("ID", *[c for c in full.columns if c.startswith(prefixes) and c != "Education_Ordinal"])


def feat_compact(spark: SparkSession, folder: str) -> DataFrame:
    df = wide(spark, folder).withColumn("row_key", F.col("ID"))
    return CompactFeatures(as_of_year=YEAR).fit(df).transform(df)


def feat_lean(spark: SparkSession, folder: str) -> DataFrame:
    return LeanFeatures(as_of=CUTOFF, keep_key=True).transform(wide(spark, folder))


def quantile_bins(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    edges = quantile_edges(df, {"p": ("o_totalprice", 5, False)})["p"]
    return df.withColumn("bin", cut_index("o_totalprice", edges, include_lowest=True)).withColumn(
        "band", cut("o_totalprice", [0, 100_000, 250_000, 400_000], ["low", "mid", "high"])
    )


def onehot(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return OneHot(columns=["o_orderpriority", "o_orderstatus"], drop_first=True).fit(df).transform(df)


def ordinal(spark: SparkSession, folder: str) -> DataFrame:
    order = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "5-LOW": 3}
    df = table(spark, folder, "orders")
    return df.select("o_orderkey", lookup("o_orderpriority", order, -1).alias("code"))


def standard_scale(spark: SparkSession, folder: str) -> DataFrame:
    df = cleaned(spark, folder).select("ID", "Income", "Recency", *S.SPEND, "Z_Revenue")
    return StandardScale(columns=["Income", "Recency", *S.SPEND, "Z_Revenue"]).fit(df).transform(df)


def power_transform(spark: SparkSession, folder: str) -> DataFrame:
    df = explored(spark, folder).select("ID", "Income", "TotalSpend")
    return PowerTransform(columns=["Income", "TotalSpend"], step=0.1).fit(df).transform(df)


# --- exploratory tables -------------------------------------------------------------------


def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    names = [S.LABEL, "Education", "Marital_Status", "FamilySize", "Complain", "TotalAcceptedCampaigns"]
    return P.value_counts(explored(spark, folder), names)


def crosstab(spark: SparkSession, folder: str) -> DataFrame:
    names = ["Education", "FamilySize", "Complain", "TotalAcceptedCampaigns"]
    return P.crosstab(explored(spark, folder), names)


def tier_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    """Label shares by RFM score: from raw tables to a segment report."""
    return P.crosstab(_rfm(spark, folder, encode=False, scale=False), "RFM_Score").drop("column")


def composition(spark: SparkSession, folder: str) -> DataFrame:
    df = explored(spark, folder)
    spend = P.composition(df, S.SPEND).withColumn("mix", F.lit("spend"))
    channel = P.composition(df, S.CHANNELS, ("Num", "Purchases")).withColumn("mix", F.lit("channel"))
    return spend.unionByName(channel)


def corr_extremes(spark: SparkSession, folder: str) -> DataFrame:
    return correlation_extremes(target_correlations(cleaned(spark, folder), columns=CORR_COLUMNS))


def constant_report(spark: SparkSession, folder: str) -> DataFrame:
    return P.constant_columns(wide(spark, folder))


def top_campaign(spark: SparkSession, folder: str) -> DataFrame:
    return P.best_row(P.campaign_rates(explored(spark, folder)), "Acceptance_Rate", "Campaign")


# --- evaluation ---------------------------------------------------------------------------


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return M.confusion_matrix(scores(spark, folder), 0.5, normalize=True)


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    df = scores(spark, folder)
    return M.evaluation_summary(df.where("fold = 0"), df.where("fold <> 0"), "recent")


def fold_spread(spark: SparkSession, folder: str) -> DataFrame:
    df, out = scores(spark, folder), None
    for scoring in ("roc_auc", "average_precision", "f1"):
        part = M.score_spread(M.fold_scores(df, scoring)).withColumn("scoring", F.lit(scoring))
        out = part if out is None else out.unionByName(part)
    return out


def cv_threshold(spark: SparkSession, folder: str) -> DataFrame:
    df, out = scores(spark, folder), None
    for metric in ("f1", "precision", "recall", "geometric_mean"):
        part = M.cv_threshold(df, metric).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return out


# --- neighbours, oversampling, voting ----------------------------------------------------------

KNN_COLUMNS = ["Income", "Recency", "TotalSpend", "TotalPurchases", "Age"]


def knn_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest other vectors of every embedding."""
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")
    )
    return nearest_neighbours(rows, rows, 5, skip_same_id=True)


def scaled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, label, v): five standardized columns, rounded so that distances do not depend on
    the order of summation in the fitted means."""
    df = explored(spark, folder).select("ID", S.LABEL, *KNN_COLUMNS)
    scaled = StandardScale(columns=KNN_COLUMNS).fit(df).transform(df)
    return scaled.select(
        F.col("ID").alias("id"),
        F.col(S.LABEL).alias("label"),
        F.array(*[F.floor(F.col(c) * 1e4 + 0.5) / 1e4 for c in KNN_COLUMNS]).alias("v"),
    )


def _knn(weights: str, p: int) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = scaled_vectors(spark, folder)
        folds = stratified_split(rows, "id", "label")
        base = folds.where("split = 'train'")
        asked = folds.where("split = 'test'")
        return classify(asked, base, k=7, weights=weights, p=p).withColumnRenamed("query_id", "ID")

    return run


def smote(spark: SparkSession, folder: str) -> DataFrame:
    columns = [f"x{i}" for i in range(len(KNN_COLUMNS))]
    rows = scaled_vectors(spark, folder)
    wide_rows = rows.select("id", "label", *[F.col("v")[i].alias(c) for i, c in enumerate(columns)])
    return oversample(wide_rows, columns, "id", "label")


def _wide_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_table(spark, folder)


MODELS = ["recent", "often", "noise"]


def best_vote(spark: SparkSession, folder: str) -> DataFrame:
    return best_subset(subset_search(_wide_scores(spark, folder), MODELS))


# --- models -------------------------------------------------------------------------------------

_prepared: dict[tuple[str, str], Prepared] = {}


def prepared(spark: SparkSession, folder: str) -> Prepared:
    """Cleaned and assembled training table of the wide record, with its fitted stages."""
    slot = (spark.sparkContext.applicationId, folder)
    if slot not in _prepared:
        _prepared[slot] = prepare(history(spark, folder), as_of=CUTOFF)
    return _prepared[slot]


def _model_split(spark: SparkSession, folder: str) -> DataFrame:
    return split_with_folds(prepared(spark, folder).train, "key", "label", k=5)


model_split = stored("model_split", _model_split)


def training(spark: SparkSession, folder: str) -> DataFrame:
    return model_split(spark, folder).where("split = 'train'")


def held_out(spark: SparkSession, folder: str) -> DataFrame:
    return model_split(spark, folder).where("split = 'test'")


def fitted(kind: str, **params) -> Query:
    """Fit on the training part, score the held-out part."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        model = learner(kind, **params).fit(training(spark, folder))
        return score_with(model, kind, held_out(spark, folder), ["key", "label"])

    return run


def _bases() -> list[Learner]:
    return [learner("logistic_regression"), learner("decision_tree", max_depth=4), learner("random_forest")]


def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    return cross_validated_search(training(spark, folder), learner("logistic_regression"), expand_grid(GRIDS["logistic_regression"]))[2]


def random_search(spark: SparkSession, folder: str) -> DataFrame:
    grid = {"max_depth": [3, 5], "min_samples_split": [2, 10], "criterion": ["gini", "entropy"]}
    return cross_validated_search(training(spark, folder), learner("decision_tree"), draw_from_grid(grid, 10))[2]


def space_search(spark: SparkSession, folder: str) -> DataFrame:
    points = draw_from_space(SPACES["catboost"], 30)
    return cross_validated_search(training(spark, folder), learner("catboost"), points)[2]


def model_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark(prepared(spark, folder).train).table


def model_oof(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics over all out-of-fold scores of each base model."""
    scored = out_of_fold(training(spark, folder), _bases())
    return M.binary_metrics(scored, by=["model"])


def cv_oversampled(spark: SparkSession, folder: str) -> DataFrame:
    scored = out_of_fold(training(spark, folder), [learner("logistic_regression")], resample=balanced)
    return M.score_spread(M.fold_scores(scored))


def stack(spark: SparkSession, folder: str) -> DataFrame:
    model = fit_stack(training(spark, folder), _bases(), meta_learner())
    return score_with(model, "stack", held_out(spark, folder), ["key", "label"])


def stack_mlp(spark: SparkSession, folder: str) -> DataFrame:
    meta = meta_learner("mlp", "stack")
    model = fit_stack(training(spark, folder), _bases(), meta)
    return score_with(model, "stack", held_out(spark, folder), ["key", "label"])


def stack_oof(spark: SparkSession, folder: str) -> DataFrame:
    scored = stack_out_of_fold(training(spark, folder), _bases(), meta_learner())
    return M.cv_metrics(scored)


def model_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Equal vote of a margin classifier and boosted trees."""
    model = fit_vote(training(spark, folder), [learner("svm"), learner("lightgbm")])
    return score_with(model, "vote", held_out(spark, folder), ["key", "label"])


def model_importance(spark: SparkSession, folder: str) -> DataFrame:
    model = learner("random_forest").fit(training(spark, folder))
    return importance_table(model, prepared(spark, folder).names, spark)


def model_attribution(spark: SparkSession, folder: str) -> DataFrame:
    train = training(spark, folder)
    return linear_attribution(learner("logistic_regression").fit(train), train, prepared(spark, folder).names)


def perm_importance(spark: SparkSession, folder: str) -> DataFrame:
    model = learner("decision_tree", "m", max_depth=4).fit(training(spark, folder))
    return permutation_importance(model, "m", held_out(spark, folder), prepared(spark, folder).names)


def rfe(spark: SparkSession, folder: str) -> DataFrame:
    _, table = recursive_elimination(training(spark, folder), learner("decision_tree", max_depth=4), prepared(spark, folder).names)
    return table.select("n_features", "mean", "std")


def score_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records through one stored scorer: features, model and decision."""
    model = learner("logistic_regression").fit(training(spark, folder))
    scorer = PipelineModel(
        [*prepared(spark, folder).stages, model, AtThreshold(name="logistic_regression", threshold=0.5)]
    )
    path = f"{shared_root(spark)}/scorer-{uuid.uuid4().hex}"
    save_scorer(scorer, path)
    return score(load_scorer(path), history(spark, folder))


def final_train(spark: SparkSession, folder: str) -> DataFrame:
    return score(train_final(prepared(spark, folder)).scorer, history(spark, folder))


# Long runs that more than one query reads.
FINAL, SPACE, ADAPTIVE = (
    stored(name, build)
    for name, build in (
        ("final_train", lambda spark, folder: final_train(spark, folder)),
        ("space_search", lambda spark, folder: space_search(spark, folder)),
        ("adaptive_search", lambda spark, folder: adaptive_search(spark, folder)),
    )
)


def adaptive_search(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty points of the whole space, in rungs of more and more rounds."""
    points = draw_from_space(SPACES["lightgbm"], 30)
    return halving_search(training(spark, folder), learner("lightgbm"), points)[2]


def _tuned(build: Callable[[DataFrame], TunedStack]) -> Query:
    """Out-of-fold scores of a tuned stack, one row per customer: (key, label, fold, model, p)."""
    return lambda spark, folder: build(history(spark, folder)).scores


LEAN_STACK = stored("lean_stack", _tuned(lambda rows: lean_stack(rows, as_of=CUTOFF)))
RAW_STACK = stored("raw_stack", _tuned(lambda rows: raw_stack(rows, as_of_year=YEAR)))


def column_transformed(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers imputed and scaled, texts imputed and encoded, read back from the vector that the transformer fills."""
    rows = wide(spark, folder).select("ID", "Target", "Income", "Recency", "Education")
    model = column_transformer(["Income", "Recency"], ["Education"]).fit(rows)
    names = model.stages[-1].feature_names()
    x = vector_to_array(F.col("features"))
    return model.transform(rows).select("ID", *[x[i].alias(n) for i, n in enumerate(names)])


# Yes-or-no columns whose splits SQL can list.
FLAGS = {
    "has_kids": "Kidhome > 0", "many_teens": "Teenhome > 1", "long_ago": "Recency > 30", "young": "Year_Birth > 1975",
    "web": "NumWebPurchases > 2", "complained": "Complain > 0", **{c.lower(): f"{c} > 0" for c in S.CAMPAIGNS},
}
TREE = {"n_estimators": 1, "max_depth": 2, "reg_lambda": 1.0, "learning_rate": 0.3}


def boost_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of one second-order tree of two levels over the flags: (path, rows, flag, gain, value)."""
    flags = F.array(*[F.coalesce(F.expr(f"cast({x} as double)"), F.lit(0.0)) for x in FLAGS.values()])
    rows = wide(spark, folder).select(F.col(S.KEY).alias("key"), F.col(S.LABEL).cast("double").alias("label"), array_to_vector(flags).alias("features"))
    model = learner("xgboost", **TREE).fit(rows)
    tree, names, paths = model.stages[-1].ensemble()[1].trees[0], list(FLAGS), {0: ""}
    out = []
    for node in range(len(tree.feature)):
        inner = tree.feature[node] >= 0
        if inner:
            paths |= {int(tree.left[node]): paths[node] + "n", int(tree.right[node]): paths[node] + "y"}
        out.append((paths[node], int(tree.rows[node]), names[tree.feature[node]] if inner else None, float(tree.gain[node]), float(tree.value[node])))
    return spark.createDataFrame(out, "path string, rows long, flag string, gain double, value double")


def subset_model(spark: SparkSession, folder: str) -> DataFrame:
    """The best vote of the base models, refitted on all rows and applied to the raw records."""
    done = choose_subset(prepared(spark, folder), [*_bases(), learner("lightgbm")])
    return score(done.scorer, history(spark, folder))


def weight_model(spark: SparkSession, folder: str) -> DataFrame:
    """The best weighted pair, refitted on all rows and applied to the raw records."""
    first, second = learner("svm"), learner("lightgbm")
    return score(choose_weight(prepared(spark, folder), first, second).scorer, history(spark, folder))


def feature_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty most attributed features, most important first."""
    chosen = select_features(training(spark, folder), prepared(spark, folder).names, base=learner("logistic_regression"))
    return spark.createDataFrame(list(enumerate(chosen, 1)), "place int, feature string")


def _queries() -> dict[str, Query]:
    return {
        "customer_360": customer_360,
        "null_profile": lambda s, d: Q.null_profile(wide(s, d)),
        "null_counts": lambda s, d: Q.null_counts(wide(s, d)),
        "dataset_report": dataset_report,
        "describe": lambda s, d: P.describe(cleaned(s, d), ["Income", "Recency", *S.SPEND]),
        "cleaning_audit": cleaning_audit,
        "clean_impute": cleaned,
        "clean_clip": clean_clip,
        "clean_winsorize": clean_winsorize,
        "clean_clamp": clean_clamp,
        "clean_binary": clean_binary,
        "impute_strategies": impute_strategies,
        "dedupe_first": dedupe_first,
        "duplicate_count": lambda s, d: Q.duplicate_count(
            table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]
        ),
        "out_of_bounds": lambda s, d: Q.out_of_bounds(
            table(s, d, "lineitem"),
            {"l_quantity": (5.0, 45.0), "l_discount": (None, 0.08), "l_extendedprice": (1000.0, None)},
        ),
        "date_parse": date_parse,
        "leakage_check": leakage_check,
        "shared_customers": shared_customers,
        "append_union": append_union,
        "align_schema": align_columns,
        "template_fill": template_fill,
        "feat_core": feat_core,
        "feat_eda": explored,
        **{name: _rfm_query(columns) for name, columns in RFM_SETS.items()},
        "feat_scaled": feat_scaled,
        "scaled_ratios": scaled_ratios,
        "feat_onehot": feat_onehot,
        "feat_compact": feat_compact,
        "feat_lean": feat_lean,
        "quantile_bins": quantile_bins,
        "onehot": onehot,
        "ordinal": ordinal,
        "standard_scale": standard_scale,
        "power_transform": power_transform,
        "value_counts": value_counts,
        "target_rate": lambda s, d: P.target_rate(cleaned(s, d), "Education"),
        "crosstab": crosstab,
        "tier_crosstab": tier_crosstab,
        "group_size": lambda s, d: P.group_size(cleaned(s, d), "Complain"),
        "composition": composition,
        "campaign_rates": lambda s, d: P.campaign_rates(explored(s, d)),
        "campaign_by_label": lambda s, d: P.campaign_by_label(explored(s, d)),
        "channel_by_label": lambda s, d: P.channel_by_label(explored(s, d)),
        "melt_spend": lambda s, d: P.melt_spend(explored(s, d)),
        "distinct_values": lambda s, d: P.distinct_values(table(s, d, "events"), "event_type"),
        "constant_columns": constant_report,
        "corr_matrix": lambda s, d: correlation_matrix(cleaned(s, d), CORR_COLUMNS),
        "corr_target": lambda s, d: target_correlations(cleaned(s, d), columns=CORR_COLUMNS),
        "corr_extremes": corr_extremes,
        "histogram": lambda s, d: P.histogram(explored(s, d), ["Age", "Income", "TotalSpend"], 20, S.LABEL),
        "kde": lambda s, d: P.density(explored(s, d), "Income", 100, S.LABEL),
        "boxplot": lambda s, d: P.boxplot(explored(s, d), ["Income", "TotalSpend", "Recency", S.DEALS]),
        "top_campaign": top_campaign,
        "class_weights": lambda s, d: M.class_weights(wide(s, d), S.LABEL),
        "sample_n": lambda s, d: down_sample(wide(s, d), S.KEY, 100).select("ID", "Income"),
        "split_stratified": _split,
        "kfold": lambda s, d: stratified_folds(wide(s, d).select(S.KEY, S.LABEL)),
        "kfold_documents": lambda s, d: stratified_folds(
            table(s, d, "labels").select("doc_id", "quality"), "doc_id", "quality", k=5
        ),
        "confusion": confusion,
        "binary_metrics": lambda s, d: M.binary_metrics(long_scores(s, d), 0.5, ["model"]),
        "document_metrics": lambda s, d: M.binary_metrics(document_scores(s, d), 0.5),
        "roc_auc": lambda s, d: M.roc_auc(long_scores(s, d), ["model", "fold"]),
        "avg_precision": lambda s, d: M.rank_metrics(long_scores(s, d), ["model"]).select(
            "model", "average_precision"
        ),
        "roc_curve": lambda s, d: M.roc_curve(scores(s, d)),
        "pr_curve": lambda s, d: M.pr_curve(scores(s, d)),
        "curve_areas": lambda s, d: M.curve_areas(long_scores(s, d), ["model"]),
        "calibration": lambda s, d: M.calibration_curve(long_scores(s, d), 10, ["model"]),
        "class_report": lambda s, d: M.classification_report(scores(s, d)),
        "threshold_sweep": lambda s, d: M.threshold_sweep(long_scores(s, d), by=["model"]),
        "best_thresholds": lambda s, d: M.best_thresholds(
            M.threshold_sweep(long_scores(s, d), by=["model"]), by=["model"]
        ),
        "f1_sweep": lambda s, d: M.f1_sweep(scores(s, d)),
        "cv_threshold": cv_threshold,
        "fold_scores": lambda s, d: M.fold_scores(scores(s, d)),
        "fold_spread": fold_spread,
        "oof_metrics": lambda s, d: M.cv_metrics(scores(s, d)),
        "eval_summary": eval_summary,
        "score_hist": lambda s, d: M.score_histogram(scores(s, d)),
        "knn_embeddings": knn_embeddings,
        "knn_classify": _knn("uniform", 2),
        "knn_classify_distance": _knn("distance", 1),
        "smote": smote,
        "soft_vote": lambda s, d: soft_vote(long_scores(s, d), {m: 1.0 for m in MODELS}),
        "weighted_vote": lambda s, d: soft_vote(
            long_scores(s, d), {"recent": 0.6, "often": 0.2, "noise": 0.2}
        ),
        "weight_grid": lambda s, d: weight_grid(_wide_scores(s, d), "recent", "often"),
        "best_weight": lambda s, d: best_weight(weight_grid(_wide_scores(s, d), "recent", "often")),
        "subset_search": lambda s, d: subset_search(_wide_scores(s, d), MODELS),
        "best_subset": best_vote,
        "lr": fitted("logistic_regression", class_weight="balanced"),
        "rf": fitted("random_forest"),
        "gbt": fitted("gradient_boosting"),
        "xgb_preset": fitted("xgboost", scale_pos_weight="balanced", colsample_bytree=0.8),
        "dt": fitted("decision_tree", max_depth=5, criterion="entropy"),
        "svc_linear": fitted("svm", kernel="linear"),
        "svc_rbf": fitted("svm", kernel="rbf"),
        "knn_model": fitted("knn", n_neighbors=7),
        "mlp": fitted("mlp"),
        "grid_search": grid_search,
        "random_search": random_search,
        "space_search": SPACE,
        "adaptive_search": ADAPTIVE,
        "boost_levels": boost_levels,
        "lean_stack": LEAN_STACK,
        "raw_stack": RAW_STACK,
        "column_transformed": column_transformed,
        "benchmark": model_benchmark,
        "model_oof": model_oof,
        "cv_oversampled": cv_oversampled,
        "stack": stack,
        "stack_mlp": stack_mlp,
        "stack_oof": stack_oof,
        "model_vote": model_vote,
        "importance": model_importance,
        "attribution": model_attribution,
        "perm_importance": perm_importance,
        "rfe": rfe,
        "score_batch": score_batch,
        "subset_model": subset_model,
        "weight_model": weight_model,
        "feature_choice": feature_choice,
        "final_train": FINAL,
        "prediction_summary": lambda s, d: M.prediction_summary(scores(s, d)),
    }


def queries() -> dict[str, Query]:
    """All registered queries, with rounded results."""

    def with_rounding(build: Query) -> Query:
        return lambda spark, folder: rounded(build(spark, folder))

    return {name: with_rounding(build) for name, build in _queries().items()}


__all__ = ["TABLES", "queries", "rounded"]
