import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from buyerscope.operators.splits import down_sample, rank_by_hash, split_with_folds, stratified_folds, stratified_split
from buyerscope.operators.transform import (
    PowerTransform, PowerTransformModel, StandardScale, column_transformer, most_frequent, likelihoods,
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(F.col("id").alias("ID"), (F.col("id") % 10 < 3).cast("int").alias("Target"))


def test_ranks_are_complete_and_independent_of_partitioning(rows):
    a = {r["ID"]: r["rn"] for r in rank_by_hash(rows.repartition(1), "ID", 1, ["Target"]).collect()}
    b = {r["ID"]: r["rn"] for r in rank_by_hash(rows.repartition(8), "ID", 1, ["Target"], digits=1).collect()}
    assert a == b
    assert sorted(v for k, v in a.items() if k % 10 < 3) == list(range(1, 301))


def test_split_sizes_are_exact_per_class(rows):
    got = {(r["Target"], r["split"]): r["count"] for r in stratified_split(rows).groupBy("Target", "split").count().collect()}
    assert got == {(0, "test"): 140, (0, "train"): 560, (1, "test"): 60, (1, "train"): 240}
    plain = stratified_split(rows, label=None, test_size=0.25).where("split = 'test'").count()
    assert plain == 250


@pytest.mark.parametrize(
    "sizes, quotas", [((960, 607), (192, 122)), ((11, 11, 11), (3, 2, 2)), ((4, 1), (1, 0)), ((5,), (1,))]
)
def test_test_rows_are_the_rounded_up_share_of_all(spark, sizes, quotas):
    pairs = [(i, c) for c, n in enumerate(sizes) for i in range(1000 * c, 1000 * c + n)]
    df = spark.createDataFrame(pairs, "ID int, Target int")
    got = {r["Target"]: r["count"] for r in stratified_split(df).where("split = 'test'").groupBy("Target").count().collect()}
    assert [got.get(c, 0) for c in range(len(sizes))] == list(quotas)


def test_split_of_an_empty_table_and_of_a_null_class(spark):
    assert stratified_split(spark.createDataFrame([], "ID int, Target int")).count() == 0
    df = spark.createDataFrame([(i, None) for i in range(10)], "ID int, Target int")
    assert stratified_split(df).where("split = 'test'").count() == 2


def test_fold_sizes_differ_by_one_over_all_classes(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(7 * 11)], "ID int, Target int")
    sizes = [r["count"] for r in stratified_folds(df, k=5).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_folds_are_disjoint_and_balanced(rows):
    got = stratified_folds(rows, k=5).groupBy("fold", "Target").count().collect()
    assert {(r["fold"], r["Target"]): r["count"] for r in got} == {
        (f, t): n for f in range(5) for t, n in ((0, 140), (1, 60))}


def shuffled(df):
    """The columns of every shuffle in the plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)


@pytest.mark.parametrize("mark", [stratified_split, stratified_folds, split_with_folds])
def test_whole_rows_are_shuffled_once(spark, rows, mark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = shuffled(mark(rows.withColumn("wide", F.rand(1))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum("wide#" in columns for columns in found) == 1


def test_split_and_folds_from_one_ranking(spark):
    pairs = [(i, None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(i % 7 < 2)) for i in range(700)]
    df = spark.createDataFrame([*pairs, (None, 1.0), (None, None)], "ID int, Target double")
    one, two = split_with_folds(df, k=3), stratified_folds(stratified_split(df), k=3)
    assert one.columns == two.columns == ["ID", "Target", "split", "fold"]
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_null_stratum_is_kept(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "ID int, Target int")
    assert stratified_folds(df, k=2).count() == 3


def test_down_sample_is_repeatable(rows):
    a = {r[0] for r in down_sample(rows, "ID", 50).select("ID").collect()}
    b = {r[0] for r in down_sample(rows.repartition(5), "ID", 50).select("ID").collect()}
    assert a == b and len(a) == 50


def test_population_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 2.0)], "a double, b double, c double")
    out = StandardScale(columns=["a", "b", "c"]).fit(df).transform(df).collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0, None), (1.0, 0.0, 0.0)]


def likelihood(x, lam):
    y = np.where(x >= 0, ((x + 1) ** lam - 1) / lam if lam else np.log1p(x), 0)
    return -len(x) / 2 * np.log(y.var()) + (lam - 1) * np.log1p(x).sum()


def test_power_transform_finds_the_likeliest_lambda(spark, tmp_path):
    x = np.exp(np.random.default_rng(3).normal(2, 1, 400))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    model = PowerTransform(columns=["x"]).fit(df)
    grid = np.arange(-1, 1, 0.001)
    want = grid[np.argmax([likelihood(x, g) for g in grid])]
    assert model.lambdas()["x"] == pytest.approx(want, abs=2e-3)
    model.write().save(str(tmp_path / "p"))
    z = PowerTransformModel.load(str(tmp_path / "p")).transform(df).toPandas()["x_norm"]
    assert z.mean() == pytest.approx(0, abs=1e-9) and z.std(ddof=0) == pytest.approx(1)


def test_power_transform_stands_on_the_peak(spark):
    rng = np.random.default_rng(8)
    columns = {
        "wide": np.exp(rng.normal(9, 2, 500)), "below": -np.exp(rng.normal(1, 1, 500)), "both": rng.normal(0, 50, 500) ** 3, "steep": 10 * rng.uniform(size=500) ** (1 / 9),
        "same": np.full(500, 7.0), "two": (rng.uniform(size=500) < 0.2).astype(float),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).withColumn("none", F.lit(None).cast("double"))
    lams = PowerTransform(columns=[*columns, "none"], standardize=False).fit(df).lambdas()
    assert lams["same"] == lams["none"] == 1.0

    def plain(x, lam):
        with np.errstate(all="ignore"):
            up = ((1 + np.abs(x)) ** lam - 1) / lam
            down = -((1 + np.abs(x)) ** (2 - lam) - 1) / (2 - lam)
        y = np.where(x >= 0, up, down)
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    for c in ("wide", "below", "both", "steep", "two"):
        here = plain(columns[c], lams[c])
        assert all(here >= plain(columns[c], lams[c] + d) - 1e-9 for d in (-0.3, -1e-3, 1e-3, 0.3)), c
    slopes = likelihoods(df, lams)
    assert all(abs(slopes[c].slope) < 1e-6 for c in ("wide", "below", "both", "steep", "two"))
    stepped = PowerTransform(columns=["wide", "steep"], step=0.25, standardize=False).fit(df).lambdas()
    for c, lam in stepped.items():
        assert lam == max(np.arange(-8, 61) * 0.25, key=lambda g: plain(columns[c], g if g else 1e-9))


def test_column_transformer(spark):
    df = spark.createDataFrame(
        [(1, 0, 1.0, "a"), (2, 1, None, "b"), (3, 1, 3.0, None)], "ID int, Target int, x double, c string")
    model = column_transformer(["x"], ["c"], "most_frequent").fit(df)
    got = [list(r["features"].toArray()) for r in model.transform(df).orderBy("ID").collect()]
    s = np.sqrt(1.5)
    assert got == [pytest.approx([-s, 1, 0]), pytest.approx([0, 0, 1]), pytest.approx([s, 1, 0])]
    assert most_frequent(df, ["c"]) == {"c": "a"}


def test_power_transform_finds_a_peak_outside_the_first_grid(spark):
    rows = [(10 * ((i + 0.5) / 400) ** (1 / 6),) for i in range(400)]
    model = PowerTransform(columns=["x"], standardize=False).fit(spark.createDataFrame(rows, "x double"))
    assert 4.5 < model.state()["x"][0] < 4.9
