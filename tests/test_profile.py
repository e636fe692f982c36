import numpy as np
import pandas as pd
import pytest

from buyerscope.operators import profile as P
from buyerscope.operators.correlation import correlation_extremes, correlation_matrix, target_correlations


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=200)
    out = pd.DataFrame({"Target": (x + rng.normal(size=200) > 0).astype(int), "x": x * 3 + 1e6, "y": rng.integers(0, 5, 200) * 1.0,
                        "c": 3.0})
    out.loc[::7, "y"] = np.nan
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, "Target int, x double, y double, c double")


def test_correlations_match_pandas(df, data):
    want = data.corr()
    got = {(r[0], r[1]): r[2] for r in correlation_matrix(df).collect()}
    assert len(got) == 16
    for a in data:
        for b in data:
            if "c" in (a, b):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)
    ranked = target_correlations(df)
    assert ranked.first()["feature"] == "Target"
    sides = correlation_extremes(ranked, n=1).collect()
    assert [r["feature"] for r in sides] == ["x", "y"]


def test_describe_matches_pandas(df, data):
    got = {r["column"]: r for r in P.describe(df, ["x", "y"]).collect()}
    want = data.describe()
    for c in ("x", "y"):
        assert [got[c][k] for k in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(
            want[c].tolist())


def test_histogram_matches_numpy(df, data):
    got = {r["bin"]: r["n"] for r in P.histogram(df, ["x"], 10).collect()}
    counts, _ = np.histogram(data["x"], 10)
    assert [got.get(i, 0) for i in range(10)] == counts.tolist()
    assert sum(r["n"] for r in P.histogram(df, ["y"], 10).collect()) == data["y"].notna().sum()


def test_density_matches_direct_sum(df, data):
    got = P.density(df, "x", 30).orderBy("x").toPandas()
    x = data["x"].to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    want = [np.exp(-(((g - x) / h) ** 2) / 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)) for g in got["x"]]
    assert got["density"].tolist() == pytest.approx(want)


def test_boxes(df, data):
    got = {(r["column"], r["label"]): r for r in P.boxplot(df, ["x"]).collect()}
    part = data.loc[data["Target"] == 1, "x"]
    q1, q3 = part.quantile([0.25, 0.75])
    inside = part[(part >= q1 - 1.5 * (q3 - q1)) & (part <= q3 + 1.5 * (q3 - q1))]
    box = got["x", 1]
    assert (box["q1"], box["q3"]) == (pytest.approx(q1), pytest.approx(q3))
    assert (box["low_whisker"], box["high_whisker"]) == (inside.min(), inside.max())
    assert box["n_outliers"] == len(part) - len(inside)


def test_shares(df, data):
    counts = {r["value"]: (r["n"], r["ratio"]) for r in P.value_counts(df, "Target").collect()}
    assert counts["1"] == (data["Target"].sum(), pytest.approx(data["Target"].mean()))
    table = {r["value"]: r["share_1"] for r in P.crosstab(df, "y").collect()}
    want = data.groupby("y")["Target"].mean()
    assert table["2.0"] == pytest.approx(want[2.0])
    assert [r["column"] for r in P.constant_columns(df).collect()] == ["c"]
    assert P.shape(df).first().asDict() == {"n_rows": 200, "n_columns": 4}
    assert P.best_row(df.select("x", "y"), "x", "y").first()["x"] == data["x"].max()
    assert P.top_values(df, "x", 3, "y").count() == 3
    assert dict((r[0], r[1]) for r in P.column_types(df).collect())["Target"] == "int"
