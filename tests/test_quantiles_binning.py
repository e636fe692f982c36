import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from buyerscope.operators.binning import cut, cut_index, equal_width_bin, quantile_edges
from buyerscope.operators.quantiles import _Bracket, _halve, exact_quantiles, medians

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.995, 1.0]


def cases():
    rng = np.random.default_rng(1)
    hot = np.concatenate([np.full(400, 7.0), rng.normal(size=600)])
    narrow = np.concatenate([rng.uniform(0, 1e-9, 900), rng.uniform(0, 1e9, 100)])
    return {"normal": rng.normal(size=1000), "hot": hot, "narrow": narrow, "ints": rng.integers(0, 9, 1000) * 1.0}


@pytest.mark.parametrize("name", list(cases()))
def test_bracketed_quantiles_are_exact(spark, name):
    values = cases()[name]
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(7)
    direct = exact_quantiles(df, {"x": ("x", QS)})["x"]
    large = exact_quantiles(df, {"x": ("x", QS)}, bracket_rows=40, accuracy=50)["x"]
    assert direct == pytest.approx(np.quantile(values, QS))
    assert large == pytest.approx(direct, rel=1e-12)


def test_bisection_finds_any_rank(spark):
    values = np.concatenate([np.full(30, 2.5), [1e-300, 1.0, 7.0, 1e300]])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    column = F.col("x")
    for rank in (0, 1, 2, 31, 32, 33):
        bracket = _Bracket(column, rank, len(values))
        _halve(df, bracket)
        assert bracket.value == np.sort(values)[rank]


def test_quantiles_of_several_columns_and_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "a double, b double")
    got = exact_quantiles(df, {"a": ("a", [0.5]), "b": ("b", [0.5, 0.9]), "c": (F.col("a") * 2, [0.25])})
    assert got == {"a": [2.0], "b": [None, None], "c": [3.0]}
    assert exact_quantiles(df, {"b": ("b", [0.5])}) == {"b": [None]}
    assert medians(df, ["a"]) == {"a": 2.0}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=12, max_size=60))
def test_quantile_bins_match_pandas(spark, values):
    series = pd.Series(values, dtype="float64")
    if series.nunique() < 2:
        return
    want = pd.qcut(series, 5, labels=False, duplicates="drop")
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "x": series}))
    edges = quantile_edges(df, {"x": ("x", 5, True)})["x"]
    got = df.select("i", cut_index("x", edges, include_lowest=True).alias("b")).orderBy("i").toPandas()["b"]
    assert got.tolist() == want.tolist()


def test_duplicate_edges_are_an_error_unless_merged(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "x double")
    with pytest.raises(ValueError, match="unique"):
        quantile_edges(df, {"x": ("x", 5, False)})
    assert quantile_edges(df, {"x": ("x", 5, True)})["x"][0] == 1.0


def test_fixed_edges_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (25.0,), (25.1,), (35.0,), (36.0,), (None,)], "x double")
    got = [r[0] for r in df.select(cut("x", [0, 25, 35], ["a", "b"])).collect()]
    assert got == [None, "a", "a", "b", "b", None, None]
    clamped = [r[0] for r in df.select(cut_index("x", [0, 25, 35], clamp=True)).collect()]
    assert clamped == [0, 0, 0, 1, 1, 1, None]


def test_equal_width_bins(spark):
    df = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (10.0,)], "x double")
    assert [r[0] for r in df.select(equal_width_bin("x", 0, 10, 2)).collect()] == [0, 0, 1, 1]
    assert [r[0] for r in df.select(equal_width_bin(F.lit(3.0), 3, 3, 4)).limit(1).collect()] == [2]


@pytest.mark.parametrize("bracket_rows", [1, 7, 1_000_000])
def test_every_bracket_size_gives_the_same_bits(spark, bracket_rows):
    inf, nan = float("inf"), float("nan")
    data = [float(i) for i in range(10)] + [nan, nan, nan, inf, -inf, 5.0, 5.0, 5.0, 5e-324, 1e-323]
    df = spark.createDataFrame([(x, 1.0 if i % 2 else inf) for i, x in enumerate(data)], "x double, two double")
    qs = [0.0, 0.05, 0.1, 0.33, 0.5, 0.75, 0.8, 0.95, 1.0]
    got = exact_quantiles(df, {"x": ("x", qs), "two": ("two", [0.25, 0.5, 0.75])}, bracket_rows=bracket_rows, accuracy=5)
    ordered = sorted(data, key=lambda v: (v != v, v))
    for q, value in zip(qs, got["x"], strict=True):
        at = q * (len(data) - 1)
        a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
        want = a if a == b or at == int(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b
        assert value == want or (value != value and want != want)
    assert got["two"] == [1.0, inf, inf]
