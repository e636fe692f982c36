import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from buyerscope.functions import dates as D
from buyerscope.functions import expressions as X


def one(spark, values, schema, *columns):
    return spark.createDataFrame([values], schema).select(*columns).first()


def test_row_functions_skip_nulls(spark):
    got = one(spark, (1.0, None, 4.0), "a double, b double, c double",
              X.row_sum(["a", "b", "c"]), X.row_mean(["a", "b", "c"]), X.row_std(["a", "b", "c"]))
    assert got[0] == 5.0 and got[1] == 2.5
    assert got[2] == pytest.approx(math.sqrt(4.5))


def test_row_functions_without_values(spark):
    got = one(spark, (None, None), "a double, b double", X.row_sum(["a", "b"]), X.row_mean(["a", "b"]), X.row_std(["a", "b"]))
    assert tuple(got) == (0.0, None, None)


def test_ratio_treats_zero_divisor_as_one(spark):
    got = one(spark, (3, 0, None), "a int, b int, c int", X.ratio("a", "b"), X.ratio("a", "c"), X.smoothed_ratio("a", "b"))
    assert tuple(got) == (3.0, None, 3.0)


def test_clips_keep_nulls(spark):
    got = one(spark, (-2.0, None, 9.0), "a double, b double, c double",
              X.at_least("a", 0.0), X.at_least("b", 0.0), X.at_most("c", 5.0), X.at_most("c", None))
    assert tuple(got) == (0.0, None, 5.0, 9.0)


def test_flag_of_unknown_is_zero(spark):
    assert one(spark, (None,), "a int", X.flag(F.col("a") > 1))[0] == 0


def test_lookup_default(spark):
    got = one(spark, ("PhD", "none", None), "a string, b string, c string",
              *[X.lookup(c, {"PhD": 4}, -1) for c in "abc"])
    assert tuple(got) == (4, -1, -1)


def test_yeo_johnson_special_lambdas(spark):
    got = one(spark, (3.0, -3.0), "a double, b double",
              X.yeo_johnson("a", 0.0), X.yeo_johnson("b", 2.0), X.yeo_johnson("a", 1.0), X.yeo_johnson("b", 1.0),
              X.yeo_johnson_slopes(F.col("b"), 0.5)[0])
    assert got[0] == pytest.approx(math.log(4)) and got[1] == pytest.approx(-math.log(4))
    assert got[2] == pytest.approx(3.0) and got[3] == pytest.approx(-3.0)
    assert got[4] == pytest.approx(-((4**1.5) - 1) / 1.5)


@pytest.mark.parametrize("lam", [-3.0, -1e-4, 0.0, 1e-9, 0.02, 0.7, 1.0, 1.9999, 2.0, 4.5])
def test_yeo_johnson_slopes_are_derivatives(spark, lam):
    """Against sums over small steps of the integrals that define them."""
    values = [0.0, 1e-3, 0.4, 3.0, 900.0, -0.4, -3.0, -900.0]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for x, *got in df.select("x", *X.yeo_johnson_slopes(F.col("x"), lam)).collect():
        v, u, sign = (2 - lam, math.log1p(-x), -1) if x < 0 else (lam, math.log1p(x), 1)
        n = 20_000
        t = [(i + 0.5) * u / n for i in range(n)]
        for k, value in enumerate(got):
            want = (sign if k != 1 else 1) * math.fsum(w**k * math.exp(v * w) for w in t) * u / n
            assert value == pytest.approx(want, rel=1e-6, abs=1e-12), (x, k)


def test_first_fitting_format_wins(spark):
    rows = [("21-08-2013",), ("4/9/2012",), ("13/2/2014",), ("garbage",), (None,)]
    df = spark.createDataFrame(rows, "d string")
    day_first = [r[0] for r in df.select(D.parse_dates("d")).collect()]
    assert day_first == [dt.date(2013, 8, 21), dt.date(2012, 9, 4), dt.date(2014, 2, 13), None, None]
    month_first = [r[0] for r in df.select(D.parse_dates("d", ["M/d/yyyy"])).collect()]
    assert month_first == [None, dt.date(2012, 4, 9), None, None, None]


@pytest.mark.parametrize(
    "text, fmt, days",
    [
        ("4/9/2012", "M/d/yyyy", 4762),
        ("8/3/2014", "M/d/yyyy", 3916),
        ("10/2/2014", "M/d/yyyy", 3856),
        ("15-04-2014", "dd-MM-yyyy", 4026),
        ("27-09-2012", "dd-MM-yyyy", 4591),
        ("27-03-2013", "dd-MM-yyyy", 4410),
    ],
)
def test_golden_tenures(spark, text, fmt, days):
    got = one(spark, (text,), "d string", D.tenure_days(D.parse_dates("d", [fmt]), "2025-04-23"))
    assert got[0] == days


def test_calendar_parts(spark):
    got = one(spark, (dt.date(2013, 8, 24),), "d date", *[c.alias(n) for n, c in D.calendar_parts("d").items()]).asDict()
    assert got == {"Enroll_Year": 2013, "Enroll_Month": 8, "Enroll_Quarter": 3, "Enroll_Day": 24,
                   "Enroll_DayOfWeek": 5, "Enroll_Weekend": 1}
