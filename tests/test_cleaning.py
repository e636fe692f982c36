import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from buyerscope.operators import cleaning
from buyerscope.operators import quality as Q
from buyerscope.operators.cleaning import Cleaner, CleanerModel, keep_first
from buyerscope.operators.quantiles import medians
from buyerscope.operators.transform import FillMissing

COLUMNS = ("ID int, Year_Birth int, Education string, Income double, Dt_Customer date, Recency int, MntWines double, "
           "Complain int, Target int, pos int")
ROWS = [
    (1, 1850, "PhD", 100.0, dt.date(2013, 1, 1), 5, 10.0, 0, 1, 0),
    (2, 1990, None, None, None, -3, None, 2, 0, 1),
    (3, 2020, "Basic", 300.0, dt.date(2013, 1, 4), 7, -1.0, 1, 0, 2),
    (3, 1999, "Basic", 900.0, dt.date(2013, 1, 4), 9, 30.0, 1, 1, 3),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_steps_in_order(raw):
    model = Cleaner(as_of="2025-04-23", order=["pos"]).fit(raw)
    got = {r["ID"]: r.asDict() for r in model.transform(raw).collect()}
    assert sorted(got) == [1, 2, 3]
    # Median of 100, 300, 900; the cap is taken after imputation.
    assert got[2]["Income"] == 300.0
    assert got[2]["Education"] == "Unknown" and got[2]["Recency"] == 0
    assert got[1]["Year_Birth"] == 1925 and got[3]["Year_Birth"] == 2007
    assert {i: r["Complain"] for i, r in got.items()} == {1: 0, 2: 1, 3: 1}
    # The first of the two rows of customer 3 stays, its negative amount raised to 0.
    assert got[3]["pos"] == 2 and got[3]["MntWines"] == 0.0
    # Left-over null: median of the de-duplicated 10 and 0.
    assert got[2]["MntWines"] == 5.0
    days = (dt.date(2025, 4, 23) - dt.date(2013, 1, 4)).days
    assert got[2]["Days_Since_Registration"] == days and "Dt_Customer" not in got[2]


def test_cap_uses_imputed_income(raw):
    state = Cleaner(order=["pos"]).fit(raw).state()
    assert state["income"] == 300.0
    assert state["income_cap"] == pytest.approx(900 - 600 * 3 * 0.005)
    assert state["coerced"] == ["Complain"]


def test_audit_counts(raw):
    model = Cleaner(as_of="2025-04-23", order=["pos"]).fit(raw)
    got = {(r["step"], r["column"]): r["n_changed"] for r in model.audit(raw).collect()}
    assert got["fill_date", "Dt_Customer"] == 1 and got["fill_income", "Income"] == 1
    assert got["clip_negative", "Recency"] == 1 and got["clip_negative", "MntWines"] == 1
    assert got["clamp_birth_year", "Year_Birth"] == 2 and got["coerce_binary", "Complain"] == 1
    assert got["drop_duplicates", "ID"] == 1 and got["cap_income", "Income"] == 1


def test_model_applies_to_other_data_and_survives_saving(spark, raw, tmp_path):
    model = Cleaner(order=["pos"]).fit(raw)
    model.write().save(str(tmp_path / "m"))
    back = CleanerModel.load(str(tmp_path / "m"))
    other = spark.createDataFrame([(9, 1980, None, None, None, 1, 2.0, 0, 7)],
                                  "ID int, Year_Birth int, Education string, Income double, Dt_Customer date, "
                                  "Recency int, MntWines double, Complain int, pos int")
    assert back.transform(other).first()["Income"] == 300.0


def test_keep_first_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"),
                                  (F.lit(10_000) - F.col("id")).alias("pos"))
    got = keep_first(df.repartition(9), ["k"], ["pos"])
    assert got.count() == 2001
    assert got.where("k = -1").first()["pos"] == 10_000 - 2997


def test_imputers(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), ("b", 3.0), ("a", 4.0), (None, 10.0)], "c string, x double")
    for strategy, column, want in (("most_frequent", "c", "a"), ("constant", "c", "Unknown"), ("median", "x", 3.5)):
        out = FillMissing(columns=[column], strategy=strategy).fit(df).transform(df)
        filled = out.join(df.withColumnRenamed("c", "c0").withColumnRenamed("x", "x0"), F.expr("x <=> x0 or c <=> c0"))
        assert want in [r[column] for r in out.collect()] and filled.count() > 0


def test_quality_reports(spark, raw):
    nulls = {r["column"]: (r["count"], r["percentage"]) for r in Q.null_profile(raw).collect()}
    assert nulls["Income"] == (1, 25.0) and "ID" not in nulls
    assert Q.duplicate_count(raw, ["ID"]).first().asDict() == {"n_rows": 4, "n_keys": 3, "n_duplicates": 1}
    assert Q.leakage_check(raw, raw.where("ID = 3")).first()["n_overlap"] == 1
    assert [r[0] for r in Q.shared_keys(raw, raw.where("ID = 3")).collect()] == [3]
    bounds = {r["column"]: r["n_outside"] for r in Q.out_of_bounds(raw, {"Recency": (0, 8)}).collect()}
    assert bounds == {"Recency": 2}
    aligned = Q.align_schema(raw, ["Missing", "Income"], ["ID"])
    assert aligned.columns == ["ID", "Missing", "Income"] and aligned.first()["Missing"] == 0
    with pytest.raises(ValueError, match="Nope"):
        Q.require_columns(raw, ["ID", "Nope"])
    assert Q.column_difference(raw.select("ID", "pos"), raw.select("ID")) == (["pos"], [])
    assert Q.append_rows(raw.select("ID"), raw.select("pos")).columns == ["ID", "pos"]
    assert Q.zero_fill(raw, ["Income"]).where("ID = 2").first()["Income"] == 0.0
    assert Q.columns_with_prefix(raw, "Mnt") == ["MntWines"]


def _exchanges(df):
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)


def test_a_row_that_is_its_own_order_travels_once(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 1, "b"), (1, None, "c"), (2, 5, "d"), (None, 7, "e"), (None, 6, "f")], "k int, a int, b string")
    got = keep_first(df.repartition(3), ["k"], ["a", "b"])
    assert len(_exchanges(keep_first(df, ["k"], ["a", "b"]))[0].split(", ")) == 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None, "c"), (2, 5, "d"), (None, 6, "f")], key=str)


def test_medians_read_rows_that_were_reduced_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(cleaning, "medians", lambda df, names: read.append((_exchanges(df), names)) or medians(df, names))
    # The second row of key 1 is dropped: only "a" still holds a null, and the median is that of the other rows.
    df = spark.createDataFrame([(1, 1, 1), (1, 9, None), (2, None, 2), (3, 3, 3), (4, 4, 4)], "ID int, a int, b int")
    model = Cleaner().fit(df)
    assert read == [([], ["a"])]
    assert model.state()["residual"] == {"a": 3.0}
