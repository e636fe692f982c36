import re

import pytest

from buyerscope import schema as S
from buyerscope.operators.cleaning import POSITION
from buyerscope.sources import sinks
from buyerscope.sources.customers import read_bundle, read_customers, read_dated, read_inferred
from buyerscope.sources.wide import CARRY, customer_360, order_lines, table
from pyspark.sql import functions as F

HEADER = ("ID,Year_Birth,Education,Marital_Status,Income,Kidhome,Teenhome,Dt_Customer,Recency,MntWines,MntFruits,"
          "MntMeatProducts,MntFishProducts,MntSweetProducts,MntGoldProds,NumDealsPurchases,NumWebPurchases,"
          "NumCatalogPurchases,NumStorePurchases,NumWebVisitsMonth,AcceptedCmp3,AcceptedCmp4,AcceptedCmp5,"
          "AcceptedCmp1,AcceptedCmp2,Complain,Z_CostContact,Z_Revenue,Target")
GOOD = "5524,1957,Graduation,Single,58138.0,0,0,4/9/2012,58,635,88,546,172,88,88,3,8,10,4,7,0,0,0,0,0,0,3,11,1"
HOLES = "2174,1954,Unknown,na,N/A,1,1,21-08-2013,38,,1,6,2,1,6,2,1,1,2,5,0,0,0,0,0,0,3,11,0"


def write(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_typed_scan_with_missing_tokens(spark, tmp_path):
    df = read_customers(spark, write(tmp_path / "t.csv", GOOD, HOLES), keep_position=True)
    assert [f.dataType for f in df.schema.fields[:-1]] == [f.dataType for f in S.raw_schema().fields]
    first, second = df.orderBy(POSITION).collect()
    assert first["ID"] == 5524 and first["Income"] == 58138.0 and first["Dt_Customer"] == "4/9/2012"
    assert second["Education"] is None and second["Marital_Status"] is None
    assert second["Income"] is None and second["MntWines"] is None


@pytest.mark.parametrize("bad", [GOOD.replace("1957", "soon"), GOOD.replace(",58,", ",,")])
def test_strict_scan_fails_on_misfits(spark, tmp_path, bad):
    path = write(tmp_path / "t.csv", bad)
    with pytest.raises(Exception, match="not a int|missing value"):
        read_customers(spark, path).collect()
    assert read_customers(spark, path, strict=False).count() == 1


def test_dated_and_inferred_scans(spark, tmp_path):
    path = write(tmp_path / "t.csv", GOOD, HOLES)
    dated = {r["ID"]: str(r["Dt_Customer"]) for r in read_dated(spark, path).collect()}
    assert dated == {5524: "2012-09-04", 2174: "2013-08-21"}
    assert dict(read_inferred(spark, path).dtypes)["Recency"] == "int"


def test_bundle_splits_by_class(spark, tmp_path):
    rows = [GOOD.replace("5524", str(i))[:-1] + str(i % 2) for i in range(20)]
    path = write(tmp_path / "t.csv", *rows)
    train, val, test, sample = read_bundle(spark, path, path, path, 0.2)
    assert (train.count(), val.count(), test.count(), sample.count()) == (16, 4, 20, 20)
    assert {r[0]: r[1] for r in val.groupBy("Target").count().collect()} == {0: 2, 1: 2}
    assert read_bundle(spark, path, path, path, 0)[1] is None


def test_wide_record_keeps_every_customer(spark, folder):
    wide = customer_360(spark, folder)
    assert wide.count() == table(spark, folder, "customer").count()
    assert wide.select("ID").distinct().count() == wide.count()


def test_one_row_per_order_whatever_the_skew(spark):
    lines = spark.range(300).select(
        (F.col("id") % 100).alias("l_orderkey"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("l_partkey"),
        F.lit(10.0).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"),
    )
    parts = spark.range(7).select(F.col("id").alias("p_partkey"), F.lit("ECONOMY").alias("p_type"))
    units = F.col("MntWines_high") * CARRY + F.col("MntWines_low")
    got = order_lines(lines, parts).agg(F.count("*"), F.sum(units), F.sum("deals")).first()
    assert tuple(got) == (100, 300 * 9 * 10_000, 300)


def test_lines_are_shuffled_narrow_and_sums_are_not(spark):
    lines = spark.createDataFrame(
        [(1, 1, 10.0, 0.1), (1, 2, 20.0, None), (1, 3, None, 0.0), (2, 3, 5.0, 0.0), (2, 9, 7.0, 0.1), (None, 1, 1.0, 0.0)],
        "l_orderkey long, l_partkey long, l_extendedprice double, l_discount double",
    )
    parts = spark.createDataFrame([(1, "ECONOMY"), (2, "LARGE"), (3, "other"), (3, None)], "p_partkey long, p_type string")
    got = order_lines(lines, parts)
    text = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    by_order = [c for c in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(l_orderkey", text)]
    assert len(by_order) == 1 and len(by_order[0].split(", ")) == 4
    found = {r["l_orderkey"]: (r["MntWines_high"], r["MntWines_low"], r["MntFruits_low"], r["deals"]) for r in got.collect()}
    assert found == {1: (0, 90_000, None, 1), 2: (None, None, None, 0), None: (0, 10_000, None, 0)}


def test_sinks_round_trip(spark, tmp_path):
    scored = spark.createDataFrame([(1, 1.0, 0.9), (2, 0.0, 0.2)], "ID int, prediction double, p double")
    table_ = sinks.prediction_table(scored, probability="p")
    assert table_.columns == ["ID", "Target", "Probability"]
    sinks.write_table(sinks.prediction_table(scored), str(tmp_path / "out"), "csv")
    back = spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).orderBy("ID").collect()
    assert [tuple(r) for r in back] == [(1, 1), (2, 0)]
    template = spark.createDataFrame([(2,), (1,), (3,)], "ID int")
    filled = {r["ID"]: r["Target"] for r in sinks.fill_template(template, table_).collect()}
    assert filled == {1: 1, 2: 0, 3: None}
    log = str(tmp_path / "log")
    metrics = spark.createDataFrame([(0.5,)], "accuracy double")
    sinks.append_metrics(metrics, log, "a")
    sinks.append_metrics(metrics, log, "b")
    assert spark.read.parquet(log).count() == 2
    record = sinks.experiment_record(spark, best_model="a", best_metrics={"f1": 0.5}, features=["x"])
    sinks.write_experiment(record, str(tmp_path / "runs"))
    assert spark.read.schema(sinks.EXPERIMENT_SCHEMA).json(str(tmp_path / "runs")).first()["best_metrics"] == {"f1": 0.5}
    assert [r["ID"] for r in sinks.head_sample(scored, n=1).collect()] == [1]
