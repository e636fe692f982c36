import datetime as dt
import math

import pandas as pd
import pytest

from buyerscope import schema as S
from buyerscope.features.core import CoreFeatures, CoreFeaturesModel
from buyerscope.features.rfm import RfmFeatures, RfmFeaturesModel
from buyerscope.features.variants import CompactFeatures, LeanFeatures
from buyerscope.operators.onehot import OneHot, fit_vocabulary

NAMES = ["ID", "Year_Birth", "Education", "Marital_Status", "Income", "Kidhome", "Teenhome", "Recency", *S.SPEND,
         S.DEALS, *S.CHANNELS, S.VISITS, *S.CAMPAIGNS, "Complain", "Days_Since_Registration"]
# Golden records and their features.
ROWS = [
    (4390, 1954, "Graduation", "Together", 75315.0, 0, 1, 14, 459.0, 15.0, 171.0, 142.0, 23.0, 31.0, 2, 5, 4, 12, 2,
     0, 0, 0, 0, 0, 0, 4026),
    (10478, 1950, "PhD", "Married", 55517.0, 1, 1, 53, 483.0, 0.0, 108.0, 0.0, 6.0, 36.0, 5, 11, 1, 6, 9,
     0, 0, 0, 0, 0, 0, 4591),
    (1081, 1957, "PhD", "Married", 75283.0, 1, 2, 26, 733.0, 9.0, 180.0, 12.0, 19.0, 66.0, 11, 6, 3, 5, 4,
     0, 0, 0, 0, 0, 0, 4410),
    (4261, 1946, "PhD", "Single", 82800.0, 0, 0, 23, 1006.0, 22.0, 115.0, 59.0, 68.0, 45.0, 1, 7, 6, 12, 3,
     1, 0, 0, 0, 1, 0, 4533),
    (9916, 1954, "Graduation", "Married", 38998.0, 1, 1, 92, 34.0, 1.0, 14.0, 0.0, 0.0, 5.0, 3, 2, 0, 3, 8,
     0, 0, 0, 0, 0, 1, 4302),
]
GOLDEN = {
    "Age": [71, 75, 68, 79, 71],
    "FamilySize": [2, 3, 4, 1, 3],
    "ChildAdultRatio": [1.0, 2.0, 3.0, 0.0, 2.0],
    "HasChildren": [1, 1, 1, 0, 1],
    "IncomePerMember": [37657.5, 18505.666666666668, 18820.75, 82800.0, 12999.333333333334],
    "TotalSpent": [841, 633, 1019, 1315, 54],
    "WinesRatio": [0.5457788, 0.76303315, 0.7193327, 0.765019, 0.6296296],
    "GoldProdsRatio": [0.03686088, 0.056872036, 0.06476938, 0.03422053, 0.09259259],
    "SpentPerPerson": [420.5, 211.0, 254.75, 1315.0, 18.0],
    "SpendingVolatility": [169.65897, 189.4748, 283.39752, 386.69647, 13.356646],
    "TotalPurchases": [21, 18, 14, 25, 5],
    "WebRatio": [0.23809523809523808, 0.6111111111111112, 0.42857142857142855, 0.28, 0.4],
    "CatalogRatio": [0.19047619047619047, 0.05555555555555555, 0.21428571428571427, 0.24, 0.0],
    "StoreRatio": [0.5714285714285714, 0.3333333333333333, 0.35714285714285715, 0.48, 0.6],
    "AvgBasketSize": [40.04761904761905, 35.166666666666664, 72.78571428571429, 52.6, 10.8],
    "WebEngagementRatio": [0.4, 0.8181818181818182, 0.6666666666666666, 0.42857142857142855, 4.0],
    "TotalAcceptedCampaigns": [0, 0, 0, 2, 0],
    "CampaignAcceptanceRate": [0.0, 0.0, 0.0, 0.4, 0.0],
    "TenureYears": [11.02258726899384, 12.569472963723477, 12.073921971252567, 12.410677618069816, 11.7782340862423],
    "PurchaseFrequency": [1.9051788375558867, 1.4320409496841646, 1.1595238095238096, 2.0143944407677035, 0.4245118549511855],
    "DealRatio": [0.09523809523809523, 0.2777777777777778, 0.7857142857142857, 0.04, 0.6],
    "RecencyRatio": [0.003477396920019871, 0.011544325854933566, 0.0058956916099773245, 0.0050739024928303554, 0.021385402138540215],
    "Age_x_Income": [5347.365, 4163.775, 5119.244, 6541.2, 2768.858],
    "WebEngagement_x_Age": [0.284, 0.6136363636363636, 0.4533333333333333, 0.3385714285714286, 2.84],
    "Education_PhD": [0, 1, 1, 1, 0],
    "Education_Unknown": [0, 0, 0, 0, 0],
    "Marital_Status_Single": [0, 0, 0, 1, 0],
    "Marital_Status_Together": [1, 0, 0, 0, 0],
}


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(pd.DataFrame(ROWS, columns=NAMES))


def test_core_features_match_the_golden_records(spark, records, tmp_path):
    model = CoreFeatures(as_of_year=2025).fit(records)
    model.write().save(str(tmp_path / "core"))
    out = CoreFeaturesModel.load(str(tmp_path / "core")).transform(records).toPandas().set_index("ID")
    for name, want in GOLDEN.items():
        assert out.loc[[r[0] for r in ROWS], name].tolist() == pytest.approx(want, rel=1e-6), name
    # The first level of each category has no column; the birth year is gone.
    assert not {"Education_Graduation", "Marital_Status_Married", "Year_Birth"} & set(out.columns)


def test_unseen_level_gives_zeros(spark, records):
    model = CoreFeatures(as_of_year=2025).fit(records)
    other = records.limit(1).replace("Graduation", "2n Cycle", ["Education"])
    row = model.transform(other).first().asDict()
    assert {v for k, v in row.items() if k.startswith("Education_")} == {0}


def with_dates(spark, n=60):
    rows = []
    for i in range(n):
        base = list(ROWS[i % 5])
        base[0] = i
        base[1] = 1940 + i
        base[4] = base[4] + 37.0 * i
        base[7] = i
        base[8] = base[8] + 3.0 * i
        rows.append((*base, dt.date(2012, 1, 1) + dt.timedelta(days=7 * i), 3, 11, i % 2))
    return spark.createDataFrame(pd.DataFrame(rows, columns=[*NAMES, "Dt_Customer", *S.CONSTANTS, S.LABEL]))


def test_behavioural_features_match_pandas(spark):
    df = with_dates(spark)
    out = RfmFeatures(as_of="2023-01-01", encode=False, scale=False).fit(df).transform(df).toPandas().sort_values("ID")
    raw = df.toPandas().sort_values("ID")
    spend = raw[S.SPEND].sum(axis=1)
    buys = raw[S.CHANNELS].sum(axis=1)
    assert out["Total_Spent"].tolist() == pytest.approx(spend.tolist())
    assert out["Spending_CV"].tolist() == pytest.approx((raw[S.SPEND].std(axis=1) / (raw[S.SPEND].mean(axis=1) + 1)).tolist())
    assert out["R_Score"].tolist() == (4 - pd.qcut(raw["Recency"], 5, labels=False)).tolist()
    assert out["F_Score"].tolist() == pd.qcut(buys.clip(lower=1), 5, labels=False, duplicates="drop").tolist()
    assert out["Customer_Value"].tolist() == pd.qcut(spend, 3, labels=["Low", "Medium", "High"]).tolist()
    assert out["Age_Bin"].tolist() == pd.cut(
        2023 - raw["Year_Birth"], [0, 25, 35, 45, 55, 65, 100],
        labels=["GenZ", "Millennial", "GenX_Young", "GenX_Old", "Boomer", "Senior"]).tolist()
    assert out["RFM_Score"].tolist() == (out["R_Score"] + out["F_Score"] + out["M_Score"]).tolist()


def test_behavioural_model_keeps_its_training_values(spark, tmp_path):
    df = with_dates(spark)
    model = RfmFeatures(as_of="2023-01-01").fit(df)
    model.write().save(str(tmp_path / "rfm"))
    back = RfmFeaturesModel.load(str(tmp_path / "rfm"))
    one = df.where("ID = 3")
    alone, together = back.transform(one).first().asDict(), model.transform(df).where("ID = 3").first().asDict()
    assert alone == together
    assert any(c.endswith("_scaled") for c in alone) and alone["Age_Bin_nan"] in (0, 1)
    scaled = model.transform(df).toPandas()["Luxury_Ratio_scaled"]
    assert scaled.mean() == pytest.approx(0, abs=1e-9) and scaled.std(ddof=0) == pytest.approx(1)


def test_life_stages(spark):
    from buyerscope.features.rfm import lifecycle

    rows = [(30, 0, 0, 0, 0), (40, 0, 1, 0, 0), (40, 1, 0, 1, 0), (40, 1, 0, 0, 1), (60, 0, 0, 0, 0), (45, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "Age int, Total_Children int, Has_Partner int, Kidhome int, Teenhome int")
    assert [r[0] for r in df.select(lifecycle()).collect()] == [
        "Young_Single", "Young_Couple", "Parents_Young", "Parents_Teen", "Empty_Nest", "Other"]


def test_variants(spark):
    df = with_dates(spark)
    compact = CompactFeatures(as_of_year=2025).fit(df).transform(df.withColumnRenamed("Days_Since_Registration", "d"))
    row = compact.orderBy("Age").limit(1).toPandas().iloc[0]
    assert "ID" not in compact.columns and row["EnrollMonth_sin"] ** 2 + row["EnrollMonth_cos"] ** 2 == pytest.approx(1)
    assert {r[0] for r in compact.select("HighIncome_LowSpending").collect()} <= {0, 1}
    lean = LeanFeatures(as_of="2025-04-23").transform(df)
    shares = lean.select(*[f"{c}_Pct" for c in S.SPEND]).toPandas().sum(axis=1)
    assert all(math.isclose(s, 1.0) for s in shares) and "Kidhome" not in lean.columns


def test_vocabulary_is_bounded_by_error(spark):
    df = spark.range(50).selectExpr("cast(id as string) c")
    with pytest.raises(ValueError, match="levels"):
        fit_vocabulary(df, ["c"], max_levels=10)
    out = OneHot(columns=["c"], null_column=True).fit(df.limit(2)).transform(spark.createDataFrame([(None,)], "c string"))
    assert out.columns[-1] == "c_nan" and out.first()["c_nan"] == 1
