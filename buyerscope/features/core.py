"""The main feature set and the columns the exploratory reports derive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope import schema as S
from buyerscope.functions.dates import tenure_years
from buyerscope.functions.expressions import flag, ratio, row_std, row_sum
from buyerscope.operators.base import JsonEstimator, JsonModel
from buyerscope.operators.onehot import MAX_LEVELS, dummies, fit_vocabulary


def whole_sum(cols: Sequence[str]) -> Column:
    """Row sum of integer columns, as a whole number."""
    return row_sum(cols).cast("bigint")


def short_spend(c: str) -> str:
    return c.replace("Mnt", "")


def short_channel(c: str) -> str:
    return c.replace("Num", "").replace("Purchases", "")


def core_columns(
    df: DataFrame,
    as_of_year: int,
    spend: Sequence[str] | None = None,
    channels: Sequence[str] = S.CHANNELS,
    campaigns: Sequence[str] | None = None,
    birth_year: str = "Year_Birth",
    tenure: str = "Days_Since_Registration",
) -> DataFrame:
    """Household, spend, channel, campaign and loyalty features.

    Totals come first and ratios second: two projections, which the optimizer fuses where
    that does not repeat work.
    """
    spend = spend or [c for c in df.columns if c.startswith("Mnt")]
    campaigns = campaigns or [c for c in df.columns if c.startswith("AcceptedCmp")]
    children = F.col("Kidhome") + F.col("Teenhome")
    totals = df.withColumns(
        {
            "Age": F.lit(as_of_year) - F.col(birth_year),
            "FamilySize": F.lit(1) + children,
            "HasChildren": flag(children > 0),
            "TotalSpent": row_sum(spend),
            "SpendingVolatility": row_std(spend),
            "TotalPurchases": whole_sum(channels),
            "TotalAcceptedCampaigns": whole_sum(campaigns),
            "TenureYears": tenure_years(tenure),
            "WebEngagementRatio": ratio(S.VISITS, channels[0]),
        }
    )
    adults = F.col("FamilySize") - children
    return totals.withColumns(
        {
            "ChildAdultRatio": F.coalesce(F.try_divide(children, adults), F.when(children.isNotNull(), 0.0)),
            "IncomePerMember": F.col("Income") / F.col("FamilySize"),
            **{f"{short_spend(c)}Ratio": ratio(c, "TotalSpent") for c in spend},
            "SpentPerPerson": F.col("TotalSpent") / F.col("FamilySize"),
            **{f"{short_channel(c)}Ratio": ratio(c, "TotalPurchases") for c in channels},
            "AvgBasketSize": ratio("TotalSpent", "TotalPurchases"),
            "CampaignAcceptanceRate": F.col("TotalAcceptedCampaigns") / F.lit(len(campaigns)),
            "PurchaseFrequency": ratio("TotalPurchases", "TenureYears"),
            "DealRatio": ratio(S.DEALS, "TotalPurchases"),
            "RecencyRatio": ratio("Recency", tenure),
            "Age_x_Income": F.col("Age") * F.col("Income") / F.lit(1000),
            "WebEngagement_x_Age": F.col("WebEngagementRatio") * F.col("Age") / F.lit(100),
        }
    )


OPTIONS = {"as_of_year": 2025, "categories": S.CATEGORIES, "birth_year": "Year_Birth", "max_levels": MAX_LEVELS}


class CoreFeatures(JsonEstimator):
    """Main feature set; fitting learns the category vocabularies."""

    DEFAULTS = OPTIONS

    def _fit(self, df: DataFrame) -> CoreFeaturesModel:
        names = [c for c in self.opt("categories") if c in df.columns]
        found = fit_vocabulary(df, names, self.opt("max_levels"))
        learned = {c: [v for v in found[c] if v != S.UNKNOWN] + [S.UNKNOWN] for c in names}
        return CoreFeaturesModel.from_estimator(self, {"vocabulary": learned})


class CoreFeaturesModel(JsonModel):
    """Adds the features, encodes categories without their first level, drops the birth year."""

    DEFAULTS = OPTIONS

    def _transform(self, df: DataFrame) -> DataFrame:
        out = core_columns(df, self.opt("as_of_year"), birth_year=self.opt("birth_year"))
        encoded = {}
        for c, levels in self.state()["vocabulary"].items():
            encoded.update(dummies(c, levels[1:]))
        return out.withColumns(encoded).drop(self.opt("birth_year"), *self.state()["vocabulary"])


def eda_columns(df: DataFrame, as_of_year: int = 2025) -> DataFrame:
    """Columns the exploratory tables use, as a new frame."""
    totals = df.withColumns(
        {
            "Age": F.lit(as_of_year) - F.col("Year_Birth"),
            "FamilySize": F.lit(1) + F.col("Kidhome") + F.col("Teenhome"),
            "YearsSinceRegistration": tenure_years("Days_Since_Registration"),
            "TotalSpend": row_sum(S.SPEND),
            "TotalAcceptedCampaigns": whole_sum(S.CAMPAIGNS),
            "TotalPurchases": whole_sum(S.CHANNELS),
            "WebConversionRatio": ratio(S.CHANNELS[0], S.VISITS),
        }
    )
    return totals.withColumns(
        {f"{short_channel(c)}Proportion": ratio(c, "TotalPurchases") for c in S.CHANNELS}
    )
