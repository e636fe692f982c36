"""The behavioural feature set: tenure, life stage, spend mix, RFM scores, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope import schema as S
from buyerscope.features.core import whole_sum
from buyerscope.functions.dates import calendar_parts, tenure_days, tenure_months, tenure_years
from buyerscope.functions.expressions import (
    at_least, flag, lookup, row_mean, row_std, row_sum, smoothed_ratio,
)
from buyerscope.operators.base import JsonEstimator, JsonModel
from buyerscope.operators.binning import cut, cut_index, edge_specs, label_at, merged_edges
from buyerscope.operators.onehot import MAX_LEVELS, dummies, fit_vocabulary
from buyerscope.operators.quantiles import exact_quantiles, medians
from buyerscope.operators.transform import (
    PowerTransform, PowerTransformModel, StandardScale, StandardScaleModel,
)

# Age bands and their names.
AGE_EDGES = [0, 25, 35, 45, 55, 65, 100]
AGE_LABELS = ["GenZ", "Millennial", "GenX_Young", "GenX_Old", "Boomer", "Senior"]
LIFECYCLES = ["Young_Single", "Young_Couple", "Parents_Young", "Parents_Teen", "Empty_Nest", "Other"]
VALUE_LABELS = ["Low", "Medium", "High"]
# Columns brought closer to a normal distribution.
POWER_COLUMNS = ["Income", "Total_Spent", "Spent_Per_Person", "Income_Per_Family_Member"]
CATEGORIES = ["Marital_Status", "Education", "Age_Bin", "Family_Lifecycle", "Customer_Value"]
MEDIAN_SPEND = ["MntWines", "MntMeatProducts", "MntSweetProducts", "MntGoldProds"]

OPTIONS = {
    "max_levels": MAX_LEVELS,
    "as_of": "2023-01-01",
    "education_order": S.EDUCATION_ORDER,
    "encode": True,
    "scale": True,
}


def tenure_columns(as_of: str, date: str = "Dt_Customer") -> dict[str, Column]:
    """Tenure in days, months and years, and the parts of the enrolment date."""
    days = tenure_days(date, as_of)
    return {
        "Customer_Tenure_Days": days,
        "Customer_Tenure_Months": tenure_months(days),
        "Customer_Tenure_Years": tenure_years(days),
        **calendar_parts(date),
    }


def household_columns(as_of_year: int) -> dict[str, Column]:
    return {
        "Age": F.lit(as_of_year) - F.col("Year_Birth"),
        "Total_Children": F.col("Kidhome") + F.col("Teenhome"),
        "Has_Partner": flag(F.col("Marital_Status").isin(S.PARTNER_STATES)),
    }


def lifecycle() -> Column:
    """First matching stage; needs the household columns."""
    age, children, partner = F.col("Age"), F.col("Total_Children"), F.col("Has_Partner")
    kids, teens = F.col("Kidhome"), F.col("Teenhome")
    return (
        F.when((age < 35) & (children == 0) & (partner == 0), LIFECYCLES[0])
        .when((age < 45) & (children == 0) & (partner == 1), LIFECYCLES[1])
        .when((children > 0) & (kids > 0), LIFECYCLES[2])
        .when((children > 0) & (teens > 0) & (kids == 0), LIFECYCLES[3])
        .when((age > 50) & (children == 0), LIFECYCLES[4])
        .otherwise(LIFECYCLES[5])
    )


def base_columns(df: DataFrame, as_of: str, income_median: float | None) -> DataFrame:
    """Columns that need nothing fitted but the income median."""
    year = int(as_of[:4])
    first = df.withColumns(
        {
            "Income": F.coalesce(F.col("Income"), F.lit(income_median)),
            **tenure_columns(as_of),
            **household_columns(year),
            "Total_Spent": row_sum(S.SPEND),
            "Total_Purchases": whole_sum(S.CHANNELS),
            "Campaign_Accepted_Count": whole_sum(S.CAMPAIGNS),
            "Recent_Campaign_Success": whole_sum(S.CAMPAIGNS[2:]),
            "Early_Campaign_Success": whole_sum(S.CAMPAIGNS[:2]),
            "Customer_Satisfaction": F.lit(1) - F.col("Complain"),
        }
    )
    luxury = F.col("MntWines") + F.col("MntGoldProds")
    food = sum((F.col(c) for c in S.SPEND[2:5]), F.col("MntFruits"))
    second = first.withColumns(
        {
            "Recency_Tenure_Ratio": smoothed_ratio("Recency", "Customer_Tenure_Days"),
            "Age_Bin": cut("Age", AGE_EDGES, AGE_LABELS),
            "Family_Size": F.col("Total_Children") + F.when(F.col("Has_Partner") == 1, 2).otherwise(1),
            "Is_Parent": flag(F.col("Total_Children") > 0),
            "Empty_Nester": flag(
                (F.col("Age") > 50) & (F.col("Total_Children") == 0) & (F.col("Has_Partner") == 1)
            ),
            "Family_Lifecycle": lifecycle(),
            "Luxury_Ratio": smoothed_ratio(luxury, "Total_Spent"),
            "Food_Ratio": smoothed_ratio(food, "Total_Spent"),
            **{f"{c}_Ratio": smoothed_ratio(c, "Total_Spent") for c in S.SPEND},
            "Spending_CV": F.try_divide(row_std(S.SPEND), row_mean(S.SPEND) + 1),
            **{f"{c}_Ratio": smoothed_ratio(c, "Total_Purchases") for c in S.CHANNELS},
            "Web_Store_Ratio": smoothed_ratio(S.CHANNELS[0], S.CHANNELS[2], top=1),
            "Catalog_Store_Ratio": smoothed_ratio(S.CHANNELS[1], S.CHANNELS[2], top=1),
            "Avg_Spent_Per_Purchase": smoothed_ratio("Total_Spent", "Total_Purchases"),
            "Deal_Usage_Rate": smoothed_ratio(S.DEALS, "Total_Purchases"),
            "Web_Visits_Per_Purchase": smoothed_ratio(S.VISITS, S.CHANNELS[0]),
            "Web_Conversion_Rate": smoothed_ratio(S.CHANNELS[0], S.VISITS),
            "Spending_Income_Ratio": smoothed_ratio("Total_Spent", "Income"),
            "Luxury_Income_Ratio": smoothed_ratio(luxury, "Income"),
            "Campaign_Response_Rate": F.col("Campaign_Accepted_Count") / F.lit(len(S.CAMPAIGNS)),
            "Income_X_Age": F.col("Income") * F.col("Age"),
            "Recency_X_Spending": F.col("Recency") * F.col("Total_Spent"),
            "Campaign_Success_X_Spending": F.col("Campaign_Accepted_Count") * F.col("Total_Spent"),
            "Is_Active": flag(F.col("Recency") < 90),
        }
    )
    return second.withColumns(
        {
            "Spent_Per_Person": F.col("Total_Spent") / F.col("Family_Size"),
            "Income_Per_Family_Member": F.col("Income") / F.col("Family_Size"),
        }
    )


def bin_specs() -> dict[str, tuple[Column | str, int, bool]]:
    """Equal-frequency bins: name -> (column, bins, merge equal edges)."""
    return {
        "Income_Quantile": ("Income", 5, False),
        "R_Score": ("Recency", 5, True),
        "F_Score": (at_least("Total_Purchases", 1), 5, True),
        "M_Score": (at_least("Total_Spent", 1), 5, True),
        "Customer_Value": ("Total_Spent", 3, False),
    }


def fitted_columns(df: DataFrame, mids: dict[str, float], edges: dict[str, list[float]], order: dict) -> DataFrame:
    """Columns that compare with medians or quantile edges of the training data."""

    def above(c: str) -> Column:
        return F.col(c) > F.lit(mids[c])

    def score(name: str) -> Column:
        c = bin_specs()[name][0]
        return cut_index(c, edges[name], clamp=True)

    out = df.withColumns(
        {
            "Wine_And_Meat": flag(above("MntWines") & above("MntMeatProducts")),
            "Sweet_And_Gold": flag(above("MntSweetProducts") & above("MntGoldProds")),
            "Income_Quantile": score("Income_Quantile"),
            "Recent_High_Spender": flag((F.col("Recency") < F.lit(mids["Recency"])) & above("Total_Spent")),
            "R_Score": F.lit(4) - score("R_Score"),
            "F_Score": score("F_Score"),
            "M_Score": score("M_Score"),
            "Customer_Value": label_at(score("Customer_Value"), VALUE_LABELS),
            "Education_Ordinal": lookup("Education", order, -1),
        }
    )
    return out.withColumn("RFM_Score", F.col("R_Score") + F.col("F_Score") + F.col("M_Score"))


def scaled_names(columns: list[str]) -> list[str]:
    return [c for c in columns if "Ratio" in c or "Rate" in c]


class RfmFeatures(JsonEstimator):
    """Behavioural features; learns medians, bin edges, vocabularies and scales."""

    DEFAULTS = OPTIONS

    def _fit(self, df: DataFrame) -> RfmFeaturesModel:
        income = medians(df, ["Income"])["Income"]
        base = base_columns(df, self.opt("as_of"), income)
        # Medians and bin edges in one pass.
        middle = [*MEDIAN_SPEND, "Recency", "Total_Spent"]
        specs = {**{f"median {c}": (c, [0.5]) for c in middle}, **edge_specs(bin_specs())}
        found = exact_quantiles(base, specs)
        mids = {c: found[f"median {c}"][0] for c in middle}
        learned = {"income": income, "medians": mids, "edges": merged_edges(found, bin_specs())}
        labelled = fitted_columns(base, mids, learned["edges"], self.opt("education_order"))
        vocabulary = fit_vocabulary(labelled, ["Marital_Status", "Education", "Family_Lifecycle"], self.opt("max_levels"))
        vocabulary.update({"Age_Bin": AGE_LABELS, "Customer_Value": VALUE_LABELS})
        learned["vocabulary"] = {c: vocabulary[c] for c in CATEGORIES}
        if self.opt("scale"):
            ratios = scaled_names(labelled.columns)
            learned["standard"] = StandardScale(columns=ratios).fit(labelled).state()
            learned["power"] = PowerTransform(columns=POWER_COLUMNS).fit(labelled).state()
        return RfmFeaturesModel.from_estimator(self, learned)


class RfmFeaturesModel(JsonModel):
    DEFAULTS = OPTIONS

    def _transform(self, df: DataFrame) -> DataFrame:
        learned = self.state()
        out = base_columns(df, self.opt("as_of"), learned["income"])
        out = fitted_columns(out, learned["medians"], learned["edges"], self.opt("education_order"))
        out = out.drop("Year_Birth", "Dt_Customer", *S.CONSTANTS)
        if self.opt("scale"):
            out = StandardScaleModel(learned["standard"], suffix="_scaled").transform(out)
            out = PowerTransformModel(learned["power"]).transform(out)
        if self.opt("encode"):
            encoded = {}
            for c, levels in learned["vocabulary"].items():
                encoded.update(dummies(c, levels, null_column=True))
            out = out.withColumns(encoded).drop(*CATEGORIES)
        return out
