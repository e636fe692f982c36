"""The customer record: columns, column groups and fixed values.

Operators take column names as parameters; these are the defaults.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "ID"
LABEL = "Target"

SPEND = [
    "MntWines",
    "MntFruits",
    "MntMeatProducts",
    "MntFishProducts",
    "MntSweetProducts",
    "MntGoldProds",
]
CHANNELS = ["NumWebPurchases", "NumCatalogPurchases", "NumStorePurchases"]
DEALS = "NumDealsPurchases"
VISITS = "NumWebVisitsMonth"
CAMPAIGNS = ["AcceptedCmp1", "AcceptedCmp2", "AcceptedCmp3", "AcceptedCmp4", "AcceptedCmp5"]
CATEGORIES = ["Education", "Marital_Status"]
COUNTS = ["Kidhome", "Teenhome", "Recency", DEALS, *CHANNELS, VISITS]
BINARY = ["Complain", *CAMPAIGNS]
CONSTANTS = ["Z_CostContact", "Z_Revenue"]

# Column groups of the record, as its description lists them.
PEOPLE = [
    "Year_Birth",
    "Education",
    "Marital_Status",
    "Income",
    "Kidhome",
    "Teenhome",
    "Days_Since_Registration",
    "Recency",
    "Complain",
]
PRODUCTS = SPEND
PROMOTION = [DEALS, *CAMPAIGNS]
PLACE = [*CHANNELS, VISITS]

# Text that stands for a missing entry.
NULL_TOKENS = ["", "unknown", "Unknown", "NA", "na", "N/A", "n/a"]
# Further spellings that CSV readers of the data world treat as missing.
DEFAULT_NULL_TOKENS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "NULL", "NaN", "None", "nan", "null",
]
# Order of the education levels.
EDUCATION_ORDER = {"Basic": 0, "2n Cycle": 1, "Graduation": 2, "Master": 3, "PhD": 4}
# Marital states that mean two adults in the household.
PARTNER_STATES = ["Married", "Together"]
UNKNOWN = "Unknown"

RAW_FIELDS = [
    T.StructField("ID", T.IntegerType(), False),
    T.StructField("Year_Birth", T.IntegerType(), False),
    T.StructField("Education", T.StringType()),
    T.StructField("Marital_Status", T.StringType()),
    T.StructField("Income", T.DoubleType()),
    T.StructField("Kidhome", T.ByteType(), False),
    T.StructField("Teenhome", T.ByteType(), False),
    T.StructField("Dt_Customer", T.StringType()),
    T.StructField("Recency", T.ShortType(), False),
    *[T.StructField(c, T.DoubleType()) for c in SPEND],
    T.StructField(DEALS, T.ByteType(), False),
    *[T.StructField(c, T.ByteType(), False) for c in CHANNELS],
    T.StructField(VISITS, T.ByteType(), False),
    T.StructField("AcceptedCmp3", T.ByteType(), False),
    T.StructField("AcceptedCmp4", T.ByteType(), False),
    T.StructField("AcceptedCmp5", T.ByteType(), False),
    T.StructField("AcceptedCmp1", T.ByteType(), False),
    T.StructField("AcceptedCmp2", T.ByteType(), False),
    T.StructField("Complain", T.ByteType(), False),
    T.StructField("Z_CostContact", T.LongType()),
    T.StructField("Z_Revenue", T.LongType()),
]


def raw_schema(with_label: bool = True) -> T.StructType:
    """Typed layout of a customer file."""
    fields = list(RAW_FIELDS)
    if with_label:
        fields.append(T.StructField(LABEL, T.ByteType(), False))
    return T.StructType(fields)
