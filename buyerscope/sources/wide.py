"""The wide customer record built from order, line-item and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerscope import schema as S
from buyerscope.functions.dates import as_of_literal

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

CUTOFF = "2001-04-01"

# How the tables stand in for the record's columns.
SPEND_BY_TYPE = dict(zip(["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"], S.SPEND))
CHANNEL_BY_PRIORITY = dict(zip(["1-URGENT", "2-HIGH", "3-MEDIUM"], S.CHANNELS))
CAMPAIGN_BY_EVENT = dict(zip(["view", "click", "signup", "purchase", "error"], S.CAMPAIGNS))
EDUCATION_BY_SEGMENT = {
    "AUTOMOBILE": "Basic",
    "BUILDING": "2n Cycle",
    "FURNITURE": "Graduation",
    "HOUSEHOLD": "Master",
    "MACHINERY": "PhD",
}
MARITAL_BY_REGION = {
    "AFRICA": "Single",
    "AMERICA": "Married",
    "ASIA": "Together",
    "EUROPE": "Divorced",
    "MIDDLE EAST": "Widow",
}
DEAL_DISCOUNT = 0.05


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _recode(c: str, mapping: dict[str, str]) -> Column:
    out = F
    for source, target in mapping.items():
        out = out.when(F.col(c) == source, target)
    return out


# Amounts are whole units of 1/10000, summed as two whole numbers each (units = high * CARRY + low),
# so that sums are exact, independent of row order, far from overflow, and cheap.
CARRY = 1_000_000
UNITS = 10_000


def line_units() -> Column:
    """Discounted price of a line in units of 1/10000; prices and discounts have two decimals."""
    cents = F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5))
    percent = F.floor(F.col("l_discount") * 100 + F.lit(0.5))
    return cents * (F.lit(100) - percent)


def order_lines(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One row per order: amount per part type (high and low part) and number of discounted lines.

    A part that holds a large share of the lines skews only the join to ``part``, whose
    oversized partitions are split at run time; after this aggregation every order is one row.

    Lines are dealt by order as they are, narrow, before they are summed: after the join to a large ``part`` they lie by part, where
    sums by order reduce next to nothing, and a wide row of sums for nearly every line neither fits memory nor is worth its shuffle.
    """
    names = list(SPEND_BY_TYPE.items())
    kind = F
    for i, (code, _) in enumerate(names):
        kind = kind.when(F.col("p_type") == code, F.lit(i).cast("tinyint"))
    lines = lineitem.select(
        "l_orderkey",
        "l_partkey",
        line_units().alias("units"),
        (F.col("l_discount") >= DEAL_DISCOUNT).cast("tinyint").alias("deal"),
    ).join(part.select("p_partkey", kind.alias("kind")), F.col("l_partkey") == F.col("p_partkey"))
    dealt = lines.select("l_orderkey", "kind", "units", "deal").repartition("l_orderkey")
    high, low = F.expr(f"units div {CARRY}"), F.expr(f"units % {CARRY}")
    return dealt.groupBy("l_orderkey").agg(
        *[
            F.sum(F.when(F.col("kind") == i, value)).alias(f"{name}_{suffix}")
            for i, (_, name) in enumerate(names)
            for suffix, value in (("high", high), ("low", low))
        ],
        F.sum("deal").alias("deals"),
    )


def order_history(orders: DataFrame, lines: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """One row per customer with orders: history before the cutoff, label from the rest."""
    before = F.col("o_orderdate") < F.lit(cutoff).cast("timestamp_ntz")
    past = orders.select(
        "o_custkey",
        "o_orderkey",
        "o_orderpriority",
        F.when(before, F.col("o_orderdate").cast("date")).alias("day"),
        before.alias("before"),
    ).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")

    def earlier(name: str) -> Column:
        return F.sum(F.when(F.col("before"), F.col(name)))

    def amount(name: str) -> Column:
        high = earlier(f"{name}_high").cast("decimal(24,0)") * F.lit(CARRY)
        units = (high + earlier(f"{name}_low")).cast("decimal(34,0)")
        return (units * F.lit(1 / UNITS).cast("decimal(4,4)")).cast("double").alias(name)

    return past.groupBy("o_custkey").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        *[amount(name) for name in S.SPEND],
        earlier("deals").alias(S.DEALS),
        *[
            F.count_if(F.col("before") & (F.col("o_orderpriority") == code)).alias(name)
            for code, name in CHANNEL_BY_PRIORITY.items()
        ],
        F.max((~F.col("before")).cast("int")).alias(S.LABEL),
    )


def event_history(events: DataFrame, before: str | None = None) -> DataFrame:
    """One row per user: number of views and one flag per event type, over events before ``before`` (all events if it is null)."""
    kind = F.col("event_type")
    if before is not None:
        events = events.where(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    return events.groupBy("user_id").agg(
        F.count_if(kind == "view").alias(S.VISITS),
        *[F.max((kind == e).cast("int")).alias(name) for e, name in CAMPAIGN_BY_EVENT.items()],
    )


def customer_360(
    spark: SparkSession, folder: str, cutoff: str = CUTOFF, events_before: str | None = None
) -> DataFrame:
    """The wide record: every customer once, whether or not they ordered.

    Orders and lines count up to ``cutoff``. Events count up to ``events_before``; without it the whole log counts, and the
    visit, campaign and complaint columns are then descriptions of the customer, not history: models must not read them.
    """
    read = {n: table(spark, folder, n) for n in
            ("customer", "nation", "region", "orders", "lineitem", "part", "events")}
    places = read["nation"].join(
        read["region"], F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", _recode("r_name", MARITAL_BY_REGION).alias("Marital_Status"))
    history = order_history(read["orders"], order_lines(read["lineitem"], read["part"]), cutoff)
    people = (
        read["customer"]
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(history, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(event_history(read["events"], events_before), F.col("c_custkey") == F.col("user_id"), "left")
    )
    custkey = F.col("c_custkey")

    def whole(name: str) -> Column:
        return F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint")).alias(name)

    return people.select(
        custkey.alias("ID"),
        (F.lit(1950) + custkey % 50).cast("int").alias("Year_Birth"),
        _recode("c_mktsegment", EDUCATION_BY_SEGMENT).alias("Education"),
        F.col("Marital_Status"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("Income"),
        (custkey % 3).cast("int").alias("Kidhome"),
        (F.floor(custkey / 3) % 3).cast("int").alias("Teenhome"),
        F.col("first_day").alias("Dt_Customer"),
        F.datediff(as_of_literal(cutoff), F.col("last_day")).alias("Recency"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in S.SPEND],
        whole(S.DEALS),
        *[whole(c) for c in S.CHANNELS],
        whole(S.VISITS),
        *[whole(c) for c in ("AcceptedCmp3", "AcceptedCmp4", "AcceptedCmp5", "AcceptedCmp1", "AcceptedCmp2")],
        F.coalesce(F.col("AcceptedCmp5").cast("bigint"), F.lit(0).cast("bigint")).alias("Complain"),
        F.lit(3).cast("bigint").alias("Z_CostContact"),
        F.lit(11).cast("bigint").alias("Z_Revenue"),
        F.coalesce(F.col(S.LABEL), F.lit(0)).alias(S.LABEL),
    )
