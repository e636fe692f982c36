"""DuckDB statements that state, independently, what each registered query must return."""

from __future__ import annotations

from collections.abc import Sequence

SPEND = ["MntWines", "MntFruits", "MntMeatProducts", "MntFishProducts", "MntSweetProducts", "MntGoldProds"]
CHANNELS = ["NumWebPurchases", "NumCatalogPurchases", "NumStorePurchases"]
CAMPAIGNS = [f"AcceptedCmp{i}" for i in range(1, 6)]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
YEAR = 2001
CUTOFF = "2001-04-01"
DAY = f"DATE '{CUTOFF}'"

C360_COLUMNS = [
    "ID", "Year_Birth", "Education", "Marital_Status", "Income", "Kidhome", "Teenhome", "Dt_Customer",
    "Recency", *SPEND, "NumDealsPurchases", *CHANNELS, "NumWebVisitsMonth", "AcceptedCmp3",
    "AcceptedCmp4", "AcceptedCmp5", "AcceptedCmp1", "AcceptedCmp2", "Complain", "Z_CostContact",
    "Z_Revenue", "Target",
]
CORR_COLUMNS = [
    "Income", "Kidhome", "Teenhome", "Recency", *SPEND, "NumDealsPurchases", *CHANNELS,
    "NumWebVisitsMonth", *CAMPAIGNS, "Complain", "Z_CostContact", "Z_Revenue",
    "Days_Since_Registration", "Target",
]


def r6(expression: str, name: str) -> str:
    """Rounded half up to six digits, in the same arithmetic as the queries."""
    return f"FLOOR(CAST({expression} AS DOUBLE) * 1e6 + 0.5::DOUBLE) / 1e6 AS {name}"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / (CASE WHEN {b} = 0 THEN 1.0 ELSE CAST({b} AS DOUBLE) END))"


def smooth(a: str, b: str, top: int = 0) -> str:
    return f"((CAST({a} AS DOUBLE) + {top}) / (CAST({b} AS DOUBLE) + 1))"


def total(cols: Sequence[str], kind: str = "DOUBLE") -> str:
    return "CAST(" + " + ".join(f"COALESCE({c}, 0)" for c in cols) + f" AS {kind})"


def spread(cols: Sequence[str]) -> str:
    mean = "((" + " + ".join(cols) + f") / {len(cols)})"
    return "SQRT((" + " + ".join(f"POW({c} - {mean}, 2)" for c in cols) + f") / {len(cols) - 1})"


def flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def md5_order(key: str, seed: object) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '-{seed}')"


_PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: list[str], body: str) -> None:
    _PARTS[name] = (needs, body)


def sql(needs: list[str], body: str) -> str:
    """The statement with the named sub-queries it needs, in order of dependency."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in _PARTS[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body
    return "WITH " + ", ".join(f"{n} AS ({_PARTS[n][1]})" for n in order) + " " + body


_amounts = ", ".join(
    f"SUM(CASE WHEN p_type = '{t}' AND o_orderdate < TIMESTAMP '{CUTOFF}' THEN CAST(l_extendedprice AS "
    f"DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) END) AS {c}"
    for t, c in zip(TYPES, SPEND)
)
part(
    "spent",
    [],
    f"""SELECT o_custkey, {_amounts},
    SUM(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' AND l_discount >= 0.05 THEN 1 ELSE 0 END) AS deals
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey""",
)
_channels = ", ".join(
    f"SUM(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' AND o_orderpriority = '{p}' THEN 1 ELSE 0 END) AS {c}"
    for p, c in zip(["1-URGENT", "2-HIGH", "3-MEDIUM"], CHANNELS)
)
part(
    "ordered",
    [],
    f"""SELECT o_custkey, MIN(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN CAST(o_orderdate AS DATE) END) AS d0,
    MAX(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN CAST(o_orderdate AS DATE) END) AS d1, {_channels},
    MAX(CASE WHEN o_orderdate >= TIMESTAMP '{CUTOFF}' THEN 1 ELSE 0 END) AS target FROM orders GROUP BY o_custkey""",
)
_flags = ", ".join(
    f"MAX(CASE WHEN event_type = '{e}' THEN 1 ELSE 0 END) AS {c}"
    for e, c in zip(["view", "click", "signup", "purchase", "error"], CAMPAIGNS)
)
part(
    "seen",
    [],
    f"""SELECT user_id, SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views, {_flags}
    FROM events GROUP BY user_id""",
)
_segments = " ".join(
    f"WHEN '{a}' THEN '{b}'"
    for a, b in [("AUTOMOBILE", "Basic"), ("BUILDING", "2n Cycle"), ("FURNITURE", "Graduation"),
                 ("HOUSEHOLD", "Master"), ("MACHINERY", "PhD")]
)
_regions = " ".join(
    f"WHEN '{a}' THEN '{b}'"
    for a, b in [("AFRICA", "Single"), ("AMERICA", "Married"), ("ASIA", "Together"),
                 ("EUROPE", "Divorced"), ("MIDDLE EAST", "Widow")]
)
part(
    "c360",
    ["spent", "ordered", "seen"],
    f"""SELECT c_custkey AS ID, CAST(1950 + c_custkey % 50 AS INTEGER) AS Year_Birth,
    CASE c_mktsegment {_segments} END AS Education, CASE r_name {_regions} END AS Marital_Status,
    CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS Income, CAST(c_custkey % 3 AS INTEGER) AS Kidhome,
    CAST((c_custkey // 3) % 3 AS INTEGER) AS Teenhome, d0 AS Dt_Customer,
    CAST({DAY} - d1 AS INTEGER) AS Recency,
    {', '.join(f'COALESCE(CAST(spent.{c} AS DOUBLE), 0.0) AS {c}' for c in SPEND)},
    CAST(COALESCE(deals, 0) AS BIGINT) AS NumDealsPurchases,
    {', '.join(f'CAST(COALESCE(ordered.{c}, 0) AS BIGINT) AS {c}' for c in CHANNELS)},
    CAST(COALESCE(views, 0) AS BIGINT) AS NumWebVisitsMonth,
    {', '.join(f'CAST(COALESCE(seen.{c}, 0) AS BIGINT) AS {c}' for c in CAMPAIGNS)},
    CAST(COALESCE(seen.AcceptedCmp5, 0) AS BIGINT) AS Complain, CAST(3 AS BIGINT) AS Z_CostContact,
    CAST(11 AS BIGINT) AS Z_Revenue, CAST(COALESCE(target, 0) AS INTEGER) AS Target
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN ordered ON c_custkey = ordered.o_custkey LEFT JOIN spent ON c_custkey = spent.o_custkey
    LEFT JOIN seen ON c_custkey = user_id""",
)
part(
    "clean_stats",
    ["c360"],
    """SELECT *, (SELECT quantile_cont(COALESCE(Income, med_income), 0.995) FROM c360) AS cap FROM (
    SELECT median(Income) AS med_income, median(CAST(Dt_Customer - DATE '1970-01-01' AS DOUBLE)) AS med_day,
    median(CAST(Recency AS DOUBLE)) AS med_recency FROM c360)""",
)
_clean_expr = {
    "Year_Birth": f"LEAST(GREATEST(Year_Birth, {YEAR - 100}), {YEAR - 18})",
    "Education": "COALESCE(Education, 'Unknown')",
    "Marital_Status": "COALESCE(Marital_Status, 'Unknown')",
    "Income": "LEAST(COALESCE(Income, med_income), cap)",
    "Recency": "COALESCE(CAST(Recency AS DOUBLE), med_recency)",
}
part(
    "cl",
    ["c360", "clean_stats"],
    "SELECT "
    + ", ".join(f"{_clean_expr.get(c, c)} AS {c}" for c in C360_COLUMNS if c != "Dt_Customer")
    + f""", CAST(FLOOR(CAST({DAY} - DATE '1970-01-01' AS DOUBLE) - COALESCE(CAST(Dt_Customer - DATE '1970-01-01'
    AS DOUBLE), med_day)) AS INTEGER) AS Days_Since_Registration FROM c360, clean_stats""",
)
CLEAN_DOUBLES = ["Income", "Recency", *SPEND]
_clean_out = ", ".join(
    r6(c, c) if c in CLEAN_DOUBLES else c
    for c in [*[c for c in C360_COLUMNS if c != "Dt_Customer"], "Days_Since_Registration"]
)
part(
    "ed",
    ["cl"],
    f"""SELECT *, Web / nz AS WebProportion, Cat / nz AS CatalogProportion, Sto / nz AS StoreProportion FROM (
    SELECT *, {YEAR} - Year_Birth AS Age, 1 + Kidhome + Teenhome AS FamilySize,
    Days_Since_Registration / 365.25::DOUBLE AS YearsSinceRegistration, {total(SPEND)} AS TotalSpend,
    {total(CAMPAIGNS, 'BIGINT')} AS TotalAcceptedCampaigns, {total(CHANNELS, 'BIGINT')} AS TotalPurchases,
    {ratio('NumWebPurchases', 'NumWebVisitsMonth')} AS WebConversionRatio,
    CAST(NumWebPurchases AS DOUBLE) AS Web, CAST(NumCatalogPurchases AS DOUBLE) AS Cat,
    CAST(NumStorePurchases AS DOUBLE) AS Sto,
    CASE WHEN {total(CHANNELS)} = 0 THEN 1.0 ELSE {total(CHANNELS)} END AS nz FROM cl)""",
)
_eda_out = (
    _clean_out
    + ", CAST(Age AS INTEGER) AS Age, CAST(FamilySize AS INTEGER) AS FamilySize, TotalAcceptedCampaigns, TotalPurchases, "
    + ", ".join(
        r6(c, c)
        for c in ["YearsSinceRegistration", "TotalSpend", "WebConversionRatio", "WebProportion",
                  "CatalogProportion", "StoreProportion"]
    )
)

# Behavioural features -----------------------------------------------------------------------

part(
    "rf0",
    ["c360"],
    f"""SELECT * EXCLUDE (Income), COALESCE(Income, (SELECT median(Income) FROM c360)) AS Income,
    CAST({DAY} - Dt_Customer AS INTEGER) AS Customer_Tenure_Days, {YEAR} - Year_Birth AS Age,
    Kidhome + Teenhome AS Total_Children, {flag("Marital_Status IN ('Married', 'Together')")} AS Has_Partner,
    {total(SPEND)} AS Total_Spent, {total(CHANNELS, 'BIGINT')} AS Total_Purchases,
    {total(CAMPAIGNS, 'BIGINT')} AS Campaign_Accepted_Count FROM c360""",
)
part(
    "rf",
    ["rf0"],
    """SELECT *, Total_Children + CASE WHEN Has_Partner = 1 THEN 2 ELSE 1 END AS Family_Size FROM rf0""",
)
_five = "[0.0, 0.2, 0.4, 0.6, 0.8, 1.0]"
part(
    "rfstats",
    ["rf"],
    f"""SELECT median(MntWines) AS m_wine, median(MntMeatProducts) AS m_meat, median(MntSweetProducts) AS m_sweet,
    median(MntGoldProds) AS m_gold, median(CAST(Recency AS DOUBLE)) AS m_rec, median(Total_Spent) AS m_spent,
    quantile_cont(Income, {_five}) AS e_inc, quantile_cont(CAST(Recency AS DOUBLE), {_five}) AS e_rec,
    quantile_cont(CAST(GREATEST(Total_Purchases, 1) AS DOUBLE), {_five}) AS e_freq,
    quantile_cont(GREATEST(Total_Spent, 1.0), {_five}) AS e_mon,
    quantile_cont(Total_Spent, [0.0, {1 / 3!r}, {2 / 3!r}, 1.0]) AS e_val FROM rf""",
)


def qindex(x: str, edges: str) -> str:
    """Number of distinct inner edges below x."""
    inner = f"list_filter(list_distinct({edges}), lambda e: e > list_min({edges}) AND e < list_max({edges}))"
    return f"(CASE WHEN {x} IS NOT NULL THEN CAST(len(list_filter({inner}, lambda e: e < {x})) AS INTEGER) END)"


_age_bin = "CASE " + " ".join(
    f"WHEN Age > {a} AND Age <= {b} THEN '{n}'"
    for a, b, n in [(0, 25, "GenZ"), (25, 35, "Millennial"), (35, 45, "GenX_Young"), (45, 55, "GenX_Old"),
                    (55, 65, "Boomer"), (65, 100, "Senior")]
) + " END"
_lifecycle = """CASE WHEN Age < 35 AND Total_Children = 0 AND Has_Partner = 0 THEN 'Young_Single'
    WHEN Age < 45 AND Total_Children = 0 AND Has_Partner = 1 THEN 'Young_Couple'
    WHEN Total_Children > 0 AND Kidhome > 0 THEN 'Parents_Young'
    WHEN Total_Children > 0 AND Teenhome > 0 AND Kidhome = 0 THEN 'Parents_Teen'
    WHEN Age > 50 AND Total_Children = 0 THEN 'Empty_Nest' ELSE 'Other' END"""
_education = """CASE Education WHEN 'Basic' THEN 0 WHEN '2n Cycle' THEN 1 WHEN 'Graduation' THEN 2
    WHEN 'Master' THEN 3 WHEN 'PhD' THEN 4 ELSE -1 END"""
_luxury = "(MntWines + MntGoldProds)"
_food = "(MntFruits + MntMeatProducts + MntFishProducts + MntSweetProducts)"
_mean_spend = "((" + " + ".join(SPEND) + ") / 6)"
# Name -> (expression, is a double).
RFM: dict[str, tuple[str, bool]] = {
    "Customer_Tenure_Days": ("Customer_Tenure_Days", False),
    "Customer_Tenure_Months": ("Customer_Tenure_Days / 30.44::DOUBLE", True),
    "Customer_Tenure_Years": ("Customer_Tenure_Days / 365.25::DOUBLE", True),
    "Enroll_Year": ("CAST(year(Dt_Customer) AS INTEGER)", False),
    "Enroll_Month": ("CAST(month(Dt_Customer) AS INTEGER)", False),
    "Enroll_Quarter": ("CAST(quarter(Dt_Customer) AS INTEGER)", False),
    "Enroll_Day": ("CAST(day(Dt_Customer) AS INTEGER)", False),
    "Enroll_DayOfWeek": ("CAST(isodow(Dt_Customer) - 1 AS INTEGER)", False),
    "Enroll_Weekend": (flag("isodow(Dt_Customer) >= 6"), False),
    "Recency_Tenure_Ratio": (smooth("Recency", "Customer_Tenure_Days"), True),
    "Age": ("CAST(Age AS INTEGER)", False),
    "Age_Bin": (_age_bin, False),
    "Total_Children": ("Total_Children", False),
    "Has_Partner": ("Has_Partner", False),
    "Family_Size": ("CAST(Family_Size AS INTEGER)", False),
    "Is_Parent": (flag("Total_Children > 0"), False),
    "Empty_Nester": (flag("Age > 50 AND Total_Children = 0 AND Has_Partner = 1"), False),
    "Family_Lifecycle": (_lifecycle, False),
    "Total_Spent": ("Total_Spent", True),
    "Luxury_Ratio": (smooth(_luxury, "Total_Spent"), True),
    "Food_Ratio": (smooth(_food, "Total_Spent"), True),
    **{f"{c}_Ratio": (smooth(c, "Total_Spent"), True) for c in SPEND},
    "Spent_Per_Person": ("Total_Spent / Family_Size", True),
    "Spending_CV": (f"{spread(SPEND)} / ({_mean_spend} + 1)", True),
    "Wine_And_Meat": (flag("MntWines > m_wine AND MntMeatProducts > m_meat"), False),
    "Sweet_And_Gold": (flag("MntSweetProducts > m_sweet AND MntGoldProds > m_gold"), False),
    "Total_Purchases": ("Total_Purchases", False),
    **{f"{c}_Ratio": (smooth(c, "Total_Purchases"), True) for c in CHANNELS},
    "Web_Store_Ratio": (smooth("NumWebPurchases", "NumStorePurchases", 1), True),
    "Catalog_Store_Ratio": (smooth("NumCatalogPurchases", "NumStorePurchases", 1), True),
    "Avg_Spent_Per_Purchase": (smooth("Total_Spent", "Total_Purchases"), True),
    "Deal_Usage_Rate": (smooth("NumDealsPurchases", "Total_Purchases"), True),
    "Web_Visits_Per_Purchase": (smooth("NumWebVisitsMonth", "NumWebPurchases"), True),
    "Web_Conversion_Rate": (smooth("NumWebPurchases", "NumWebVisitsMonth"), True),
    "Income": ("Income", True),
    "Income_Per_Family_Member": ("Income / Family_Size", True),
    "Spending_Income_Ratio": (smooth("Total_Spent", "Income"), True),
    "Luxury_Income_Ratio": (smooth(_luxury, "Income"), True),
    "Income_Quantile": (qindex("Income", "e_inc"), False),
    "Campaign_Accepted_Count": ("Campaign_Accepted_Count", False),
    "Campaign_Response_Rate": ("Campaign_Accepted_Count / 5.0::DOUBLE", True),
    "Recent_Campaign_Success": (total(CAMPAIGNS[2:], "BIGINT"), False),
    "Early_Campaign_Success": (total(CAMPAIGNS[:2], "BIGINT"), False),
    "Customer_Satisfaction": ("1 - Complain", False),
    "Income_X_Age": ("Income * Age", True),
    "Recency_X_Spending": ("Recency * Total_Spent", True),
    "Recent_High_Spender": (flag("Recency < m_rec AND Total_Spent > m_spent"), False),
    "Campaign_Success_X_Spending": ("Campaign_Accepted_Count * Total_Spent", True),
    "R_Score": (f"4 - {qindex('Recency', 'e_rec')}", False),
    "F_Score": (qindex("GREATEST(Total_Purchases, 1)", "e_freq"), False),
    "M_Score": (qindex("GREATEST(Total_Spent, 1.0)", "e_mon"), False),
    "Customer_Value": (f"(['Low', 'Medium', 'High'])[{qindex('Total_Spent', 'e_val')} + 1]", False),
    "Is_Active": (flag("Recency < 90"), False),
    "Education_Ordinal": (_education, False),
}
RFM["RFM_Score"] = (f"{RFM['R_Score'][0]} + {RFM['F_Score'][0]} + {RFM['M_Score'][0]}", False)
RFM_POWER = ["Income", "Total_Spent", "Spent_Per_Person", "Income_Per_Family_Member"]


def rfm_query(names: Sequence[str]) -> str:
    columns = ", ".join(r6(RFM[n][0], n) if RFM[n][1] else f"{RFM[n][0]} AS {n}" for n in names)
    return sql(["rf", "rfstats"], f"SELECT ID, {columns} FROM rf, rfstats")


def yeo_johnson(x: str, lam: str) -> str:
    """Transform for x >= 0, the only case in the tables."""
    return f"(CASE WHEN ABS({lam}) < 1e-12 THEN LN({x} + 1) ELSE (POW({x} + 1, {lam}) - 1) / {lam} END)"


def best_lambda(values: str) -> str:
    """(col, lam) of the grid -2.0 .. 2.0 with the highest likelihood; values is (id, col, x)."""
    grid = ", ".join(repr(round(-2.0 + i * 0.1, 10)) for i in range(41))
    return f"""SELECT col, arg_max(lam, ll) AS lam FROM (SELECT col, lam,
    -COUNT(*) / 2.0 * LN(VAR_POP({yeo_johnson('x', 'lam')})) + (lam - 1) * SUM(LN(x + 1)) AS ll
    FROM {values}, (SELECT UNNEST([{grid}]::DOUBLE[]) AS lam) GROUP BY col, lam) GROUP BY col"""


def onehot_query() -> str:
    cats = {
        "Marital_Status": ("Marital_Status", ["Divorced", "Married", "Single", "Together", "Widow"]),
        "Education": ("Education", ["2n Cycle", "Basic", "Graduation", "Master", "PhD"]),
        "Age_Bin": (_age_bin, ["GenZ", "Millennial", "GenX_Young", "GenX_Old", "Boomer", "Senior"]),
        "Family_Lifecycle": (
            _lifecycle,
            ["Empty_Nest", "Other", "Parents_Teen", "Parents_Young", "Young_Couple", "Young_Single"],
        ),
        "Customer_Value": (RFM["Customer_Value"][0], ["Low", "Medium", "High"]),
    }
    columns = []
    for name, (expression, levels) in cats.items():
        columns += [f"{flag(f'({expression}) = ' + repr(v))} AS \"{name}_{v}\"" for v in levels]
        columns.append(f"{flag(f'({expression}) IS NULL')} AS {name}_nan")
    return sql(["rf", "rfstats"], f"SELECT ID, {', '.join(columns)} FROM rf, rfstats")


def scaled_query() -> str:
    ratios = [n for n in RFM if ("Ratio" in n or "Rate" in n)]
    wide = ", ".join(f"CAST({RFM[n][0]} AS DOUBLE) AS {n}" for n in dict.fromkeys([*ratios, *RFM_POWER]))
    part("rfw", ["rf", "rfstats"], f"SELECT ID, {wide} FROM rf, rfstats")
    out = [
        r6(f"({n} - (SELECT AVG({n}) FROM rfw)) / (SELECT STDDEV_POP({n}) FROM rfw)", f"{n}_scaled")
        for n in ratios
    ]
    return out


# Main feature set ---------------------------------------------------------------------------

part(
    "co",
    ["cl"],
    f"""SELECT *, {YEAR} - Year_Birth AS Age, 1 + Kidhome + Teenhome AS FamilySize, {total(SPEND)} AS TotalSpent,
    {total(CHANNELS, 'BIGINT')} AS TotalPurchases, {total(CAMPAIGNS, 'BIGINT')} AS TotalAcceptedCampaigns,
    Days_Since_Registration / 365.25::DOUBLE AS TenureYears,
    {ratio('NumWebVisitsMonth', 'NumWebPurchases')} AS WebEngagementRatio FROM cl""",
)


def core_query() -> str:
    kept = [c for c in C360_COLUMNS if c not in ("Dt_Customer", "Year_Birth", "Education", "Marital_Status")]
    columns = [r6(c, c) if c in CLEAN_DOUBLES else c for c in kept]
    columns += [
        "Days_Since_Registration",
        "CAST(Age AS INTEGER) AS Age",
        "CAST(FamilySize AS INTEGER) AS FamilySize",
        f"{flag('Kidhome + Teenhome > 0')} AS HasChildren",
        "TotalPurchases",
        "TotalAcceptedCampaigns",
        r6("TotalSpent", "TotalSpent"),
        r6(spread(SPEND), "SpendingVolatility"),
        r6("TenureYears", "TenureYears"),
        r6("WebEngagementRatio", "WebEngagementRatio"),
        r6("Kidhome + Teenhome", "ChildAdultRatio"),
        r6("Income / FamilySize", "IncomePerMember"),
        *[r6(ratio(c, "TotalSpent"), c.replace("Mnt", "") + "Ratio") for c in SPEND],
        r6("TotalSpent / FamilySize", "SpentPerPerson"),
        *[r6(ratio(c, "TotalPurchases"), c.replace("Num", "").replace("Purchases", "") + "Ratio") for c in CHANNELS],
        r6(ratio("TotalSpent", "TotalPurchases"), "AvgBasketSize"),
        r6("TotalAcceptedCampaigns / 5.0::DOUBLE", "CampaignAcceptanceRate"),
        r6(ratio("TotalPurchases", "TenureYears"), "PurchaseFrequency"),
        r6(ratio("NumDealsPurchases", "TotalPurchases"), "DealRatio"),
        r6(ratio("Recency", "Days_Since_Registration"), "RecencyRatio"),
        r6("Age * Income / 1000", "Age_x_Income"),
        r6("WebEngagementRatio * Age / 100", "WebEngagement_x_Age"),
        *[f"{flag(f'Education = {v!r}')} AS \"Education_{v}\"" for v in ["Basic", "Graduation", "Master", "PhD", "Unknown"]],
        *[
            f"{flag(f'Marital_Status = {v!r}')} AS Marital_Status_{v}"
            for v in ["Married", "Single", "Together", "Widow", "Unknown"]
        ],
    ]
    return sql(["co"], f"SELECT {', '.join(columns)} FROM co")


def compact_query() -> str:
    basket = [*CHANNELS, "NumDealsPurchases"]
    month = "month(Dt_Customer)"
    columns = [
        "ID AS row_key", "Education", "Marital_Status", r6("Income", "Income"), "Kidhome", "Teenhome", "Recency",
        "NumWebVisitsMonth", "Complain", "Z_CostContact", "Z_Revenue", "Target",
        r6("Monetary", "Monetary"), "Frequency",
        f"CAST({YEAR} - Year_Birth AS INTEGER) AS Age",
        f"CAST(DATE '{YEAR}-12-31' - Dt_Customer AS INTEGER) AS Tenure",
        "Kidhome + Teenhome AS TotalChildren",
        r6("Income / (1 + Kidhome + Teenhome)", "IncomePerMember"),
        r6(ratio("Monetary", "Frequency"), "AvgSpendPerPurchase"),
        *[r6(ratio(c, "Monetary"), f"{c}_Ratio") for c in SPEND],
        f"{total(CAMPAIGNS, 'BIGINT')} AS TotalCampaigns",
        r6(f"SIN(2 * PI() * {month} / 12)", "EnrollMonth_sin"),
        r6(f"COS(2 * PI() * {month} / 12)", "EnrollMonth_cos"),
        f"{flag('Income > (SELECT median(Income) FROM c360) AND Monetary < (SELECT median(Monetary) FROM hy)')} AS HighIncome_LowSpending",
    ]
    part("hy", ["c360"], f"SELECT *, {total(SPEND)} AS Monetary, {total(basket, 'BIGINT')} AS Frequency FROM c360")
    return sql(["hy"], f"SELECT {', '.join(columns)} FROM hy")


def lean_query() -> str:
    kept = [c for c in C360_COLUMNS if c not in ("Dt_Customer", "Year_Birth", "Kidhome", "Teenhome")]
    columns = [r6(c, c) if c in ["Income", *SPEND] else c for c in kept]
    columns += [
        f"CAST({DAY} - Dt_Customer AS INTEGER) AS Days_Since_Reg",
        f"CAST({YEAR} - Year_Birth AS INTEGER) AS Age",
        "CAST(1 + Kidhome + Teenhome AS INTEGER) AS FamilySize",
        r6(total(SPEND), "TotalSpend"),
        f"{total(CHANNELS, 'BIGINT')} AS TotalPurchases",
        f"{total(CAMPAIGNS, 'BIGINT')} AS TotalAccepted",
        r6(ratio("NumWebVisitsMonth", "NumWebPurchases"), "WebVisitRatio"),
        r6("(Kidhome + Teenhome) / (1 + Kidhome + Teenhome)::DOUBLE", "ChildRatio"),
        *[r6(ratio(c, total(SPEND)), f"{c}_Pct") for c in SPEND],
    ]
    return sql(["c360"], f"SELECT {', '.join(columns)} FROM c360")


# Score tables -------------------------------------------------------------------------------

part(
    "quotas",
    ["c360"],
    """SELECT t, whole + CASE WHEN ROW_NUMBER() OVER (ORDER BY rest DESC, t) <= n_test - SUM(whole) OVER () THEN 1 ELSE 0 END AS quota
    FROM (SELECT t, n_test, n_test * n_c // n AS whole, n_test * n_c % n AS rest FROM (
    SELECT t, n_c, SUM(n_c) OVER () AS n, CAST(CEIL(0.2::DOUBLE * SUM(n_c) OVER ()) AS BIGINT) AS n_test FROM (
    SELECT Target AS t, COUNT(*) AS n_c FROM c360 GROUP BY Target)))""",
)
part(
    "folds",
    ["c360"],
    f"""SELECT ID, Target, CAST((ROW_NUMBER() OVER (ORDER BY Target, {md5_order('ID', 42)}, ID) - 1) % 5 AS INTEGER) AS fold
    FROM c360""",
)
part(
    "sw",
    ["c360", "folds"],
    f"""SELECT c.ID AS key, c.Target AS label, fold,
    COALESCE(ROUND(90.0::DOUBLE / (90.0::DOUBLE + Recency), 3), 0.0) AS p_recent,
    ROUND(({' + '.join(CHANNELS)}) / ({' + '.join(CHANNELS)} + 5.0::DOUBLE), 3) AS p_often,
    ROUND(CAST('0x' || substr({md5_order('c.ID', 'noise')}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE, 4) AS p_noise
    FROM c360 c JOIN folds f ON c.ID = f.ID""",
)
part("sc", ["sw"], "SELECT key, label, fold, p_recent AS p FROM sw")
part(
    "sl",
    ["sw"],
    " UNION ALL ".join(
        f"SELECT key, label, fold, '{m}' AS model, p_{m} AS p FROM sw" for m in ("recent", "often", "noise")
    ),
)
part(
    "ds",
    [],
    """SELECT d.doc_id AS key, quality AS label, ROUND(n_chars / (n_chars + 2000.0::DOUBLE), 3) AS p
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)


def cells(source: str, by: Sequence[str] = (), threshold: str = "0.5::DOUBLE") -> str:
    group = "".join(f"{b}, " for b in by)
    tail = f" GROUP BY {', '.join(by)}" if by else ""
    counts = ", ".join(
        f"CAST(SUM(CASE WHEN {c} THEN 1 ELSE 0 END) AS DOUBLE) AS {n}"
        for n, c in [
            ("tp", f"p >= {threshold} AND label = 1"), ("fp", f"p >= {threshold} AND label = 0"),
            ("fn", f"p < {threshold} AND label = 1"), ("tn", f"p < {threshold} AND label = 0"),
        ]
    )
    return f"SELECT {group}{counts} FROM {source}{tail}"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"


_n = "(tp + fp + fn + tn)"
_exp = f"(((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ({_n} * {_n}))"
_recall, _spec = div("tp", "tp + fn"), div("tn", "tn + fp")
RATES = {
    "accuracy": f"(tp + tn) / {_n}",
    "balanced_accuracy": f"({_recall} + {_spec}) / (CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN 2 ELSE 1 END)",
    "precision": div("tp", "tp + fp"),
    "recall": _recall,
    "f1": div("2 * tp", "2 * tp + fp + fn"),
    "cohen_kappa": div(f"(tp + tn) / {_n} - {_exp}", f"1.0 - {_exp}"),
}


def ranked(source: str, by: Sequence[str] = ()) -> str:
    """Running counts per distinct score, highest first."""
    group = "".join(f"{b}, " for b in by)
    within = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"""SELECT *, SUM(pos) OVER ({within}ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
    SUM(neg) OVER ({within}ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp,
    SUM(pos) OVER ({within}) AS np, SUM(neg) OVER ({within}) AS nn FROM (
    SELECT {group}p, CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
    CAST(SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS neg FROM {source} GROUP BY {group}p)"""


def auc_by_ranks(source: str, by: Sequence[str] = ()) -> str:
    """Rank-sum form with average ranks on ties."""
    group = "".join(f"{b}, " for b in by)
    within = f"PARTITION BY {', '.join(by)} " if by else ""
    tie = f"PARTITION BY {group}p"
    tail = f" GROUP BY {', '.join(by)}" if by else ""
    return f"""SELECT {group}(SUM(CASE WHEN label = 1 THEN r END) - SUM(label) * (SUM(label) + 1) / 2.0::DOUBLE)
    / (SUM(label) * SUM(1 - label)) AS auc FROM (SELECT *, RANK() OVER ({within}ORDER BY p)
    + (COUNT(*) OVER ({tie}) - 1) / 2.0::DOUBLE AS r FROM {source}){tail}"""


def average_precision(source: str, by: Sequence[str] = ()) -> str:
    group = "".join(f"{b}, " for b in by)
    tail = f" GROUP BY {', '.join(by)}" if by else ""
    return f"SELECT {group}SUM(pos / np * tp / (tp + fp)) AS ap FROM ({ranked(source, by)}){tail}"


def metrics_query(needs: list[str], source: str, by: Sequence[str] = (), prefix: str = "") -> str:
    group = "".join(f"c.{b}, " for b in by)
    on = " AND ".join(f"c.{b} = a.{b} AND c.{b} = q.{b}" for b in by) or "TRUE"
    columns = ", ".join(r6(e, f"{prefix}{n}") for n, e in RATES.items())
    return sql(
        needs,
        f"""SELECT {group}{columns}, {r6('auc', prefix + 'roc_auc')}, {r6('ap', prefix + 'average_precision')}
        FROM ({cells(source, by)}) c, ({auc_by_ranks(source, by)}) a, ({average_precision(source, by)}) q WHERE {on}""",
    )


SWEEP = ", ".join(repr(0.1 + i * 0.05) for i in range(18))
DENSE = ", ".join(repr(x) for x in [0.1 + i * (0.8 / 99) for i in range(99)] + [0.9])


def sweep(source: str, grid: str, by: Sequence[str] = ()) -> str:
    crossed = f"(SELECT * FROM {source}, (SELECT UNNEST([{grid}]::DOUBLE[]) AS threshold))"
    return cells(crossed, [*by, "threshold"], "threshold")


def thresholds_by_fold(metric: str) -> str:
    precision, recall = "(tp / (tp + fp))", "(tp / np)"
    value = {
        "f1": f"2 * ({precision} * {recall}) / ({precision} + {recall} + 1e-8)",
        "precision": precision,
        "recall": recall,
        "geometric_mean": f"SQRT({precision} * {recall})",
    }[metric]
    return f"""SELECT fold, p AS threshold, v FROM (SELECT fold, p, {value} AS v, ROW_NUMBER() OVER (PARTITION BY fold
    ORDER BY {value} DESC, p) AS rn FROM ({ranked('sc', ['fold'])})) WHERE rn = 1"""


def union(parts: Sequence[str]) -> str:
    return " UNION ALL ".join(parts)


def fold_score(scoring: str) -> str:
    if scoring == "roc_auc":
        return f"SELECT fold, auc AS score FROM ({auc_by_ranks('sc', ['fold'])})"
    if scoring == "average_precision":
        return f"SELECT fold, ap AS score FROM ({average_precision('sc', ['fold'])})"
    return f"SELECT fold, {RATES['f1']} AS score FROM ({cells('sc', ['fold'])})"


def corr_long() -> str:
    rows = union([f"SELECT ID, '{c}' AS f, CAST({c} AS DOUBLE) AS v FROM cl" for c in CORR_COLUMNS])
    return f"""SELECT a.f AS fx, b.f AS fy, CASE WHEN MIN(a.v) < MAX(a.v) AND MIN(b.v) < MAX(b.v)
    THEN corr(a.v, b.v) END AS c FROM ({rows}) a JOIN ({rows}) b ON a.ID = b.ID GROUP BY a.f, b.f"""


def counted(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", CAST({column} AS VARCHAR) AS value, COUNT(*) AS n,
    {r6(f'COUNT(*) / (SELECT COUNT(*) FROM {source})::DOUBLE', 'ratio')},
    {r6(f'COUNT(*) * 100 / (SELECT COUNT(*) FROM {source})::DOUBLE', 'percentage')} FROM {source} GROUP BY {column}"""


def crossed(column: str, source: str) -> str:
    return f"""CAST({column} AS VARCHAR) AS value, COUNT(*) AS n,
    {r6('AVG(CASE WHEN Target = 0 THEN 1.0 ELSE 0.0 END)', 'share_0')},
    {r6('AVG(CASE WHEN Target = 1 THEN 1.0 ELSE 0.0 END)', 'share_1')} FROM {source} GROUP BY {column}"""


def described(column: str, source: str, name: str | None = None) -> str:
    x = f"CAST({column} AS DOUBLE)"
    quartiles = ", ".join(r6(f"quantile_cont({x}, {q})", n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
    return f"""SELECT '{name or column}' AS "column", COUNT({column}) AS count, {r6(f'AVG({x})', 'mean')},
    {r6(f'STDDEV_SAMP({x})', 'std')}, {r6(f'MIN({x})', 'min')}, {quartiles}, {r6(f'MAX({x})', 'max')} FROM {source}"""


def boxed(column: str) -> str:
    x = f"CAST({column} AS DOUBLE)"
    box = f"""SELECT Target AS k, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2,
    quantile_cont({x}, 0.75) AS q3 FROM ed GROUP BY Target"""
    low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    return f"""SELECT '{column}' AS "column", Target AS label, COUNT({column}) AS n, {r6('MIN(q1)', 'q1')},
    {r6('MIN(q2)', 'median')}, {r6('MIN(q3)', 'q3')},
    {r6(f'MIN(CASE WHEN {x} >= {low} AND {x} <= {high} THEN {x} END)', 'low_whisker')},
    {r6(f'MAX(CASE WHEN {x} >= {low} AND {x} <= {high} THEN {x} END)', 'high_whisker')},
    CAST(SUM(CASE WHEN {x} < {low} OR {x} > {high} THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
    FROM ed JOIN ({box}) ON Target = k GROUP BY Target"""


def binned(column: str, bins: int = 20) -> str:
    x = f"CAST({column} AS DOUBLE)"
    ends = f"SELECT MIN({x}) AS lo, MAX({x}) AS hi, (MAX({x}) - MIN({x})) / {bins} AS w FROM ed"
    b = f"CAST(LEAST(FLOOR(({x} - lo) / w), {bins - 1}) AS INTEGER)"
    return f"""SELECT '{column}' AS "column", Target, {b} AS bin, {r6(f'MIN(lo + {b} * w)', 'lower')},
    {r6(f'MIN(lo + ({b} + 1) * w)', 'upper')}, COUNT(*) AS n FROM ed, ({ends}) GROUP BY Target, {b}"""


def composed(columns: Sequence[str], mix: str) -> str:
    everything = " + ".join(f"SUM({c})" for c in columns)
    names = {c: c.replace("Mnt", "").replace("Num", "").replace("Products", "").replace("Purchases", "") for c in columns}
    return union(
        [
            f"SELECT '{names[c]}' AS category, {r6(f'SUM({c})', 'total')}, "
            f"{r6(f'SUM({c}) * 100.0::DOUBLE / ({everything})', 'percentage')}, '{mix}' AS mix FROM ed"
            for c in columns
        ]
    )


def means_by_label(columns: dict[str, str], name: str, value: str) -> str:
    return union(
        [
            f"SELECT '{shown}' AS {name}, CASE WHEN Target = 0 THEN 'No Purchase' ELSE 'Purchase' END AS Purchase, "
            f"{r6(f'AVG({c})', value)} FROM ed GROUP BY Target"
            for c, shown in columns.items()
        ]
    )


def null_rows(counts_only: bool) -> str:
    columns = [c for c in C360_COLUMNS]
    if counts_only:
        rows = [f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS n_null FROM c360" for c in columns]
        return f"SELECT * FROM ({union(rows)}) WHERE n_null > 0"
    rows = [
        f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS count, "
        f"{r6(f'ROUND((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 2)', 'percentage')} FROM c360"
        for c in columns
    ]
    return f"SELECT * FROM ({union(rows)}) WHERE count > 0"


NUMERIC_TYPES = {
    **{c: "int" for c in ("Year_Birth", "Kidhome", "Teenhome", "Recency", "Target")},
    **{c: "double" for c in ("Income", *SPEND)},
}


def report() -> str:
    rows = []
    for c in C360_COLUMNS:
        if c in ("Education", "Marital_Status", "Dt_Customer"):
            continue
        kind = NUMERIC_TYPES.get(c, "bigint")
        rows.append(
            described(c, "c360").replace(
                " FROM c360",
                f", COUNT(*) - COUNT({c}) AS n_null, '{kind}' AS type, COUNT(*) AS n_rows, 29 AS n_columns FROM c360",
            )
        )
    return sql(["c360"], union(rows))


def audit() -> str:
    rows = []

    def row(step: str, column: str, condition: str) -> None:
        rows.append(
            f"SELECT '{step}' AS step, '{column}' AS \"column\", CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) "
            f"AS BIGINT) AS n_changed FROM c360, clean_stats"
        )

    row("fill_date", "Dt_Customer", "Dt_Customer IS NULL")
    row("fill_income", "Income", "Income IS NULL")
    for c in ("Education", "Marital_Status"):
        row("fill_unknown", c, f"{c} IS NULL")
    for c in ["Kidhome", "Teenhome", "Recency", "NumDealsPurchases", *CHANNELS, "NumWebVisitsMonth", *SPEND]:
        row("clip_negative", c, f"{c} < 0")
    row("cap_income", "Income", "COALESCE(Income, med_income) > cap")
    row("clamp_birth_year", "Year_Birth", f"Year_Birth < {YEAR - 100} OR Year_Birth > {YEAR - 18}")
    for c in ["Complain", *CAMPAIGNS, "Target"]:
        row("coerce_binary", c, f"{c} NOT IN (0, 1)")
    rows.append(
        "SELECT 'drop_duplicates' AS step, 'ID' AS \"column\", COUNT(*) - COUNT(DISTINCT ID) AS n_changed FROM c360"
    )
    return sql(["clean_stats"], union(rows))


def _onehot_orders() -> str:
    levels = {
        "o_orderpriority": ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
        "o_orderstatus": ["O", "P"],
    }
    columns = [f"{flag(f'{c} = {v!r}')} AS \"{c}_{v}\"" for c, vs in levels.items() for v in vs]
    return f"SELECT o_orderkey, {', '.join(columns)} FROM orders"


def _standard() -> str:
    cols = ["Income", "Recency", *SPEND]
    scaled = [r6(f"({c} - (SELECT AVG({c}) FROM cl)) / (SELECT STDDEV_POP({c}) FROM cl)", c) for c in cols]
    return sql(["cl"], f"SELECT ID, {', '.join(scaled)}, {r6('0.0', 'Z_Revenue')} FROM cl")


def _power() -> str:
    long = "(SELECT ID, 'Income' AS col, Income AS x FROM ed UNION ALL SELECT ID, 'TotalSpend', TotalSpend FROM ed)"
    return sql(
        ["ed"],
        f"""SELECT ID, {r6('MAX(CASE WHEN col = $$Income$$ THEN x END)', 'Income')},
        {r6('MAX(CASE WHEN col = $$TotalSpend$$ THEN x END)', 'TotalSpend')},
        {r6('MAX(CASE WHEN col = $$Income$$ THEN z END)', 'Income_norm')},
        {r6('MAX(CASE WHEN col = $$TotalSpend$$ THEN z END)', 'TotalSpend_norm')} FROM (
        SELECT ID, col, x, (y - AVG(y) OVER (PARTITION BY col)) / STDDEV_POP(y) OVER (PARTITION BY col) AS z FROM (
        SELECT ID, v.col, x, {yeo_johnson('x', 'lam')} AS y FROM {long} v JOIN ({best_lambda(long)}) b
        ON v.col = b.col)) GROUP BY ID""".replace("$$", "'"),
    )


def _report_rows() -> str:
    """precision, recall, f1, support for both classes and their averages."""
    one = {
        "p0": div("tn", "tn + fn"), "r0": div("tn", "tn + fp"), "f0": div("2 * tn", "2 * tn + fp + fn"), "s0": "tn + fp",
        "p1": div("tp", "tp + fp"), "r1": div("tp", "tp + fn"), "f1_": div("2 * tp", "2 * tp + fp + fn"), "s1": "tp + fn",
    }
    inner = ", ".join(f"{e} AS {n}" for n, e in one.items())
    rows = {
        "0": ("p0", "r0", "f0", "s0"),
        "1": ("p1", "r1", "f1_", "s1"),
        "accuracy": ("acc", "acc", "acc", "n"),
        "macro avg": ("(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1_) / 2", "n"),
        "weighted avg": tuple(f"({x}0 * s0 + {y} * s1) / n" for x, y in (("p", "p1"), ("r", "r1"), ("f", "f1_"))) + ("n",),
    }
    out = [
        f"SELECT '{name}' AS name, {r6(p, 'precision')}, {r6(r, 'recall')}, {r6(f, 'f1')}, CAST({s} AS BIGINT) AS support FROM rep"
        for name, (p, r, f, s) in rows.items()
    ]
    part("rep", ["sc"], f"SELECT *, (tp + tn) / {_n} AS acc, {_n} AS n, {inner} FROM ({cells('sc')})")
    return sql(["rep"], union(out))


def _kde() -> str:
    return sql(
        ["ed"],
        f"""SELECT Target, {r6('MIN(lo + i * step)', 'x')}, {r6(
            'SUM(EXP(-POW((lo + i * step - Income) / h, 2) / 2)) / (MIN(h) * SQRT(2 * PI()) * MIN(n))', 'density')}
        FROM ed JOIN (SELECT Target AS t, COUNT(*)::DOUBLE AS n, STDDEV_SAMP(Income) * POW(COUNT(*), -0.2) AS h FROM ed
        GROUP BY Target) ON Target = t, (SELECT MIN(Income) AS lo, (MAX(Income) - MIN(Income)) / 99 AS step FROM ed),
        (SELECT UNNEST(range(100)) AS i) GROUP BY Target, i""",
    )


# Neighbours, oversampling, voting --------------------------------------------------------------

KNN_COLUMNS = ["Income", "Recency", "TotalSpend", "TotalPurchases", "Age"]
part(
    "kv",
    ["ed"],
    "SELECT ID AS id, Target AS label, "
    + ", ".join(
        f"FLOOR((CAST({c} AS DOUBLE) - (SELECT AVG({c}) FROM ed)) / (SELECT STDDEV_POP({c}) FROM ed) * 1e4 + 0.5::DOUBLE) / 1e4 AS x{i}"
        for i, c in enumerate(KNN_COLUMNS)
    )
    + f", {md5_order('ID', 42)} AS h FROM ed",
)
part(
    "ks",
    ["kv", "quotas"],
    "SELECT kv.*, ROW_NUMBER() OVER (PARTITION BY label ORDER BY h, id) <= quota AS test FROM kv JOIN quotas ON label = t",
)
_dims = range(len(KNN_COLUMNS))


def gap(p: int) -> str:
    if p == 1:
        return "(" + " + ".join(f"ABS(a.x{i} - b.x{i})" for i in _dims) + ")"
    return "SQRT(" + " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in _dims) + ")"


def knn_vote(weights: str, p: int) -> str:
    w = "1.0::DOUBLE"
    if weights == "distance":
        w = "CASE WHEN MIN(d) OVER (PARTITION BY q) = 0 THEN (CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 / d END"
    return sql(
        ["ks"],
        f"""SELECT q AS ID, {r6('SUM(w * label) / SUM(w)', 'p')}, {flag('SUM(w * label) / SUM(w) > 0.5')} AS prediction
        FROM (SELECT q, label, {w} AS w FROM (SELECT a.id AS q, b.label, {gap(p)} AS d, ROW_NUMBER() OVER (PARTITION BY a.id
        ORDER BY {gap(p)}, b.id) AS rn FROM ks a, ks b WHERE a.test AND NOT b.test) WHERE rn <= 7) GROUP BY q""",
    )


def smote_query() -> str:
    def unit(*parts: str) -> str:
        text = " || '-' || ".join(parts)
        return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"

    part("rare", ["kv"], "SELECT * FROM kv WHERE label = 1")
    part(
        "near",
        ["rare"],
        f"""SELECT * FROM (SELECT a.id AS q, b.id AS n, ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY {gap(2)}, b.id) AS rn
        FROM rare a, rare b WHERE a.id <> b.id) WHERE rn <= 5""",
    )
    pick = unit("CAST(id AS VARCHAR)", "CAST(s AS VARCHAR)", "'pick'", "'42'")
    step = unit("CAST(id AS VARCHAR)", "CAST(s AS VARCHAR)", "'step'", "'42'")
    part(
        "copies",
        ["kv", "rare"],
        f"""SELECT *, CAST(FLOOR({pick} * 5) + 1 AS INTEGER) AS rn, {step} AS step FROM (SELECT id, UNNEST(range(1,
        CAST(c + CASE WHEN r <= e THEN 1 ELSE 0 END + 1 AS BIGINT))) AS s FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY h, id) AS r,
        (m - n) // n AS c, (m - n) % n AS e FROM rare, (SELECT COUNT(*) FILTER (label = 1) AS n,
        COUNT(*) FILTER (label = 0) AS m FROM kv)))""",
    )
    old = ", ".join(r6(f"x{i}", f"x{i}") for i in _dims)
    new = ", ".join(r6(f"a.x{i} + step * (b.x{i} - a.x{i})", f"x{i}") for i in _dims)
    return sql(
        ["copies", "near"],
        f"""SELECT id, CAST(0 AS BIGINT) AS synthetic, label, {old} FROM kv UNION ALL
        SELECT c.id, c.s, 1, {new} FROM copies c JOIN near n ON c.id = n.q AND c.rn = n.rn
        JOIN rare a ON a.id = c.id JOIN rare b ON b.id = n.n""",
    )


def vote(weights: dict[str, float]) -> str:
    p = "(" + " + ".join(f"p_{m} * {w!r}::DOUBLE" for m, w in weights.items()) + f") / {sum(weights.values())!r}::DOUBLE"
    return sql(["sw"], f"SELECT key, label, {r6(p, 'p')}, {flag(f'{p} > 0.5')} AS prediction FROM sw")


def weight_areas() -> str:
    part(
        "wg",
        ["sw"],
        """SELECT key, label, weight, p_recent * weight + p_often * (1.0::DOUBLE - weight) AS p FROM sw,
        (SELECT UNNEST([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS weight)""",
    )
    return f"SELECT {r6('weight', 'weight')}, {r6('auc', 'roc_auc')} FROM ({auc_by_ranks('wg', ['weight'])})"


def subset_areas() -> str:
    tried = [("recent", "often"), ("recent", "noise"), ("often", "noise"), ("recent", "often", "noise")]
    rows = [
        f"SELECT {i} AS position, '{'+'.join(c)}' AS models, label, "
        f"({' + '.join(f'p_{m} * 1.0::DOUBLE' for m in c)}) / {float(len(c))!r}::DOUBLE AS p FROM sw"
        for i, c in enumerate(tried)
    ]
    part("ss", ["sw"], union(rows))
    return f"SELECT position, models, {r6('auc', 'roc_auc')} FROM ({auc_by_ranks('ss', ['position', 'models'])})"


def boost_levels_sql(flags: dict[str, str], rate: float = 0.3, l2: float = 1.0, least: float = 1.0) -> str:
    """One second-order tree of two levels over yes-or-no columns, from the closed forms of gain and leaf weight at probability one half."""
    listed = ", ".join(f"COALESCE(CAST({x} AS INTEGER), 0) AS f{j}" for j, x in enumerate(flags.values()))
    long = " UNION ALL ".join(f"SELECT ID, path, g, {j} AS j, f{j} AS v FROM at" for j in range(len(flags)))
    names = "CASE j " + " ".join(f"WHEN {j} THEN '{n}'" for j, n in enumerate(flags)) + " END"
    value = "CASE j " + " ".join(f"WHEN {j} THEN f{j}" for j in range(len(flags))) + " END"

    def worth(g: str, h: str) -> str:
        return f"POW({g}, 2) / ({h} + {l2}::DOUBLE)"

    def best(rows: str) -> str:
        """The best split of each node of ``rows``, the first flag on ties."""
        return f"""SELECT path, j, gain FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY path ORDER BY gain DESC, j) AS place FROM (
        SELECT path, j, {worth('SUM(g) FILTER (v = 0)', 'COUNT(*) FILTER (v = 0) * 0.25::DOUBLE')}
        + {worth('SUM(g) FILTER (v = 1)', 'COUNT(*) FILTER (v = 1) * 0.25::DOUBLE')} - {worth('SUM(g)', 'COUNT(*) * 0.25::DOUBLE')} AS gain
        FROM ({long.replace('FROM at', f'FROM {rows}')}) GROUP BY path, j
        HAVING COUNT(*) FILTER (v = 0) * 0.25 >= {least} AND COUNT(*) FILTER (v = 1) * 0.25 >= {least}) WHERE gain > 1e-9) WHERE place = 1"""

    return sql(["c360"], f"""SELECT path, rows, {names} AS flag, {r6('COALESCE(gain, 0)', 'gain')}, {r6('value', 'value')} FROM (
        WITH r0 AS (SELECT ID, '' AS path, 0.5::DOUBLE - Target AS g, {listed} FROM c360), b0 AS ({best('r0')}),
        r1 AS (SELECT r0.* REPLACE (CASE WHEN {value} = 1 THEN 'y' ELSE 'n' END AS path) FROM r0, b0), b1 AS ({best('r1')}),
        r2 AS (SELECT r1.* REPLACE (r1.path || CASE WHEN {value} = 1 THEN 'y' ELSE 'n' END AS path) FROM r1 JOIN b1 ON r1.path = b1.path)
        SELECT s.path, s.n AS rows, b.j, b.gain, -{rate}::DOUBLE * s.g / (s.n * 0.25::DOUBLE + {l2}) AS value FROM (
        SELECT path, COUNT(*) AS n, SUM(g) AS g FROM (SELECT path, g FROM r0 UNION ALL SELECT path, g FROM r1 UNION ALL SELECT path, g FROM r2)
        GROUP BY path) s LEFT JOIN (SELECT * FROM b0 UNION ALL SELECT * FROM b1) b ON s.path = b.path)""")


def oracle_sql() -> dict[str, str]:
    """{query name: DuckDB statement}."""
    from buyerscope.plans.catalog import FLAGS, RFM_SETS
    from buyerscope.schema import EDUCATION_ORDER

    before = f"o_orderdate < TIMESTAMP '{CUTOFF}'"
    c360_out = ", ".join(
        "strftime(Dt_Customer, '%Y-%m-%d') AS Dt_Customer" if c == "Dt_Customer"
        else r6(c, c) if c in ["Income", *SPEND] else c
        for c in C360_COLUMNS
    )
    auc_model_fold = auc_by_ranks("sl", ["model", "fold"])
    campaigns = {c: c.replace("AcceptedCmp", "Campaign ") for c in CAMPAIGNS}
    channels = {f"{c}Proportion": c for c in ("Web", "Catalog", "Store")}
    by_campaign = union(
        [f"SELECT '{n}' AS Campaign, {r6(f'AVG({c})', 'Acceptance_Rate')} FROM ed" for c, n in campaigns.items()]
    )
    out = {
        "customer_360": sql(["c360"], f"SELECT {c360_out} FROM c360"),
        "null_profile": sql(["c360"], null_rows(False)),
        "null_counts": sql(["c360"], null_rows(True)),
        "dataset_report": report(),
        "describe": sql(["cl"], union([described(c, "cl") for c in ["Income", "Recency", *SPEND]])),
        "cleaning_audit": audit(),
        "clean_impute": sql(["cl"], f"SELECT {_clean_out} FROM cl"),
        "clean_clip": f"SELECT c_custkey, {r6('GREATEST(c_acctbal, 0.0)', 'balance')} FROM customer",
        "clean_winsorize": f"""SELECT l_orderkey, l_partkey, l_suppkey, {r6('l_extendedprice', 'l_extendedprice')},
            {r6('LEAST(l_extendedprice, cap)', 'capped')}, {flag('l_extendedprice > cap')} AS changed
            FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.995) AS cap FROM lineitem)""",
        "clean_clamp": sql(
            ["c360"],
            f"""SELECT ID, {_clean_expr['Year_Birth']} AS Year_Birth,
            {flag(f'Year_Birth < {YEAR - 100} OR Year_Birth > {YEAR - 18}')} AS changed FROM c360""",
        ),
        "clean_binary": sql(
            ["c360"],
            "SELECT ID, " + ", ".join(f"{flag(f'{c} > 0')} AS {c}" for c in ["NumDealsPurchases", *CHANNELS, "NumWebVisitsMonth"]) + " FROM c360",
        ),
        "impute_strategies": f"""SELECT c_custkey,
            {r6('CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE med END', 'by_median')},
            CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE top END AS by_mode,
            CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE 'Unknown' END AS by_constant FROM customer,
            (SELECT median(c_acctbal) AS med FROM customer WHERE c_acctbal >= 0),
            (SELECT c_mktsegment AS top FROM customer WHERE c_acctbal >= 0 GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)""",
        "dedupe_first": f"""SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_partkey,
            l_suppkey, {r6('l_quantity', 'l_quantity')}, {r6('l_extendedprice', 'l_extendedprice')} FROM (SELECT *,
            ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey,
            l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
        "duplicate_count": """SELECT COUNT(*) AS n_rows, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS n_keys,
            COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem""",
        "out_of_bounds": union(
            [
                f"SELECT '{c}' AS \"column\", CAST(SUM({flag(t)}) AS BIGINT) AS n_outside FROM lineitem"
                for c, t in [("l_quantity", "l_quantity < 5 OR l_quantity > 45"), ("l_discount", "l_discount > 0.08"),
                             ("l_extendedprice", "l_extendedprice < 1000")]
            ]
        ),
        "date_parse": f"""SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS day, CAST({DAY} - day AS INTEGER) AS tenure_days,
            {r6(f'({DAY} - day) / 30.44::DOUBLE', 'tenure_months')}, {r6(f'({DAY} - day) / 365.25::DOUBLE', 'tenure_years')},
            CAST(year(day) AS INTEGER) AS enroll_year, CAST(month(day) AS INTEGER) AS enroll_month,
            CAST(quarter(day) AS INTEGER) AS enroll_quarter, CAST(dayofmonth(day) AS INTEGER) AS enroll_day,
            CAST(isodow(day) - 1 AS INTEGER) AS enroll_dayofweek, {flag('isodow(day) >= 6')} AS enroll_weekend,
            {r6('SIN(2 * PI() * month(day) / 12)', 'enrollmonth_sin')}, {r6('COS(2 * PI() * month(day) / 12)', 'enrollmonth_cos')}
            FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders)""",
        "leakage_check": f"""SELECT COUNT(*) FILTER (a) AS n_train, COUNT(*) FILTER (b) AS n_test,
            COUNT(*) FILTER (a AND b) AS n_overlap FROM (SELECT o_custkey, BOOL_OR({before}) AS a,
            BOOL_OR(NOT {before}) AS b FROM orders GROUP BY 1)""",
        "shared_customers": f"""SELECT o_custkey FROM orders WHERE {before}
            INTERSECT SELECT o_custkey FROM orders WHERE NOT {before}""",
        "append_union": f"""SELECT c_custkey AS key, {r6('c_acctbal', 'c_acctbal')}, NULL::INTEGER AS s_nationkey FROM customer
            UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier""",
        "align_schema": sql(
            ["c360"], f"SELECT ID, {r6('Income', 'Income')}, 0 AS Absent, Recency, {r6('MntWines', 'MntWines')} FROM c360"
        ),
        "template_fill": sql(
            ["sc"],
            f"""SELECT key AS ID, {flag('p >= 0.5')} AS Target FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label
            ORDER BY {md5_order('key', 42)}, key) AS rn, COUNT(*) OVER (PARTITION BY label) AS n FROM sc)
            WHERE rn <= ROUND(0.2 * n)""",
        ),
        "feat_core": core_query(),
        "feat_eda": sql(["ed"], f"SELECT {_eda_out} FROM ed"),
        **{name: rfm_query(columns) for name, columns in RFM_SETS.items()},
        "feat_onehot": onehot_query(),
        "feat_compact": compact_query(),
        "feat_lean": lean_query(),
        "quantile_bins": f"""SELECT o_orderkey, {r6('o_totalprice', 'o_totalprice')}, {qindex('o_totalprice', 'ends')} AS bin,
            CASE WHEN o_totalprice > 0 AND o_totalprice <= 100000 THEN 'low' WHEN o_totalprice > 100000 AND o_totalprice
            <= 250000 THEN 'mid' WHEN o_totalprice > 250000 AND o_totalprice <= 400000 THEN 'high' END AS band
            FROM orders, (SELECT quantile_cont(o_totalprice, {_five}) AS ends FROM orders)""",
        "onehot": _onehot_orders(),
        "ordinal": """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1
            WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE -1 END AS code FROM orders""",
        "standard_scale": _standard(),
        "power_transform": _power(),
        "value_counts": sql(
            ["ed"],
            union([counted(c, "ed") for c in ["Target", "Education", "Marital_Status", "FamilySize", "Complain",
                                              "TotalAcceptedCampaigns"]]),
        ),
        "target_rate": sql(
            ["cl"], f"SELECT Education AS value, COUNT(*) AS n, {r6('AVG(Target)', 'rate')} FROM cl GROUP BY Education"
        ),
        "crosstab": sql(
            ["ed"],
            union([f"SELECT '{c}' AS \"column\", " + crossed(c, "ed") for c in
                   ["Education", "FamilySize", "Complain", "TotalAcceptedCampaigns"]]),
        ),
        "tier_crosstab": sql(
            ["rf", "rfstats"],
            "SELECT " + crossed("RFM_Score", f"(SELECT Target, {RFM['RFM_Score'][0]} AS RFM_Score FROM rf, rfstats)"),
        ),
        "group_size": sql(["cl"], "SELECT Complain, COUNT(*) AS n FROM cl GROUP BY Complain"),
        "composition": sql(["ed"], union([composed(SPEND, "spend"), composed(CHANNELS, "channel")])),
        "campaign_rates": sql(["ed"], by_campaign),
        "campaign_by_label": sql(["ed"], means_by_label(campaigns, "Campaign", "Acceptance_Rate")),
        "channel_by_label": sql(["ed"], means_by_label(channels, "Channel", "Proportion")),
        "melt_spend": sql(
            ["ed"],
            union([f"SELECT Target, '{c.replace('Mnt', '').replace('Products', '')}' AS Category, {r6(c, 'Amount')} FROM ed"
                   for c in SPEND]),
        ),
        "distinct_values": "SELECT DISTINCT event_type FROM events",
        "constant_columns": sql(
            ["c360"],
            "SELECT * FROM (" + union([
                f"SELECT CASE WHEN MIN({c}) IS NOT DISTINCT FROM MAX({c}) THEN '{c}' END AS \"column\" FROM c360"
                for c in C360_COLUMNS if c not in ("Education", "Marital_Status", "Dt_Customer")
            ]) + ") WHERE \"column\" IS NOT NULL",
        ),
        "corr_matrix": sql(
            ["cl"], f"SELECT fx AS feature_x, fy AS feature_y, {r6('c', 'correlation')} FROM ({corr_long()})"
        ),
        "corr_target": sql(
            ["cl"], f"SELECT fx AS feature, {r6('c', 'correlation')} FROM ({corr_long()}) WHERE fy = 'Target'"
        ),
        "corr_extremes": sql(
            ["cl"],
            f"""SELECT side, fx AS feature, {r6('c', 'correlation')} FROM (
            SELECT 'top' AS side, fx, c, ROW_NUMBER() OVER (ORDER BY c DESC, fx) AS rn FROM ({corr_long()})
            WHERE fy = 'Target' AND fx <> 'Target' AND c IS NOT NULL UNION ALL
            SELECT 'bottom', fx, c, ROW_NUMBER() OVER (ORDER BY c, fx) FROM ({corr_long()})
            WHERE fy = 'Target' AND fx <> 'Target' AND c IS NOT NULL) WHERE rn <= 5""",
        ),
        "histogram": sql(["ed"], union([binned(c) for c in ["Age", "Income", "TotalSpend"]])),
        "kde": _kde(),
        "boxplot": sql(["ed"], union([boxed(c) for c in ["Income", "TotalSpend", "Recency", "NumDealsPurchases"]])),
        "top_campaign": sql(["ed"], f"SELECT * FROM ({by_campaign}) ORDER BY Acceptance_Rate DESC, Campaign LIMIT 1"),
        "class_weights": sql(
            ["c360"],
            f"""SELECT Target AS label, COUNT(*) AS n, {r6('MIN(t) / (2.0::DOUBLE * COUNT(*))', 'balanced')},
            {r6('CASE WHEN Target = 1 THEN MIN(z) / COUNT(*)::DOUBLE ELSE 1.0 END', 'scale_pos_weight')},
            {r6('CASE WHEN Target = 1 THEN 0.61::DOUBLE / 0.39::DOUBLE ELSE 1.0 END', 'fixed')} FROM c360,
            (SELECT COUNT(*) AS t, COUNT(*) FILTER (Target = 0) AS z FROM c360) GROUP BY Target""",
        ),
        "sample_n": sql(
            ["c360"], f"SELECT ID, {r6('Income', 'Income')} FROM c360 ORDER BY {md5_order('ID', 42)}, ID LIMIT 100"
        ),
        "split_stratified": sql(
            ["c360", "quotas"],
            f"""SELECT ID, Target, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM (
            SELECT ID, Target, ROW_NUMBER() OVER (PARTITION BY Target ORDER BY {md5_order('ID', 42)}, ID) AS rn FROM c360)
            JOIN quotas ON Target = t""",
        ),
        "kfold": sql(["folds"], "SELECT ID, Target, fold FROM folds"),
        "kfold_documents": f"""SELECT doc_id, quality, CAST((ROW_NUMBER() OVER (ORDER BY quality,
            {md5_order('doc_id', 42)}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels""",
        "confusion": sql(
            ["sc"],
            f"""SELECT l AS label, q AS prediction, COUNT(key) AS n, {r6(
                'COUNT(key) / (SELECT COUNT(*) FROM sc WHERE label = l)::DOUBLE', 'share')}
            FROM (SELECT UNNEST([0, 0, 1, 1]) AS l, UNNEST([0, 1, 0, 1]) AS q) LEFT JOIN sc
            ON label = l AND {flag('p >= 0.5')} = q GROUP BY l, q""",
        ),
        "binary_metrics": metrics_query(["sl"], "sl", ["model"]),
        "document_metrics": metrics_query(["ds"], "ds"),
        "oof_metrics": metrics_query(["sc"], "sc", prefix="cv_"),
        "roc_auc": sql(["sl"], f"SELECT model, fold, {r6('auc', 'roc_auc')} FROM ({auc_model_fold})"),
        "avg_precision": sql(
            ["sl"], f"SELECT model, {r6('ap', 'average_precision')} FROM ({average_precision('sl', ['model'])})"
        ),
        "roc_curve": sql(
            ["sc"],
            f"""SELECT {r6('p', 'threshold')}, {r6('fp / nn', 'fpr')}, {r6('tp / np', 'tpr')} FROM ({ranked('sc')})
            UNION ALL SELECT NULL, 0.0, 0.0""",
        ),
        "pr_curve": sql(
            ["sc"],
            f"""SELECT {r6('p', 'threshold')}, {r6('tp / (tp + fp)', 'precision')}, {r6('tp / np', 'recall')},
            {r6('np / (np + nn)', 'baseline')} FROM ({ranked('sc')}) UNION ALL
            SELECT NULL, 1.0, 0.0, {r6('AVG(label)', 'baseline')} FROM sc""",
        ),
        "curve_areas": sql(
            ["sl"],
            f"""SELECT model, {r6('SUM((x - COALESCE(px, 0)) * (y + COALESCE(py, 0)) / 2)', 'roc_area')},
            {r6('SUM((y - COALESCE(py, 0)) * (q + COALESCE(pq, 1)) / 2)', 'pr_area')} FROM (SELECT *,
            LAG(x) OVER w AS px, LAG(y) OVER w AS py, LAG(q) OVER w AS pq FROM (SELECT model, p, fp / nn AS x, tp / np AS y,
            tp / (tp + fp) AS q FROM ({ranked('sl', ['model'])})) WINDOW w AS (PARTITION BY model ORDER BY p DESC))
            GROUP BY model""",
        ),
        "calibration": sql(
            ["sl"],
            f"""SELECT model, CAST(GREATEST(CEIL(p * 10) - 1, 0) AS INTEGER) AS bin, COUNT(*) AS n,
            {r6('AVG(p)', 'mean_predicted')}, {r6('AVG(label)', 'fraction_positive')} FROM sl GROUP BY 1, 2""",
        ),
        "class_report": _report_rows(),
        "threshold_sweep": sql(
            ["sl"],
            f"""SELECT model, {r6('threshold', 'threshold')}, {', '.join(r6(RATES[m], m) for m in
                ('accuracy', 'balanced_accuracy', 'precision', 'recall', 'f1'))} FROM ({sweep('sl', SWEEP, ['model'])})""",
        ),
        "best_thresholds": sql(
            ["sl"],
            union([
                f"""SELECT model, '{m}' AS metric, {r6('threshold', 'threshold')}, {r6('v', 'value')} FROM (SELECT model,
                threshold, {RATES[m]} AS v, ROW_NUMBER() OVER (PARTITION BY model ORDER BY {RATES[m]} DESC, threshold) AS rn
                FROM ({sweep('sl', SWEEP, ['model'])})) WHERE rn = 1"""
                for m in ("accuracy", "balanced_accuracy", "f1")
            ]),
        ),
        "f1_sweep": sql(["sc"], f"SELECT {r6('threshold', 'threshold')}, {r6(RATES['f1'], 'f1')} FROM ({sweep('sc', DENSE)})"),
        "cv_threshold": sql(
            ["sc"],
            union([
                f"SELECT {r6('AVG(threshold)', 'threshold')}, '{m}' AS metric FROM ({thresholds_by_fold(m)})"
                for m in ("f1", "precision", "recall", "geometric_mean")
            ]),
        ),
        "fold_scores": sql(["sc"], f"SELECT fold, {r6('score', 'score')} FROM ({fold_score('roc_auc')})"),
        "fold_spread": sql(
            ["sc"],
            union([
                f"SELECT {r6('AVG(score)', 'mean')}, {r6('STDDEV_POP(score)', 'std')}, '{m}' AS scoring FROM ({fold_score(m)})"
                for m in ("roc_auc", "average_precision", "f1")
            ]),
        ),
        "score_hist": sql(
            ["sc"],
            f"""SELECT label, CAST(LEAST(FLOOR((p - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, COUNT(*) AS n FROM sc JOIN
            (SELECT label AS l, MIN(p) AS lo, MAX(p) AS hi FROM sc GROUP BY label) ON label = l GROUP BY 1, 2""",
        ),
        "prediction_summary": sql(
            ["sc"],
            f"""SELECT COUNT(*) AS n, COUNT(*) FILTER (p >= 0.5) AS positives, {r6(f'AVG({flag("p >= 0.5")})', 'positive_rate')},
            {r6('MIN(p)', 'min_p')}, {r6('MAX(p)', 'max_p')}, {r6('AVG(p)', 'mean_p')} FROM sc""",
        ),
    }
    out["knn_embeddings"] = f"""SELECT query_id, rank, base_id, {r6('d', 'distance')} FROM (SELECT a.vec_id AS query_id,
        b.vec_id AS base_id, d, CAST(ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS INTEGER) AS rank
        FROM embeddings a, embeddings b, LATERAL (SELECT list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d)
        WHERE a.vec_id <> b.vec_id) WHERE rank <= 5"""
    out["knn_classify"] = knn_vote("uniform", 2)
    out["knn_classify_distance"] = knn_vote("distance", 1)
    out["smote"] = smote_query()
    out["boost_levels"] = boost_levels_sql(FLAGS)
    filled = """SELECT ID, COALESCE(CAST(Income AS DOUBLE), (SELECT median(Income) FROM c360)) AS Income, CAST(Recency AS DOUBLE) AS Recency,
        Education FROM c360"""
    levels = ", ".join(f"CASE WHEN Education = '{e}' THEN 1.0::DOUBLE ELSE 0.0 END AS \"Education_{e}\"" for e in sorted(EDUCATION_ORDER))
    out["column_transformed"] = sql(["c360"], f"""SELECT ID, {r6('(Income - mi) / si', 'Income')}, {r6('(Recency - mr) / sr', 'Recency')}, {levels}
        FROM ({filled}), (SELECT AVG(Income) AS mi, STDDEV_POP(Income) AS si, AVG(Recency) AS mr, STDDEV_POP(Recency) AS sr FROM ({filled}))""")
    out["soft_vote"] = vote({"recent": 1.0, "often": 1.0, "noise": 1.0})
    out["weighted_vote"] = vote({"recent": 0.6, "often": 0.2, "noise": 0.2})
    areas, groups = weight_areas(), subset_areas()
    out["weight_grid"] = sql(["wg"], areas)
    out["best_weight"] = sql(["wg"], f"SELECT * FROM ({areas}) ORDER BY roc_auc DESC, weight LIMIT 1")
    out["subset_search"] = sql(["ss"], groups)
    out["best_subset"] = sql(["ss"], f"SELECT * FROM ({groups}) ORDER BY roc_auc DESC, position LIMIT 1")
    scaled = scaled_query()
    # Power columns use refined lambdas, which SQL does not search for: only the scaled columns have an oracle.
    out["eval_summary"] = _summary()
    out["scaled_ratios"] = sql(["rfw"], f"SELECT ID, {', '.join(scaled)} FROM rfw")
    return out


def _summary() -> str:
    part("f0", ["sc"], "SELECT * FROM sc WHERE fold = 0")
    part("others", ["sc"], "SELECT * FROM sc WHERE fold <> 0")
    kept = ("accuracy", "balanced_accuracy", "precision", "recall", "f1")
    return sql(
        ["f0", "others"],
        f"""SELECT 'recent' AS model, a.*, {r6('u.auc', 'roc_auc')}, {r6('q.ap', 'average_precision')},
        b.*, {r6('v.auc', 'cv_roc_auc')}, t.* FROM
        (SELECT {', '.join(r6(RATES[m], m) for m in kept)} FROM ({cells('f0')})) a, ({auc_by_ranks('f0')}) u,
        ({average_precision('f0')}) q, ({auc_by_ranks('others')}) v,
        (SELECT {r6(RATES['accuracy'], 'cv_accuracy')}, {r6(RATES['f1'], 'cv_f1')} FROM ({cells('others')})) b,
        (SELECT {r6('threshold', 'optimal_f1_threshold')} FROM (SELECT threshold, {RATES['f1']} AS v
        FROM ({sweep('f0', SWEEP)})) ORDER BY v DESC, threshold LIMIT 1) t""",
    )
