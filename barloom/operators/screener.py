"""Industry groups, long-term trends and the company screener."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import compound_growth, computed_once

# Industry group -> words in the filed industry name, first match in this order.
INDUSTRY_GROUPS = {
    "semiconductor": (
        "semiconductor", "printed circuit", "electronic component", "electronic connector",
        "drawing & insulating of  nonferrous wire",
    ),
    "software": (
        "prepackaged software", "computer programming", "computer processing", "computer integrated systems",
        "services-business services", "consumer credit reporting", "advertising agencies",
    ),
    "hardware": (
        "electronic computers", "computer storage", "computer peripheral", "computer & office equipment",
        "computer communications", "telephone & telegraph apparatus", "communications equipment",
        "radio & tv broadcasting & communications equipment",
    ),
    "healthcare": (
        "pharmaceutical", "biological products", "surgical & medical", "orthopedic", "hospital & medical", "in vitro",
        "medical laborator", "x-ray apparatus", "electromedical", "general medical & surgical", "ophthalmic", "misc health",
        "commercial physical & biological research", "wholesale-drugs", "wholesale-medical", "retail-drug stores",
    ),
    "energy": ("crude petroleum", "petroleum refining", "natural gas", "oil & gas", "oil royalty", "cogeneration"),
    "utilities": ("electric services", "electric & other services", "gas & other services", "water supply", "refuse systems"),
    "financials": ("commercial banks", "security brokers", "security & commodity", "investment advice", "finance services"),
    "insurance": ("insurance", "life insurance", "accident & health"),
    "realestate": ("real estate", "operative builders", "residential bldgs"),
    "industrial": (
        "machinery", "engines & turbines", "motors & generators", "aircraft", "guided missiles", "ordnance", "ship & boat",
        "railroad equipment", "metal cans", "fabricated metal", "industrial instruments", "measuring & controlling",
        "laboratory analytical", "instruments for meas", "optical instruments", "search, detection", "auto controls",
        "heating equip", "air-cond", "pumps & pumping", "electrical work", "heavy construction",
        "electronic & other electrical", "miscellaneous manufacturing", "cutlery", "household appliances",
        "services-engineering", "services-equipment rental", "services-management", "services-detective",
        "services-to dwellings",
    ),
    "materials": (
        "chemicals", "plastic materials", "paints", "paper mills", "paperboard", "converted paper", "steel works",
        "rolling drawing", "metal mining", "gold and silver", "mining & quarrying", "cement", "agricultural chemicals",
    ),
    "transport": (
        "air transportation", "air courier", "railroads", "trucking", "water transportation", "transportation services",
        "arrangement of  transportation",
    ),
    "consumer": (
        "beverages", "bottled & canned", "malt beverages", "cigarettes", "food", "grain mill", "meat packing", "poultry",
        "sugar & confectionery", "fats & oils", "canned", "retail-", "apparel", "men's & boys", "rubber & plastics footwear",
        "leather", "perfumes", "soap, detergents", "specialty cleaning", "games, toys", "hotels & motels",
        "wholesale-groceries", "wholesale-", "household", "home furniture", "auto & home supply", "agricultural production",
    ),
    "automotive": ("motor vehicle", "motor vehicles & passenger"),
    "media": (
        "cable & other pay television", "television broadcasting", "newspapers", "publishing", "amusement & recreation",
        "video tape rental", "radiotelephone", "telephone communications", "communications services",
    ),
}
UNCLASSIFIED = "other"

# Long-term trend -> industry groups; a company can be in several.
TRENDS = {
    "ai": ("semiconductor", "software", "hardware"),
    "cloud": ("software", "hardware"),
    "healthcare": ("healthcare",),
    "energy_transition": ("utilities", "automotive", "materials"),
    "digital_finance": ("financials", "insurance"),
    "infrastructure": ("industrial", "transport", "materials"),
    "consumer": ("consumer", "media"),
    "real_assets": ("realestate", "energy"),
}


def classify_industry(industry: Column) -> Column:
    """Group of the first needle found, in declared order."""
    text = F.lower(F.trim(F.coalesce(industry, F.lit(""))))
    out = F.when(text == "", UNCLASSIFIED)
    for group, needles in INDUSTRY_GROUPS.items():
        found = F.lit(False)
        for needle in needles:
            found = found | text.contains(needle)
        out = out.when(found, group)
    return out.otherwise(UNCLASSIFIED)


def trends_of(group: Column) -> Column:
    hits = [F.when(group.isin(*groups), F.lit(trend)) for trend, groups in TRENDS.items()]
    return F.array_compact(F.array(*hits))


def quality_snapshot(annual: DataFrame) -> DataFrame:
    """ROE, D/E, margin and revenue CAGR over (statements - 1) years; NULL with one statement."""
    ends = annual.groupBy("symbol").agg(
        F.count(F.lit(1)).cast("int").alias("statements"),
        F.max("period_end").alias("period"),
        F.min_by("total_revenue", "period_end").alias("_first"),
        F.max_by(F.struct("total_revenue", "roe", "debt_to_equity", "net_margin"), "period_end").alias("z"),
    )
    years = F.greatest(F.lit(1), F.col("statements") - 1)
    many = F.col("statements") >= 2
    return ends.select(
        "symbol",
        "statements",
        F.when(many, F.col("period")).alias("period"),
        F.when(many, F.round("z.roe", 1)).alias("roe"),
        F.when(many, F.round("z.debt_to_equity", 2)).alias("debt_to_equity"),
        F.when(many, F.round("z.net_margin", 1)).alias("net_margin"),
        F.when(many, F.round(compound_growth(F.col("z.total_revenue"), F.col("_first"), years), 1)).alias("revenue_cagr"),
    )


def build_screener(filings: DataFrame, snapshots: DataFrame, quality: DataFrame, reviewed: DataFrame | None = None, market: str = "US") -> DataFrame:
    """Companies with a filing: industry group, trends and quality figures."""
    out = filings.join(snapshots.select("symbol", "name", "market"), "symbol")
    if market.upper() != "ALL":
        out = out.filter(F.upper("market") == market.upper())
    # Some hundred comparisons, made once per company and not copied into every use.
    out = computed_once(out, {"industry_group": classify_industry(F.col("industry"))})
    out = computed_once(out, {"trends": trends_of(F.col("industry_group"))}).join(quality, "symbol", "left")
    if reviewed is not None:
        out = out.join(reviewed.select("symbol", F.lit(True).alias("_r")).distinct(), "symbol", "left")
        return out.withColumn("reviewed", F.coalesce("_r", F.lit(False))).drop("_r")
    return out.withColumn("reviewed", F.lit(False))


def filter_companies(
    companies: DataFrame,
    *,
    trend: str | None = None,
    industry: str = "ALL",
    min_roe: float | None = None,
    min_growth: float | None = None,
    max_debt: float | None = None,
    search: str = "",
) -> DataFrame:
    """Screen by trend, industry and figures; an unknown figure fails its filter. Fastest growers first."""
    out = companies
    if trend:
        out = out.filter(F.array_contains("trends", trend))
    if industry != "ALL":
        out = out.filter(F.col("industry_group") == industry)
    if min_roe:
        out = out.filter(F.col("roe") >= min_roe)
    if min_growth:
        out = out.filter(F.col("revenue_cagr") >= min_growth)
    if max_debt:
        out = out.filter(F.col("debt_to_equity") <= max_debt)
    if search.strip():
        out = out.filter(F.lower(F.concat_ws(" ", "symbol", "name")).contains(search.strip().lower()))
    return out.orderBy(F.col("revenue_cagr").desc_nulls_last(), "symbol")


def industry_counts(companies: DataFrame) -> DataFrame:
    return companies.groupBy("industry_group").agg(F.count(F.lit(1)).alias("companies"))


def trend_counts(companies: DataFrame) -> DataFrame:
    """A company counts once in each of its trends; trends without one show zero."""
    counts = companies.select(F.explode("trends").alias("trend")).groupBy("trend").agg(F.count(F.lit(1)).alias("n"))
    all_trends = companies.sparkSession.createDataFrame([(t,) for t in TRENDS], "trend string")
    return all_trends.join(counts, "trend", "left").select("trend", F.coalesce("n", F.lit(0)).alias("companies"))


def industry_choices(companies: DataFrame, trend: str | None = None) -> DataFrame:
    """Industries on offer, limited to the chosen trend's groups."""
    counts = industry_counts(companies)
    return counts.filter(F.col("industry_group").isin(*TRENDS[trend])) if trend else counts
