"""Raw filing facts to annual and quarterly periods.

Facts are a long table: symbol, taxonomy, concept, unit, start, end (dates), val,
fy, form, filed (date), accn. Every step is a join, window or aggregate keyed by
symbol and period; only a symbol's fiscal calendar, a handful of years, is held
as an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.session import cut_lineage

# Filing forms by kind.
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A")
QUARTERLY_FORMS = ("10-Q", "10-Q/A")
TRANSITION_FORMS = ("10-KT", "10-KT/A", "10-QT", "10-QT/A")

# Concepts per metric and taxonomy, preferred first.
US_GAAP = {
    "total_revenue": (
        "Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueGoodsNet", "OperatingRevenues",
    ),
    "cost_of_revenue": ("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("OperatingIncomeLoss",),
    "pretax_income": (
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxes",
    ),
    "tax_provision": ("IncomeTaxExpenseBenefit",),
    "net_income": ("NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"),
    "basic_eps": ("EarningsPerShareBasic",),
    "total_assets": ("Assets",),
    "current_assets": ("AssetsCurrent",),
    "total_liabilities": ("Liabilities",),
    "current_liabilities": ("LiabilitiesCurrent",),
    "total_debt": ("LongTermDebtAndFinanceLeaseObligations", "LongTermDebtAndCapitalLeaseObligations"),
    "_debt_current": (
        "LongTermDebtAndFinanceLeaseObligationsCurrent", "LongTermDebtAndCapitalLeaseObligationsCurrent", "LongTermDebtCurrent",
    ),
    "_debt_noncurrent": (
        "LongTermDebtAndFinanceLeaseObligationsNoncurrent", "LongTermDebtAndCapitalLeaseObligationsNoncurrent", "LongTermDebtNoncurrent",
    ),
    "_short_term_borrowings": ("ShortTermBorrowings", "ShortTermDebtCurrent"),
    "stockholders_equity": (
        "StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "PartnersCapital",
    ),
    "cash_and_equivalents": (
        "CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "CashAndDueFromBanks",
    ),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
    "capital_expenditure": ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsForAdditionsToPropertyPlantAndEquipment"),
}
IFRS = {
    "total_revenue": ("Revenue",),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("ProfitLossFromOperatingActivities",),
    "pretax_income": ("ProfitLossBeforeTax",),
    "tax_provision": ("IncomeTaxExpenseContinuingOperations", "IncomeTaxExpense"),
    "net_income": ("ProfitLoss",),
    "basic_eps": ("BasicEarningsLossPerShare",),
    "total_assets": ("Assets",),
    "current_assets": ("CurrentAssets",),
    "total_liabilities": ("Liabilities",),
    "current_liabilities": ("CurrentLiabilities",),
    "stockholders_equity": ("Equity", "EquityAttributableToOwnersOfParent"),
    "cash_and_equivalents": ("CashAndCashEquivalents",),
    "operating_cash_flow": ("CashFlowsFromUsedInOperatingActivities",),
    "capital_expenditure": ("PurchaseOfPropertyPlantAndEquipment",),
}
FLOWS = (
    "total_revenue", "cost_of_revenue", "gross_profit", "operating_income", "pretax_income", "tax_provision", "net_income",
    "basic_eps", "operating_cash_flow", "capital_expenditure",
)
CUMULATIVE = ("operating_cash_flow", "capital_expenditure")
INTERNAL = ("_debt_current", "_debt_noncurrent", "_short_term_borrowings")
IFRS_PENALTY = 100


def concept_map(spark) -> DataFrame:
    rows = [("us-gaap", c, m, i) for m, cs in US_GAAP.items() for i, c in enumerate(cs)]
    rows += [("ifrs-full", c, m, i + IFRS_PENALTY) for m, cs in IFRS.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "taxonomy string, concept string, metric string, priority int")


def filing_url(cik: Column, accession: Column) -> Column:
    compact = F.regexp_replace(accession, "-", "")
    number = cik.cast("bigint").cast("string")
    return F.when(
        accession != "",
        F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), number, F.lit("/"), compact, F.lit("/"), accession, F.lit("-index.html")),
    ).otherwise("")


def mapped_facts(facts: DataFrame) -> DataFrame:
    """Facts of known concepts with metric, priority, duration and filing delay.

    The concept table is a fixed list of about sixty rows.
    """
    usable = facts.filter(F.col("val").isNotNull() & ~F.isnan("val") & (F.abs("val") < float("inf")) & F.col("end").isNotNull())
    out = usable.join(F.broadcast(concept_map(facts.sparkSession)), ["taxonomy", "concept"])
    return out.withColumns(
        {
            "duration": F.datediff("end", "start"),
            "delay": F.datediff("filed", "end"),
            "concept_name": F.concat_ws(":", "taxonomy", "concept"),
        }
    )


def reporting_currency(mapped: DataFrame) -> DataFrame:
    """Currency of the newest period, then of most records on it, then of most records, then USD."""
    forms = ANNUAL_FORMS + QUARTERLY_FORMS + TRANSITION_FORMS
    rows = mapped.filter(
        F.col("metric").isin("total_revenue", "total_assets", "net_income") & F.col("unit").rlike("^[A-Z]{3}$") & F.col("form").isin(*forms)
    )
    per_end = rows.groupBy("symbol", "unit", "end").agg(F.count_distinct("metric").alias("n"))
    per_unit = per_end.groupBy("symbol", "unit").agg(F.max("end").alias("latest"), F.max_by("n", "end").alias("on_latest"), F.sum("n").alias("n"))
    best = F.max_by("unit", F.struct("latest", "on_latest", "n", (F.col("unit") == "USD")))
    found = per_unit.groupBy("symbol").agg(best.alias("currency"))
    return mapped.select("symbol").distinct().join(found, "symbol", "left").withColumn("currency", F.coalesce("currency", F.lit("USD")))


def in_currency(mapped: DataFrame, currency: DataFrame) -> DataFrame:
    """Facts in the reporting currency; per-share facts in the best matching unit of their concept."""
    out = mapped.join(currency, "symbol")
    unit, code = F.col("unit"), F.col("currency")
    rank = (
        F.when(unit == F.concat(code, F.lit("/shares")), 0)
        .when(unit == F.concat(code, F.lit("/share")), 1)
        .when(F.contains(unit, code) & F.lower(unit).contains("share"), 2)
    )
    rank = F.when(F.col("metric") == "basic_eps", rank).otherwise(F.when(unit == code, 0))
    w = Window.partitionBy("symbol", "metric", "concept_name")
    out = out.withColumn("_u", rank).filter("_u is not null")
    return out.withColumn("_best", F.min("_u").over(w)).filter("_u = _best").drop("_u", "_best")


def is_flow() -> Column:
    return F.col("metric").isin(*FLOWS)


def valid_annual() -> Column:
    return F.coalesce(
        F.col("form").isin(*ANNUAL_FORMS) & (F.col("delay") >= 0) & (~is_flow() | F.col("duration").between(330, 400)), F.lit(False)
    )


def valid_quarter() -> Column:
    return F.coalesce(
        F.col("form").isin(*QUARTERLY_FORMS, *ANNUAL_FORMS) & (F.col("delay") >= 0) & (~is_flow() | F.col("duration").between(45, 310)),
        F.lit(False),
    )


def fiscal_calendar(facts: DataFrame) -> DataFrame:
    """symbol, years: array of (end, start, fiscal_year, filed), oldest first.

    Full-year flows anchor a year. Each filing votes once for the fiscal year
    its label implies for the newest year; the later year wins a tie. Years
    within a week of each other are versions of one, the latest filed stays.
    """
    a = facts.filter(valid_annual() & is_flow() & F.col("start").isNotNull())
    spans = a.groupBy("symbol", "end", "start").agg(F.count_distinct("metric").alias("n"), F.max("filed").alias("filed"))
    ends = spans.groupBy("symbol", "end").agg(F.max_by("start", F.struct("n", "start")).alias("start"), F.max("filed").alias("filed"))
    latest = ends.groupBy("symbol").agg(F.max("end").alias("latest"))
    filing_end = F.max("end").over(Window.partitionBy("symbol", "accn"))
    years_back = F.bround(F.datediff("latest", "end") / 365.2425).cast("int")
    votes = (
        a.withColumn("_fe", filing_end)
        .join(latest, "symbol")
        .filter(
            (F.col("end") == F.col("_fe"))
            & (F.coalesce("delay", F.lit(0)) <= 300)
            & F.datediff("latest", "end").between(0, 365 * 8)
            & (F.abs(F.col("fy") - F.year("end")) <= 1)
        )
        .groupBy("symbol", "accn")
        .agg(F.max(F.col("fy") + years_back).alias("vote"))
    )
    tally = votes.groupBy("symbol", "vote").agg(F.count(F.lit(1)).alias("n"))
    winner = tally.groupBy("symbol").agg(F.max_by("vote", F.struct("n", "vote")).alias("vote"))
    labelled = ends.join(latest, "symbol").join(winner, "symbol", "left")
    label = F.coalesce("vote", F.year("latest")) - years_back
    listed = labelled.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("end", "start", label.cast("int").alias("fiscal_year"), "filed"))).alias("_all")
    )
    empty = F.expr("cast(array() as array<struct<end:date,start:date,fiscal_year:int,filed:date>>)")

    def add(kept: Column, x: Column) -> Column:
        twin = F.filter(
            kept, lambda k: (k["fiscal_year"] == x["fiscal_year"]) & (F.abs(F.datediff(k["end"], x["end"])) <= 7)
        )
        newer = F.exists(twin, lambda t: t["filed"] > x["filed"])
        without = F.array_except(kept, F.slice(twin, 1, 1))
        return F.when(newer, kept).otherwise(F.concat(without, F.array(x)))

    return listed.select("symbol", F.aggregate("_all", empty, add).alias("years"))


def quarter_position(end: Column, years: Column) -> Column:
    """Struct fiscal_year, quarter (1..4), fiscal_start, year_end of a period end; NULL outside."""
    inside = F.try_element_at(F.filter(years, lambda y: (y["start"] <= end) & (end <= y["end"])), F.lit(1))
    number = F.greatest(
        F.lit(1),
        F.bround((F.datediff(end, inside["start"]) + 1) / (F.datediff(inside["end"], inside["start"]) + 1) * 4).cast("int"),
    )
    fits = (number <= 4) & ~((number == 4) & (end != inside["end"]))
    last = F.try_element_at(years, F.lit(-1))
    elapsed = F.datediff(end, last["end"])
    after = F.greatest(F.lit(1), F.least(F.lit(3), F.bround(elapsed / 91.31).cast("int")))
    return F.when(
        inside.isNotNull(),
        F.when(
            fits,
            F.struct(
                inside["fiscal_year"].alias("fiscal_year"), number.alias("quarter"), inside["start"].alias("fiscal_start"), inside["end"].alias("year_end")
            ),
        ),
    ).when(
        elapsed.between(45, 310),
        F.struct(
            (last["fiscal_year"] + 1).alias("fiscal_year"), after.alias("quarter"), F.date_add(last["end"], 1).alias("fiscal_start"),
            F.lit(None).cast("date").alias("year_end"),
        ),
    )


def _best_per_period(rows: DataFrame, annual: bool) -> DataFrame:
    """One fact per (symbol, end, metric): direct, preferred concept, latest filed, best duration, accession."""
    duration = F.coalesce("duration", F.lit(0))
    if annual:
        direct, fit = F.lit(1), duration
    else:
        direct = (~is_flow() | (duration <= 135)).cast("int")
        fit = (
            F.when(F.col("metric").isin(*CUMULATIVE), duration).when(is_flow(), -F.abs(duration - 91)).otherwise(0)
        )
    w = Window.partitionBy("symbol", "end", "metric").orderBy(
        direct.desc(), F.col("priority").asc(), F.col("filed").desc(), fit.desc(), F.col("accn").desc()
    )
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def annual_facts(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    years = calendar.select("symbol", F.inline("years")).select(
        "symbol", "end", F.col("start").alias("period_start"), "fiscal_year"
    )
    rows = facts.filter(valid_annual()).join(years, ["symbol", "end"])
    rows = rows.filter(~is_flow() | (F.col("start") == F.col("period_start")))
    return _best_per_period(rows, annual=True)


def quarter_facts(facts: DataFrame, calendar: DataFrame, annual: DataFrame) -> DataFrame:
    """Best quarterly facts with year-to-date flows turned into single quarters."""
    rows = facts.filter(valid_quarter()).join(calendar, "symbol").withColumn("_q", quarter_position(F.col("end"), F.col("years")))
    rows = rows.filter("_q is not null").drop("years")
    rows = rows.withColumns({"fiscal_year": F.col("_q.fiscal_year"), "q": F.col("_q.quarter"), "fiscal_start": F.col("_q.fiscal_start"), "year_end": F.col("_q.year_end")}).drop("_q")
    anchors = (
        rows.filter(is_flow() & F.col("duration").between(45, 135))
        .groupBy("symbol", "fiscal_year", "q", "end").agg(F.count_distinct("metric").alias("n"))
        .groupBy("symbol", "fiscal_year", "q").agg(F.max_by("end", F.struct("n", "end")).alias("end"))
    )
    rows = rows.join(anchors, ["symbol", "fiscal_year", "q", "end"])
    # Quarters must use the concept the annual figure used.
    used = annual.filter(F.col("metric").isin("total_revenue", "net_income")).select(
        "symbol", F.col("end").alias("year_end"), "metric", F.col("concept_name").alias("_concept")
    )
    rows = rows.join(used, ["symbol", "year_end", "metric"], "left").filter(
        F.col("_concept").isNull() | (F.col("concept_name") == F.col("_concept"))
    )
    long_flow = is_flow() & (F.col("duration") > 135)
    rows = rows.filter(~long_flow | ((F.col("metric") != "basic_eps") & (F.col("start") == F.col("fiscal_start"))))
    best = _best_per_period(rows, annual=False)
    w = Window.partitionBy("symbol", "fiscal_year", "metric").orderBy("q")
    previous = (F.lag("q", 1).over(w) == F.col("q") - 1) & (F.lag("start", 1).over(w) == F.col("start"))
    cumulative = is_flow() & (F.col("metric") != "basic_eps") & (F.col("duration") > 135)
    value = F.when(cumulative, F.when(previous, F.col("val") - F.lag("val", 1).over(w))).otherwise(F.col("val"))
    kind = F.when(cumulative, "derived_ytd_difference").otherwise("reported")
    # A nine-month flow without the six-month one is no quarter; a year-to-date Q1 cannot exist.
    return best.withColumns({"value": value, "kind": kind}).filter(F.col("value").isNotNull())


def derive_metrics(wide: DataFrame) -> DataFrame:
    """Fill liabilities, debt and gross profit; capex negative; free cash flow."""
    parts = [F.coalesce(c, F.lit(0.0)) for c in INTERNAL]
    any_part = F.coalesce(*INTERNAL).isNotNull()
    out = wide.withColumns(
        {
            "total_liabilities": F.coalesce("total_liabilities", F.col("total_assets") - F.col("stockholders_equity")),
            "total_debt": F.coalesce("total_debt", F.when(any_part, parts[0] + parts[1] + parts[2])),
            "gross_profit": F.coalesce("gross_profit", F.col("total_revenue") - F.col("cost_of_revenue")),
            "capital_expenditure": -F.abs("capital_expenditure"),
        }
    )
    return out.withColumn("free_cash_flow", F.col("operating_cash_flow") + F.col("capital_expenditure")).drop(*INTERNAL)


def _wide(facts: DataFrame, keys: list[str], value: str, kind: Column, minimum: int) -> DataFrame:
    names = list(US_GAAP)
    source = F.struct(
        kind.alias("kind"), F.col("concept_name").alias("concept"), F.col("start").alias("period_start"), F.col("filed").alias("filed_at"),
        F.col("form").alias("source_form"), F.col("accn").alias("accession"),
    )
    grouped = facts.groupBy("symbol", *keys).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(value))).alias(m) for m in names],
        F.map_from_entries(F.collect_list(F.struct("metric", source.alias("source")))).alias("metric_sources"),
        F.max("filed").alias("filed_at"),
        F.max_by("form", F.struct("filed", "accn")).alias("source_form"),
        F.max_by("accn", F.struct("filed", "accn")).alias("accession"),
    )
    out = derive_metrics(grouped)
    counted = [m for m in names if m not in INTERNAL] + ["free_cash_flow"]
    known = sum((F.col(m).isNotNull().cast("int") for m in counted), F.lit(0))
    return out.filter(known >= minimum)


def normalize(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annual, quarterly, currency) from raw facts.

    Facts are read once and dealt by symbol; what several later steps read is
    written in between, so no step repeats the ones before it.
    """
    mapped = cut_lineage(mapped_facts(facts).repartition("symbol"))
    currency = cut_lineage(reporting_currency(mapped))
    rows = cut_lineage(in_currency(mapped, currency))
    calendar = cut_lineage(fiscal_calendar(rows))
    annual = cut_lineage(annual_facts(rows, calendar))
    quarters = quarter_facts(rows, calendar, annual)
    annual_wide = _wide(annual, ["fiscal_year", "end", "period_start"], "val", F.lit("reported"), 3)
    quarter_wide = _wide(quarters.withColumn("quarter", F.concat(F.lit("Q"), F.col("q").cast("string"))), ["fiscal_year", "quarter", "end"], "value", F.col("kind"), 2)
    rename = lambda df: df.withColumnRenamed("end", "period_end").join(currency, "symbol")
    return rename(annual_wide), rename(quarter_wide), currency


def excluded_periods(facts: DataFrame, annual: DataFrame) -> DataFrame:
    """Transition or short annual periods newer than the last accepted year."""
    mapped = mapped_facts(facts)
    rows = in_currency(mapped, reporting_currency(mapped)).filter(F.col("metric").isin("total_revenue", "net_income", "operating_cash_flow"))
    last = annual.groupBy("symbol").agg(F.max("period_end").alias("_last"))
    return (
        rows.join(last, "symbol")
        .filter(
            F.col("form").isin(*ANNUAL_FORMS, *TRANSITION_FORMS) & (F.col("end") > F.col("_last")) & F.col("duration").isNotNull()
            & (F.col("delay") >= 0) & ~valid_annual()
        )
        .groupBy("symbol", F.col("end").alias("period_end"), F.col("form").alias("source_form"))
        .agg(F.max("duration").alias("duration_days"))
    )


def better_filing_entity(candidates: DataFrame, as_of) -> DataFrame:
    """One entity per symbol: still filing (18 months), then more years, then newer.

    ``candidates``: symbol, entity, years, latest (date).
    """
    live = (F.col("latest") >= F.date_sub(F.lit(as_of).cast("date"), 18 * 30)).cast("int")
    w = Window.partitionBy("symbol").orderBy(live.desc(), F.col("years").desc(), F.col("latest").desc(), "entity")
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
