"""Landed provider JSON to tables.

Every reader takes a DataFrame with the raw text in ``body`` (and usually the
symbol), so parsing is spread over whatever partitions hold the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import finite
from barloom.operators.statements import METRICS

_FACT = "struct<start:string,end:string,val:double,fy:int,fp:string,form:string,filed:string,accn:string>"
COMPANY_FACTS = f"struct<entityName:string,facts:map<string,map<string,struct<units:map<string,array<{_FACT}>>>>>>"

CHART = (
    "struct<chart:struct<result:array<struct<meta:struct<regularMarketPrice:double>,timestamp:array<bigint>,indicators:struct<"
    "quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,"
    "adjclose:array<struct<adjclose:array<double>>>>>>>>"
)
HISTORY = (
    "struct<status:struct<rCode:int>,data:struct<tradesTable:struct<rows:array<struct<date:string,open:string,high:string,low:string,close:string,volume:string>>>>>"
)
SUBMISSIONS = (
    "struct<name:string,sicDescription:string,filings:struct<recent:struct<form:array<string>,accessionNumber:array<string>,"
    "filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>>>"
)

# Provider line names per metric.
PROVIDER_LINES = {
    "total_revenue": "TotalRevenue", "cost_of_revenue": "CostOfRevenue", "gross_profit": "GrossProfit",
    "operating_income": "OperatingIncome", "pretax_income": "PretaxIncome", "tax_provision": "TaxProvision",
    "net_income": "NetIncome", "basic_eps": "BasicEPS", "total_assets": "TotalAssets", "current_assets": "CurrentAssets",
    "total_liabilities": "TotalLiabilitiesNetMinorityInterest", "current_liabilities": "CurrentLiabilities",
    "total_debt": "TotalDebt", "stockholders_equity": "StockholdersEquity",
    "cash_and_equivalents": "CashCashEquivalentsAndShortTermInvestments", "operating_cash_flow": "OperatingCashFlow",
    "capital_expenditure": "CapitalExpenditure", "free_cash_flow": "FreeCashFlow",
}


def company_facts(raw: DataFrame) -> DataFrame:
    """symbol, body -> one row per reported fact."""
    out = raw.select("symbol", F.from_json("body", COMPANY_FACTS).alias("j"))
    out = out.select("symbol", F.explode("j.facts").alias("taxonomy", "concepts"))
    out = out.select("symbol", "taxonomy", F.explode("concepts").alias("concept", "node"))
    out = out.select("symbol", "taxonomy", "concept", F.explode("node.units").alias("unit", "items"))
    out = out.select("symbol", "taxonomy", "concept", "unit", F.inline("items"))
    dates = {c: F.try_to_date(c, "yyyy-MM-dd") for c in ("start", "end", "filed")}
    return out.withColumns(dates)


def provider_timeseries(raw: DataFrame, prefix: str) -> DataFrame:
    """symbol, body -> symbol, period_end, metric, value, currency; the later item of a line wins.

    ``prefix`` is ``annual`` or ``quarterly``; items of another period type are skipped.
    """
    wanted = {f"{prefix}{line}": metric for metric, line in PROVIDER_LINES.items()}
    names = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    period = "12M" if prefix == "annual" else "3M"
    item = "struct<asOfDate:string,periodType:string,currencyCode:string,reportedValue:struct<raw:double>>"
    schema = f"struct<timeseries:struct<result:array<struct<{','.join(f'`{k}`:array<{item}>' for k in wanted)}>>>>"
    out = raw.select("symbol", F.from_json("body", schema).alias("j")).select("symbol", F.posexplode("j.timeseries.result").alias("r", "result"))
    lines = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"result.{k}").alias("items")) for k in wanted])
    out = out.select("symbol", "r", F.inline(lines)).select("symbol", "r", "k", F.posexplode("items").alias("i", "x"))
    value = finite(F.col("x.reportedValue.raw"))
    kind = F.coalesce("x.periodType", F.lit(""))
    out = out.filter(kind.isin("", period) & (F.coalesce("x.asOfDate", F.lit("")) != "") & value.isNotNull())
    order = F.struct("r", "i")
    return out.groupBy("symbol", F.col("x.asOfDate").cast("date").alias("period_end"), F.element_at(names, F.col("k")).alias("metric")).agg(
        F.max_by(value, order).alias("value"), F.min_by("x.currencyCode", order).alias("currency")
    )


def to_periods(long: DataFrame) -> DataFrame:
    keys = ["symbol", "period_end"]
    currency = long.groupBy(*keys).agg(F.max("currency").alias("currency"))
    return long.groupBy(*keys).pivot("metric", list(METRICS)).agg(F.max("value")).join(currency, keys)


def chart_bars(raw: DataFrame) -> DataFrame:
    """symbol, body -> daily bars with adjusted open and close; rows with a missing price drop out."""
    out = raw.select("symbol", F.from_json("body", CHART).alias("j")).select("symbol", F.col("j.chart.result")[0].alias("c"))
    q, adj = F.col("c.indicators.quote")[0], F.col("c.indicators.adjclose")[0]
    rows = F.arrays_zip(
        F.col("c.timestamp").alias("ts"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"),
        q["close"].alias("close"), q["volume"].alias("volume"), F.coalesce(adj["adjclose"], F.array().cast("array<double>")).alias("adj"),
    )
    out = out.select("symbol", F.inline(rows)).toDF("symbol", "ts", "open", "high", "low", "close", "volume", "adj")
    out = out.filter("ts is not null and open is not null and high is not null and low is not null and close is not null")
    factor = F.when((F.col("adj") > 0) & (F.col("close") > 0), F.col("adj") / F.col("close"))
    return out.select(
        "symbol",
        F.timestamp_seconds("ts").cast("date").alias("date"),
        *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(F.floor("volume").cast("double"), F.lit(0.0)).alias("volume"),
        F.round(F.when(factor.isNotNull(), F.col("adj")), 6).alias("adjusted_close"),
        F.round(F.col("open") * factor, 6).alias("adjusted_open"),
    )


def market_number(value: Column) -> Column:
    """``$1,234.5`` and ``(12)`` to numbers; N/A and blanks to NULL."""
    text = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"[$,]", "")
    negative = text.rlike(r"^\(.*\)$")
    number = F.regexp_replace(text, r"^\((.*)\)$", "$1").try_cast("double")
    return F.when(F.upper(text).isin("", "N/A", "NA", "--"), F.lit(None)).when(negative, -number).otherwise(number)


def latest_exchange_bar(raw: DataFrame) -> DataFrame:
    """symbol, body -> the newest complete bar of an exchange history page."""
    out = raw.select("symbol", F.from_json("body", HISTORY).alias("j")).filter(F.coalesce("j.status.rCode", F.lit(200)) == 200)
    out = out.select("symbol", F.inline("j.data.tradesTable.rows"))
    day = F.when(F.col("date").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date("date", "M/d/yyyy"))
    out = out.select("symbol", day.alias("date"), *[market_number(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])
    out = out.filter("date is not null and open is not null and high is not null and low is not null and close is not null")
    bar = F.struct(
        "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], F.coalesce(F.floor("volume").cast("double"), F.lit(0.0)).alias("volume")
    )
    newest = out.groupBy("symbol").agg(F.max_by(bar, "date").alias("b")).select("symbol", "b.*")
    return newest.withColumns({"adjusted_open": F.col("open"), "adjusted_close": F.col("close")})


def fx_closes(raw: DataFrame) -> DataFrame:
    """code, body -> code, per_usd: the last close, else the market price; only positive rates."""
    out = raw.select("code", F.from_json("body", CHART).alias("j")).select("code", F.col("j.chart.result")[0].alias("c"))
    closes = F.filter(F.col("c.indicators.quote")[0]["close"], lambda v: v.isNotNull())
    rate = F.coalesce(F.try_element_at(closes, F.lit(-1)), F.col("c.meta.regularMarketPrice"), F.lit(0.0))
    return out.select("code", F.round(rate, 6).alias("per_usd")).filter("per_usd > 0")


def fx_table(raw: DataFrame) -> DataFrame:
    """body {"rates": {code: per_usd}} -> code, per_usd, updated_at."""
    out = raw.select(F.from_json("body", "struct<rates:map<string,double>,updated_at:string>").alias("j"))
    return out.select(F.explode("j.rates").alias("code", "per_usd"), F.try_to_timestamp("j.updated_at").alias("updated_at"))


def latest_annual_filing(raw: DataFrame) -> DataFrame:
    """symbol, cik, body -> the first listed 10-K, 20-F or 40-F that is an HTML document."""
    out = raw.select("symbol", "cik", F.from_json("body", SUBMISSIONS).alias("j"))
    r = F.col("j.filings.recent")
    rows = F.arrays_zip(
        r["form"].alias("form"), r["accessionNumber"].alias("accession"), r["filingDate"].alias("filed"), r["reportDate"].alias("period"), r["primaryDocument"].alias("document")
    )
    names = ["form", "accession", "filed", "period", "document"]
    out = out.select("symbol", "cik", F.col("j.name").alias("entity_name"), F.col("j.sicDescription").alias("industry"), F.posexplode(rows).alias("i", "x"))
    out = out.select("symbol", "cik", "entity_name", "industry", "i", "x.*").toDF("symbol", "cik", "entity_name", "industry", "i", *names)
    page = F.lower("document").endswith(".htm") | F.lower("document").endswith(".html")
    kept = out.filter(F.col("form").isin("10-K", "20-F", "40-F") & page)
    first = kept.groupBy("symbol", "cik", "entity_name", "industry").agg(F.min_by(F.struct(*names), "i").alias("f"))
    url = F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("bigint").cast("string"), F.lit("/"),
        F.regexp_replace("f.accession", "-", ""), F.lit("/"), F.col("f.document"),
    )
    return first.select(
        "symbol", "cik", "entity_name", "industry", F.col("f.form").alias("form"), F.col("f.filed").alias("filed_at"), F.col("f.period").alias("period"), url.alias("url")
    )
