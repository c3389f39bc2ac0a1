"""Source readers over lines and JSON bodies that Spark makes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import filters as FL
from barloom.operators import health as H
from barloom.operators import journal as J
from barloom.operators import profile as PR
from barloom.operators import screener as SC
from barloom.operators import statements as ST
from barloom.operators import universe as U
from barloom.operators import research as RE
from barloom.operators.company_facts import better_filing_entity, filing_url
from barloom.registry import sql as S
from barloom.registry.bars import raw
from barloom.sources import csv_tables as CSV
from barloom.sources import landed_json as LJ
from barloom.sources import trade_ticks as T
from barloom.streaming.sealed_bars import sealed_bars


def _number(column="symbol"):
    return F.substring(column, 2, 20).cast("int")


def _text(*names):
    return [F.col(n).cast("string") for n in names]


def price_csv(spark, d):
    """Daily bars as price lines: four date notations, symbols in the file name, rows cut short."""
    bars = raw(spark, d)
    day = F.dayofmonth("date")
    iso = F.col("date").cast("string")
    date = (
        F.when(day % 4 == 0, iso).when(day % 4 == 1, F.date_format("date", "yyyy/MM/dd"))
        .when(day % 4 == 2, F.unix_timestamp(F.col("date").cast("timestamp")).cast("string")).otherwise(F.concat(iso, F.lit("T00:00:00Z")))
    )
    symbol = F.when(_number() % 3 == 0, "").otherwise(F.col("symbol"))
    cells = F.when(day == 13, F.concat_ws(",", date, symbol, *_text("open", "high", "low"))).otherwise(
        F.concat_ws(",", date, symbol, *_text("open", "high", "low", "close", "volume"))
    )
    lines = bars.select(cells.alias("line"), F.concat(F.lit("/landed/prices_"), "symbol", F.lit(".csv")).alias("file"))
    rows = CSV.price_rows(CSV.split_lines(lines, "﻿Time,Ticker ,OPEN,High,Low,Close,Volume"), F.col("file"))
    return rows.select("symbol", "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


def fundamentals_csv(spark, d):
    key = F.col("s_suppkey")
    cells = F.concat_ws(
        ",", F.concat(F.lit("S"), key.cast("string")), F.col("s_name"), F.when(key % 7 == 0, "").otherwise("TH"),
        F.when(key % 5 == 0, " ").otherwise(F.col("s_acctbal").cast("string")), (key % 40).cast("string"),
    )
    lines = T.table(spark, d, "supplier").select(cells.alias("line"))
    rows = CSV.fundamental_rows(CSV.split_lines(lines, "symbol,name,market,roe,pe"))
    return rows.select("symbol", "name", "market", "sector", "roe", "pe", "pbv", "moat", "ai_trend", "fundamentals_verified")


def universe_csv(spark, d):
    n = _number()
    cells = F.concat_ws(
        ",", F.when(n % 6 == 0, " ").otherwise(F.col("symbol")), F.when(n % 4 == 0, "").otherwise(F.col("name")),
        F.when(n % 5 == 0, "").otherwise(F.col("market")), F.col("index_groups"),
    )
    lines = T.listing(spark, d).select(cells.alias("line"))
    return CSV.universe_rows(CSV.split_lines(lines, "Ticker,Name,Market,Group"))


def symbol_order(spark, d):
    """Distinct symbols in the order of the file that lists them."""
    rows = T.table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.col("l_linestatus").alias("market"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
    )
    return CSV.symbol_list(rows, position="position")


def landed_facts(spark, d):
    """Yearly supplier sales as a regulator's company-facts body, read back."""
    lines = T.table(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.year("l_shipdate").alias("y")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("v")
    )
    year = F.col("y").cast("string")
    fact = F.struct(
        F.concat(year, F.lit("-01-01")).alias("start"), F.concat(year, F.lit("-12-31")).alias("end"), F.col("v").alias("val"), F.col("y").alias("fy"),
        F.lit("FY").alias("fp"), F.lit("10-K").alias("form"), F.concat((F.col("y") + 1).cast("string"), F.lit("-02-20")).alias("filed"), F.concat(F.lit("a-"), year).alias("accn"),
    )
    per = lines.groupBy("symbol").agg(F.sort_array(F.collect_list(fact)).alias("facts"))
    units = F.create_map(F.lit("Revenues"), F.struct(F.create_map(F.lit("USD"), F.col("facts")).alias("units")))
    body = F.to_json(F.struct(F.col("symbol").alias("entityName"), F.create_map(F.lit("us-gaap"), units).alias("facts")))
    out = LJ.company_facts(per.select("symbol", body.alias("body")))
    return out.select("symbol", "taxonomy", "concept", "unit", "start", "end", F.round("val", 2).alias("val"), "fy", "form", "filed", "accn")


def provider_lines(spark, d):
    """Yearly figures as a provider's time series: rows of another period type, and a line that comes twice."""
    lines = T.table(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.year("l_shipdate").alias("y")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("v")
    )

    def item(value):
        kind = F.when(F.col("y") % 4 == 0, "3M").otherwise("12M")
        return F.struct(
            F.concat(F.col("y").cast("string"), F.lit("-12-31")).alias("asOfDate"), kind.alias("periodType"), F.lit("USD").alias("currencyCode"),
            F.struct(value.alias("raw")).alias("reportedValue"),
        )

    per = lines.groupBy("symbol").agg(
        F.sort_array(F.collect_list(item(F.col("v")))).alias("a"), F.sort_array(F.collect_list(item(F.col("v") * 2))).alias("b")
    )
    first = F.to_json(F.struct(F.col("a").alias("annualTotalRevenue"), F.col("a").alias("annualNetIncome")))
    result = F.array(first, F.to_json(F.struct(F.col("b").alias("annualTotalRevenue"))))
    body = F.concat(F.lit('{"timeseries":{"result":['), F.array_join(result, ","), F.lit("]}}"))
    out = LJ.provider_timeseries(per.select("symbol", body.alias("body")), "annual")
    return out.select("symbol", "period_end", "metric", F.round("value", 2).alias("value"), "currency")


def chart_json(spark, d):
    """Daily bars as chart bodies: nulls inside, adjusted closes for every second symbol.

    Prices have four decimals and the adjustment doubles them, so both engines carry the same numbers to the end.
    """
    bars = raw(spark, d).withColumns({c: F.floor(F.col(c) * 10000) / 10000 for c in ("open", "high", "low", "close")})
    bars = bars.withColumn("open", F.when(F.dayofmonth("date") != 13, F.col("open")))
    ts = F.unix_timestamp(F.col("date").cast("timestamp"))
    row = F.struct(ts.alias("ts"), "open", "high", "low", "close", "volume", (F.col("close") * 2).alias("adj"))
    per = bars.groupBy("symbol").agg(F.sort_array(F.collect_list(row)).alias("r"))
    quote = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    adjusted = F.when(_number() % 2 == 0, F.array(F.struct(F.col("r.adj").alias("adjclose"))))
    indicators = F.struct(F.array(quote).alias("quote"), adjusted.alias("adjclose"))
    result = F.struct(F.col("r.ts").alias("timestamp"), indicators.alias("indicators"))
    options = {"ignoreNullFields": "false"}
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), options)
    out = LJ.chart_bars(per.select("symbol", body.alias("body")))
    return out.select("symbol", "date", "open", "high", "low", "close", "volume", "adjusted_close", "adjusted_open")


def exchange_history(spark, d):
    """Newest bar of a history page with money signs, separators, negatives and blanks."""
    bars = raw(spark, d)

    def money(c):
        return F.concat(F.lit("$"), F.format_number(F.round(c, 2), 2))

    volume = F.when(_number() % 4 == 0, "N/A").otherwise(F.format_number(F.col("volume"), 0))
    close = F.when(F.dayofmonth("date") == 29, "--").otherwise(money("close"))
    row = F.struct(
        F.date_format("date", "M/d/yyyy").alias("date"), money("open").alias("open"), money("high").alias("high"),
        F.concat(F.lit("("), money("low"), F.lit(")")).alias("low"), close.alias("close"), volume.alias("volume"),
    )
    per = bars.groupBy("symbol").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    code = F.when(_number() % 9 == 0, 400).otherwise(200)
    body = F.to_json(F.struct(F.struct(code.alias("rCode")).alias("status"), F.struct(F.struct("rows").alias("tradesTable")).alias("data")))
    out = LJ.latest_exchange_bar(per.select("symbol", body.alias("body")))
    return out.select("symbol", "date", "open", "high", "low", "close", "volume")


def _rates(spark, d):
    return T.table(spark, d, "nation").select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("code"), (F.col("n_nationkey") - 3.0).alias("rate"))


def fx_table(spark, d):
    """A stored rate table as one body."""
    entries = F.map_from_entries(F.collect_list(F.struct("code", "rate")))
    body = F.to_json(F.struct(entries.alias("rates"), F.lit("2001-10-20 00:00:00").alias("updated_at")))
    return LJ.fx_table(_rates(spark, d).agg(body.alias("body"))).select("code", "per_usd", F.col("updated_at").cast("date").alias("updated"))


def fx_closes(spark, d):
    """Last close of a currency chart, the market price where there is none; only positive rates."""
    n = F.substring("code", 2, 9).cast("int")
    closes = F.when(n % 3 == 0, F.array(F.lit(None).cast("double"))).otherwise(F.array(F.lit(1.5), F.col("rate"), F.lit(None).cast("double")))
    result = F.struct(
        F.struct((F.col("rate") + 0.25).alias("regularMarketPrice")).alias("meta"), F.array(F.lit(1).cast("long")).alias("timestamp"),
        F.struct(F.array(F.struct(closes.alias("close"))).alias("quote")).alias("indicators"),
    )
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    return LJ.fx_closes(_rates(spark, d).select("code", body.alias("body")))


def merged_rates(spark, d):
    rates = _rates(spark, d).select("code", F.col("rate").alias("per_usd"))
    n = F.substring("code", 2, 9).cast("int")
    return H.merge_rates(rates.filter(n % 2 == 0), rates.filter(n % 3 == 0).withColumn("per_usd", F.col("per_usd") * 10))


def fx_freshness(spark, d):
    rates = _rates(spark, d)
    stamp = F.to_timestamp(F.concat(F.lit("2001-10-"), F.lpad((F.substring("code", 2, 9).cast("int") + 1).cast("string"), 2, "0"), F.lit(" 12:00:00")))
    return H.fx_health(rates, stamp, "2001-11-02")


def chosen_filings(spark, d):
    """The first annual report that is a page, of each company's submissions."""
    n = _number()
    forms = F.array(F.lit("8-K"), F.when(n % 3 == 0, "10-K").otherwise("10-Q"), F.when(n % 2 == 0, "20-F").otherwise("10-K"), F.lit("10-K"))
    pages = F.array(F.lit("a.htm"), F.lit("b.pdf"), F.when(n % 5 == 0, "c.txt").otherwise("c.HTM"), F.lit("d.html"))
    recent = F.struct(
        forms.alias("form"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("0-0-"), i.cast("string"))).alias("accessionNumber"),
        F.array_repeat(F.lit("2001-02-20"), 4).alias("filingDate"), F.array_repeat(F.lit("2000-12-31"), 4).alias("reportDate"), pages.alias("primaryDocument"),
    )
    body = F.to_json(F.struct(F.col("name").alias("name"), F.col("sector").alias("sicDescription"), F.struct(recent.alias("recent")).alias("filings")))
    rows = T.listing(spark, d).select("symbol", F.concat(F.lit("000"), n.cast("string")).alias("cik"), body.alias("body"))
    return LJ.latest_annual_filing(rows)


def annual_filing_choice(spark, d):
    """A regulator's submissions: the first annual report that is a page."""
    out = chosen_filings(spark, d)
    return out.select("symbol", "industry", "form", "url", filing_url(F.col("cik"), F.lit("0-0-9")).alias("index_url"))


def _holdings(spark, d):
    return T.table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")


def holdings_members(spark, d):
    """Parts as rows of a Hong Kong holdings table: other asset classes, other currencies, blank sectors."""
    k = F.col("p_partkey")
    rows = _holdings(spark, d).select(
        k.cast("string").alias("Ticker"), F.concat(F.lit(" "), "p_name").alias("Name"), F.when(k % 5 == 0, "").otherwise(F.col("p_type")).alias("Sector"),
        F.when(k % 4 == 0, "Cash").otherwise("Equity").alias("Asset Class"), F.when(k % 7 == 0, "USD").otherwise("HKD").alias("Market Currency"),
    )
    return U.equity_members(rows, "HK")


def holdings_sheet(spark, d):
    """Parts as a fund's sheet: cash lines, short identifiers, missing shares."""
    k = F.col("p_partkey")
    letters = F.translate(k.cast("string"), "0123456789", "ABCDEFGHIJ")
    rows = _holdings(spark, d).select(
        F.when(k % 11 == 0, "CASH COLLATERAL").otherwise(F.col("p_name")).alias("Name"), letters.alias("Ticker"),
        F.when(k % 6 == 0, "12").otherwise(F.lpad(k.cast("string"), 9, "0")).alias("Identifier"), F.when(k % 9 == 0, "").otherwise("5").alias("Shares Held"),
        F.when(k % 8 == 0, "EUR").otherwise("USD").alias("Local Currency"), F.when(k % 5 == 0, "-").otherwise(F.col("p_type")).alias("Sector"),
    )
    return U.sheet_members(rows)


def index_constituents(spark, d):
    k = F.col("p_partkey")
    exchange = F.when(k % 3 == 0, "Shanghai Stock Exchange").when(k % 3 == 1, "Shenzhen Stock Exchange").otherwise("Other")
    rows = _holdings(spark, d).select(
        F.lit("20011031.0").alias("date"), F.when(k % 10 == 0, "905").otherwise("300.0").alias("index_code"), F.concat(k.cast("string"), F.lit(".0")).alias("code"),
        F.col("p_name").alias("name"), exchange.alias("exchange"),
    )
    return U.index_members(rows)


def sealed_daily_bars(spark, d):
    """Events as ticks; over a table the stream's plan gives the same bars."""
    ticks = T.table(spark, d, "events").filter("event_type is not null and value is not null").select(
        F.concat(F.lit("U"), (F.col("user_id") % 50).cast("string")).alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size")
    )
    return sealed_bars(ticks, "D").select("symbol", "period", "date", "open", "high", "low", "close", "volume")


def symbol_format(spark, d):
    word = F.upper(F.col("p_name"))
    rows = T.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.replace(word, F.lit(" "), F.lit("."))).otherwise(word).alias("text"))
    return rows.select("p_partkey", FL.is_symbol(F.col("text")).alias("valid"))


def sector_trends(spark, d):
    """Trend labels of sectors that name one of them, in the declared order of needles."""
    needles = F.array(*[F.lit(k) for k in PR.SECTOR_TRENDS])
    key = F.col("p_partkey")
    sector = F.when(key % 3 == 0, F.col("p_type")).otherwise(F.concat(F.lit(" Global "), F.initcap(F.get(needles, (key % len(PR.SECTOR_TRENDS)).cast("int")))))
    return T.table(spark, d, "part").select("p_partkey", PR.sector_trend(sector).alias("trend"))


def calendar_quarters(spark, d):
    day = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("date"))
    return T.table(spark, d, "orders").select("o_orderkey", ST.quarter_name(day).alias("quarter"))


def default_reviews(spark, d):
    reviews = T.listing(spark, d).filter(_number() % 3 == 0).select("symbol", F.when(_number() % 2 == 0, "Owned").alias("status"), F.col("account_balance").alias("fair_value"), F.lit("t").alias("thesis"))
    return J.with_default_reviews(T.listing(spark, d), reviews)


def newest_trades(spark, d):
    """The trade list, newest first, with its place."""
    trades = T.table(spark, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("symbol"), F.col("o_orderdate").cast("date").alias("opened_on"))
    return J.newest_first(trades)


def industry_choices(spark, d):
    names = F.array(*[F.lit(n) for n in ("Semiconductors & Related Devices", "Retail-Eating Places", "Pharmaceutical Preparations", "Services-Prepackaged Software", "Other")])
    rows = T.listing(spark, d).select("symbol", SC.classify_industry(F.get(names, _number() % 5)).alias("industry_group"))
    trend = next(t for t, groups in SC.TRENDS.items() if "semiconductor" in groups)
    return SC.industry_choices(rows, trend)


def _catalog(spark, d):
    """A review catalog, one body per symbol, with a rule broken for some."""
    n = _number()
    cited = F.array(F.lit("s1"))
    segment = lambda name, amount: F.struct(F.lit(name).alias("name"), F.lit(amount).alias("amount"))
    breakdown = F.struct(
        F.lit("b").alias("basis"), F.lit("USD").alias("currency"), F.lit("m").alias("unit"), F.when(n % 5 == 0, 120.0).otherwise(100.0).alias("total"),
        F.array(segment("x", 60.0), segment("y", 40.0)).alias("segments"), cited.alias("source_ids"),
    )
    url = F.when(n % 11 == 0, "ftp://x").otherwise("https://example.com/a")
    profile = F.struct(
        F.col("name"), F.lit("FY").alias("period"), F.when(n % 7 == 0, " ").otherwise(F.concat(F.lit("about "), "symbol")).alias("summary"), F.lit("r").alias("revenue_model"),
        F.lit("k").alias("key_customers"), F.lit("m").alias("moat_summary"), F.lit("2001-01-01").alias("reviewed_at"),
        F.array(F.concat(F.lit("ALT"), n.cast("string"))).alias("aliases"),
        F.array(F.struct(F.lit("s1").alias("id"), url.alias("url"), F.lit("t").alias("title"))).alias("sources"), cited.alias("source_ids"), breakdown.alias("revenue_breakdown"),
        F.array(F.struct(F.lit("p").alias("name"), F.lit("o").alias("overlap"), F.lit("c").alias("compare"), cited.alias("source_ids"))).alias("peers"),
        F.array(F.struct(F.when(n % 13 == 0, "rumour").otherwise("reported").alias("kind"), F.lit("t").alias("title"), F.lit("d").alias("detail"), cited.alias("source_ids"))).alias("evidence"),
    )
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.create_map("symbol", profile).alias("profiles")))
    return RE.validate(RE.parse_catalog(T.listing(spark, d).select(body.alias("body"))))


def catalog_rules(spark, d):
    return _catalog(spark, d).select("symbol", "error")


def segment_shares(spark, d):
    out = RE.with_segment_shares(_catalog(spark, d).filter("error is null"), "2001-11-02")
    return out.select("symbol", "review_age_days", "needs_review", F.inline("segments"))


def business_view(spark, d):
    """A field from the journal, else the catalog (found under its own name or an alias), else the filing."""
    n = _number()
    valid = _catalog(spark, d).filter("error is null")
    asked = T.listing(spark, d).select(F.when(n % 2 == 0, F.concat(F.lit("ALT"), n.cast("string"))).otherwise(F.col("symbol")).alias("symbol"))
    journal = T.listing(spark, d).filter(n % 9 == 0).select("symbol", F.lit("mine").alias("note"))
    filings = T.listing(spark, d).select("symbol", F.lit("filed").alias("business_summary"))
    return RE.business_fields(
        asked, journal, valid.select("symbol", F.col("p.summary").alias("summary")), filings, {"summary": ("note", "summary", "business_summary")}, RE.aliases(valid)
    )


def filing_entities(spark, d):
    """Customers as the entities of a symbol: still filing, then more years, then newer."""
    rows = T.table(spark, d, "orders").groupBy(F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("symbol"), F.col("o_custkey").alias("entity")).agg(
        F.count_distinct(F.year("o_orderdate")).alias("years"), F.max("o_orderdate").cast("date").alias("latest")
    )
    return better_filing_entity(rows, "2001-06-30")


QUERIES = {
    f.__name__: f
    for f in (
        price_csv, fundamentals_csv, universe_csv, symbol_order, landed_facts, provider_lines, chart_json, exchange_history, fx_table, fx_closes,
        merged_rates, fx_freshness, annual_filing_choice, holdings_members, holdings_sheet, index_constituents, sealed_daily_bars, symbol_format,
        sector_trends, calendar_quarters, default_reviews, newest_trades, industry_choices, catalog_rules,
        segment_shares, business_view, filing_entities,
    )
}

_YEARS = "y AS (SELECT 'S' || l_suppkey AS symbol, year(l_shipdate) AS y, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1, 2)"
_N = "CAST(substring(symbol, 2) AS INTEGER)"
_HK = "CASE WHEN p_partkey > 0 AND p_partkey < 100000 THEN lpad(CAST(p_partkey AS VARCHAR), greatest(4, len(CAST(p_partkey AS VARCHAR)))::INT, '0') || '.HK' END"
_LETTERS = "translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"
_SHEET = f"CASE WHEN regexp_matches({_LETTERS}, '^[A-Z][A-Z0-9]{{0,5}}$') THEN {_LETTERS} END"
_NEEDLES = list(PR.SECTOR_TRENDS)
_TREND_LIST = ", ".join(f"'{k}'" for k in _NEEDLES)
_TREND_CASE = " ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in PR.SECTOR_TRENDS.items())
_TREND_GROUPS = next(groups for groups in SC.TRENDS.values() if "semiconductor" in groups)
_CHOICES = ", ".join(f"'{g}'" for g in _TREND_GROUPS)

SQL = {
    "price_csv": S.with_(S.RAW) + "SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CAST(volume AS DOUBLE) AS volume FROM raw_bars WHERE day(date) <> 13",
    "fundamentals_csv": """SELECT 'S' || s_suppkey AS symbol, s_name AS name, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'TH' END AS market, '' AS sector,
  CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_acctbal END AS roe, CAST(s_suppkey % 40 AS DOUBLE) AS pe, CAST(0 AS DOUBLE) AS pbv, 'medium' AS moat, 'neutral' AS ai_trend, true AS fundamentals_verified FROM supplier""",
    "universe_csv": S.with_(S.LISTING) + f"""SELECT symbol, CASE WHEN {_N} % 4 = 0 THEN symbol ELSE name END AS name, CASE WHEN {_N} % 5 = 0 THEN 'US' ELSE market END AS market, 'Unknown' AS sector, index_groups
FROM listing WHERE {_N} % 6 <> 0""",
    "symbol_order": "SELECT 'S' || l_suppkey AS symbol, arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) AS market, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem GROUP BY 1",
    "landed_facts": S.with_(_YEARS) + """SELECT symbol, 'us-gaap' AS taxonomy, 'Revenues' AS concept, 'USD' AS unit, make_date(y, 1, 1) AS start, make_date(y, 12, 31) AS "end", v AS val, CAST(y AS INTEGER) AS fy, '10-K' AS form,
  make_date(y + 1, 2, 20) AS filed, 'a-' || y AS accn FROM y""",
    "provider_lines": S.with_(_YEARS) + """SELECT symbol, make_date(y, 12, 31) AS period_end, m.metric, round(v * m.f, 2) AS value, 'USD' AS currency
FROM y, (VALUES ('total_revenue', 2), ('net_income', 1)) AS m(metric, f) WHERE y % 4 <> 0""",
    "chart_json": S.with_(S.RAW, """
cut AS (SELECT symbol, date, floor(open * 10000) / 10000 AS open, floor(high * 10000) / 10000 AS high, floor(low * 10000) / 10000 AS low, floor(close * 10000) / 10000 AS close, volume FROM raw_bars)""")
    + f"""SELECT symbol, date, open, high, low, close, floor(volume) AS volume, CASE WHEN {_N} % 2 = 0 THEN close * 2 END AS adjusted_close, CASE WHEN {_N} % 2 = 0 THEN open * 2 END AS adjusted_open
FROM cut WHERE day(date) <> 13""",
    "exchange_history": S.with_(S.RAW) + f"""SELECT symbol, date, round(open, 2) AS open, round(high, 2) AS high, -round(low, 2) AS low, round(close, 2) AS close, CASE WHEN {_N} % 4 = 0 THEN 0 ELSE floor(volume) END AS volume
FROM raw_bars WHERE day(date) <> 29 AND {_N} % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""",
    "fx_table": "SELECT 'C' || n_nationkey AS code, n_nationkey - 3.0::DOUBLE AS per_usd, DATE '2001-10-20' AS updated FROM nation",
    "fx_closes": "SELECT 'C' || n_nationkey AS code, round(n_nationkey - 3.0::DOUBLE + CASE WHEN n_nationkey % 3 = 0 THEN 0.25 ELSE 0 END, 6) AS per_usd FROM nation WHERE n_nationkey - 3.0 + CASE WHEN n_nationkey % 3 = 0 THEN 0.25 ELSE 0 END > 0",
    "merged_rates": "SELECT 'C' || n_nationkey AS code, (n_nationkey - 3.0::DOUBLE) * CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 10 END AS per_usd FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0",
    "fx_freshness": "SELECT count(*) AS rates, max(date_diff('second', TIMESTAMP '2001-10-01 12:00:00' + INTERVAL (n_nationkey) DAY, TIMESTAMP '2001-11-02 00:00:00')) / 86400.0::DOUBLE AS age_days, 'stale' AS state FROM nation",
    "annual_filing_choice": S.with_(S.LISTING) + f"""SELECT symbol, sector AS industry, CASE WHEN {_N} % 5 <> 0 AND {_N} % 2 = 0 THEN '20-F' ELSE '10-K' END AS form,
  'https://www.sec.gov/Archives/edgar/data/' || {_N} || CASE WHEN {_N} % 5 <> 0 THEN '/003/c.HTM' ELSE '/004/d.html' END AS url, 'https://www.sec.gov/Archives/edgar/data/' || {_N} || '/009/0-0-9-index.html' AS index_url FROM listing""",
    "holdings_members": f"""SELECT {_HK} AS symbol, trim(p_name) AS name, CASE WHEN p_partkey % 5 = 0 THEN 'Unknown' ELSE p_type END AS sector, 'HK' AS market,
  CASE WHEN p_partkey % 7 = 0 THEN 'wrong_currency' WHEN {_HK} IS NULL THEN 'invalid_symbol' END AS error FROM part WHERE p_partkey % 4 <> 0""",
    "holdings_sheet": f"""SELECT {_SHEET} AS symbol, trim(p_name) AS name, 'US' AS market, CASE WHEN p_partkey % 5 = 0 THEN 'Unknown' ELSE p_type END AS sector,
  CASE WHEN p_partkey % 6 = 0 THEN 'invalid_identifier' WHEN p_partkey % 8 = 0 THEN 'wrong_currency' WHEN {_SHEET} IS NULL THEN 'invalid_symbol' END AS error FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0""",
    "index_constituents": """SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') || CASE p_partkey % 3 WHEN 0 THEN '.SS' WHEN 1 THEN '.SZ' END AS symbol, trim(p_name) AS name, 'Unknown' AS sector, 'CN' AS market, DATE '2001-10-31' AS as_of,
  CASE WHEN p_partkey % 10 = 0 THEN 'wrong_index' WHEN p_partkey % 3 = 2 THEN 'unknown_exchange_or_code' END AS error FROM part""",
    "sealed_daily_bars": """SELECT 'U' || (user_id % 50) AS symbol, CAST(ts AS DATE) AS period, CAST(ts AS DATE) AS date, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2, 3""",
    "symbol_format": "SELECT p_partkey, regexp_matches(CASE WHEN p_partkey % 2 = 0 THEN replace(upper(p_name), ' ', '.') ELSE upper(p_name) END, '^[A-Z0-9.\\-]{1,12}$') AS valid FROM part",
    "sector_trends": f"""WITH s AS (SELECT p_partkey, lower(trim(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'global ' || ([{_TREND_LIST}])[p_partkey % {len(_NEEDLES)} + 1] END)) AS t FROM part)
SELECT p_partkey, CASE {_TREND_CASE} END AS trend FROM s""",
    "calendar_quarters": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN 'Q' || quarter(o_orderdate) ELSE 'Q?' END AS quarter FROM orders",
    "default_reviews": S.with_(S.LISTING) + f"""SELECT symbol, CASE WHEN {_N} % 6 = 0 THEN 'Owned' ELSE 'Watch' END AS status, CASE WHEN {_N} % 3 = 0 THEN account_balance ELSE 0 END AS fair_value,
  CASE WHEN {_N} % 3 = 0 THEN 't' ELSE '' END AS thesis FROM listing""",
    "newest_trades": "SELECT 'O' || o_orderkey AS symbol, CAST(o_orderdate AS DATE) AS opened_on FROM orders ORDER BY opened_on DESC, symbol",
    "industry_choices": S.with_(S.LISTING) + f"""SELECT g AS industry_group, count(*) AS companies FROM (SELECT ['semiconductor', 'consumer', 'healthcare', 'software', 'other'][{_N} % 5 + 1] AS g FROM listing) WHERE g IN ({_CHOICES}) GROUP BY 1""",
    "catalog_rules": S.with_(S.LISTING, f"""
c AS (SELECT *, CASE WHEN {_N} % 7 = 0 THEN 'missing_text' WHEN {_N} % 11 = 0 THEN 'invalid_source' WHEN {_N} % 5 = 0 THEN 'segments_do_not_reconcile' WHEN {_N} % 13 = 0 THEN 'invalid_evidence_kind' END AS error FROM listing)""")
    + "SELECT symbol, error FROM c",
    "segment_shares": S.with_(S.LISTING, f"""
c AS (SELECT * FROM listing WHERE {_N} % 7 <> 0 AND {_N} % 11 <> 0 AND {_N} % 5 <> 0 AND {_N} % 13 <> 0)""")
    + "SELECT symbol, 305 AS review_age_days, true AS needs_review, s.name, s.amount, s.amount AS share_pct FROM c, (VALUES ('x', 60.0::DOUBLE), ('y', 40.0::DOUBLE)) AS s(name, amount)",
    "business_view": S.with_(S.LISTING, f"""
c AS (SELECT *, {_N} AS n, {_N} % 7 <> 0 AND {_N} % 11 <> 0 AND {_N} % 5 <> 0 AND {_N} % 13 <> 0 AS ok FROM listing)""")
    + """SELECT CASE WHEN n % 2 = 0 THEN 'ALT' || n ELSE symbol END AS symbol,
  CASE WHEN n % 2 = 1 AND n % 9 = 0 THEN 'mine' WHEN ok THEN 'about ' || symbol WHEN n % 2 = 1 THEN 'filed' ELSE '' END AS summary,
  CASE WHEN n % 2 = 1 AND n % 9 = 0 THEN 'journal' WHEN ok THEN 'reference' WHEN n % 2 = 1 THEN 'filing' ELSE 'missing' END AS summary_origin FROM c""",
    "filing_entities": """WITH e AS (SELECT 'C' || (o_custkey % 50) AS symbol, o_custkey AS entity, count(DISTINCT year(o_orderdate)) AS years, CAST(max(o_orderdate) AS DATE) AS latest FROM orders GROUP BY 1, 2)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY latest >= DATE '2001-06-30' - 540 DESC, years DESC, latest DESC, entity) = 1""",
}
