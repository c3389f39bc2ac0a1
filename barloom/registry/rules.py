"""Inputs that make a rule decide: thresholds, split votes, thin periods, breaks, second reports, varied reviews, topic windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import company_facts as CF
from barloom.operators import filings as FI
from barloom.operators import patterns as P
from barloom.operators import research as RE
from barloom.operators import scoring as X
from barloom.operators import statements as ST
from barloom.operators import universe as U
from barloom.plans import leaders as L
from barloom.plans import scan as SC
from barloom.registry import profiles as RPR
from barloom.registry import scan as RS
from barloom.registry import sources as RSO
from barloom.registry import sql as S
from barloom.registry import texts as RT
from barloom.sources import landed_json as LJ
from barloom.sources import trade_ticks as T
from barloom.sources.sinks import publish_version, read_current

AS_OF = S.AS_OF


def _number(column="symbol"):
    return F.substring(column, 2, 20).cast("int")


# --- a scan with thresholds --------------------------------------------------------------

#: Least final and liquidity score of the scan.
LEAST_SCORE, LEAST_LIQUIDITY = 50.0, 10.0


def _afloat(timeframe):
    """Not more than a fifth below the 60-bar high: most symbols, on most days."""
    close, roof = F.col("close"), F.col("roof")
    score = F.least(F.lit(85.0), F.lit(55.0) + (F.try_divide(close, roof) - 0.8) * 100)
    return F.when((F.col("rn") >= 60) & (close > roof * 0.8), P.hit("afloat", "BUY", score, F.lit(50.0), roof))


def _wide_scan(spark, d, **limits):
    own = P.OwnDetector("afloat", _afloat, {"roof": ("max", "high", -60, -1)})
    return RS._scan(spark, d, detail=True, patterns=(*P.STUDY_PATTERNS, own), **limits)


def _published_wide(spark, d):
    folder = RS._once(spark, d, "wide-scan", lambda folder: publish_version(_wide_scan(spark, d), folder, AS_OF))
    return read_current(spark, folder)


def wide_overview(spark, d):
    """The overview over all results of the wide scan."""
    return SC.scan_overview(_published_wide(spark, d)).withColumn("best_score", F.round("best_score", 5))


def wide_verification_counts(spark, d):
    return SC.verification_counts(_published_wide(spark, d))


def scan_decisions(spark, d):
    """The decision summary of every result, field by field."""
    s = lambda name: F.col(f"decision_summary.{name}")
    names = ("technical.pass", "technical.label", "financials.verified", "financials.data_verified", "financials.detail", "valuation.verified", "valuation.label",
             "valuation.detail", "risk.label", "risk.wide", "risk.detail", "evidence.tradeable", "evidence.label", "evidence.pattern")
    return _published_wide(spark, d).select("symbol", *[s(n).alias(n.replace(".", "_")) for n in names])


def scan_thresholds(spark, d):
    out = _wide_scan(spark, d, min_score=LEAST_SCORE, min_liquidity=LEAST_LIQUIDITY)
    return out.select(
        "symbol", "market", F.round("final_score", 5).alias("final_score"), "liquidity_score", "grade", "decision",
        F.concat_ws("|", F.transform("patterns", lambda h: h["name"])).alias("patterns"),
    )


def scan_texts(spark, d):
    """Every text of a scan in full: warnings, and the insights' labels, summaries and bullets."""
    out = _published_wide(spark, d)
    told = lambda k: F.concat_ws(" / ", F.col("insights")[k]["label"], F.col("insights")[k]["summary"], F.array_join(F.col("insights")[k]["bullets"], "; "))
    names = ("technical", "financial", "business", "valuation", "report")
    return out.select("symbol", F.array_join("warnings", "; ").alias("warnings"), *[told(k).alias(n) for k, n in enumerate(names)])


# --- filing facts -------------------------------------------------------------------------


def facts_voted(spark, d):
    """Fiscal-year labels that filings disagree on, and periods with too few values.

    Filers 4k label 1995 and later one year on (the most of seven years), 4k+1 only
    from 1997 (a minority), 4k+2 from 1995 but have no year after 1997 (a tie, the
    later year wins). Annual values but revenue are missing where the year leaves 3
    by 5, quarterly ones in second quarters of every third filer.
    """
    facts, n = RT.clean_facts(spark, d), _number()
    shift = F.when((n % 4 == 0) & (F.col("fy") >= 1995), 1).when((n % 4 == 1) & (F.col("fy") >= 1997), 1).when((n % 4 == 2) & (F.col("fy") >= 1995), 1).otherwise(0)
    thin = ((F.col("form") == "10-K") & (F.col("fy") % 5 == 3)) | ((F.col("form") == "10-Q") & (n % 3 == 0) & (F.month("end") == 6))
    kept = facts.where(~((n % 4 == 2) & (F.col("fy") > 1997))).where(~thin | F.col("concept").isin("Revenues", "Revenue"))
    annual, quarters, _ = CF.normalize(kept.withColumn("fy", F.col("fy") + shift))
    columns = ("symbol", "fiscal_year", "period_end", F.round("total_revenue", 4).alias("total_revenue"))
    return annual.select(*columns, F.lit("FY").alias("quarter")).unionByName(quarters.select(*columns, "quarter"))


def facts_provenance(spark, d):
    """Where each accepted revenue and asset value comes from: concept, dates, form and filing."""
    annual, _, _ = CF.normalize(RT.raw_facts(spark, d))
    rows = annual.select("symbol", "fiscal_year", F.explode("metric_sources").alias("metric", "s")).where("metric IN ('total_revenue', 'total_assets')")
    return rows.select("symbol", "fiscal_year", "metric", "s.kind", "s.concept", "s.period_start", "s.filed_at", "s.source_form", "s.accession")


def landed_taxonomies(spark, d):
    """Company-facts bodies with the same values under two taxonomies: the first one's count."""
    lines = T.table(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.year("l_shipdate").alias("y")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("v")
    )
    year = F.col("y").cast("string")

    def facts(times, start=True):
        fact = F.struct(
            (F.concat(year, F.lit("-01-01")) if start else F.lit(None).cast("string")).alias("start"), F.concat(year, F.lit("-12-31")).alias("end"),
            (F.col("v") * times).alias("val"), F.col("y").alias("fy"), F.lit("FY").alias("fp"), F.lit("10-K").alias("form"),
            F.concat((F.col("y") + 1).cast("string"), F.lit("-02-20")).alias("filed"), F.concat(F.lit("a-"), year).alias("accn"),
        )
        return F.sort_array(F.collect_list(fact))

    per = lines.groupBy("symbol").agg(facts(1.0).alias("a"), facts(2.0).alias("b"), facts(4.0, False).alias("c"), facts(8.0).alias("x"))

    def unit(column):
        return F.struct(F.create_map(F.lit("USD"), F.col(column)).alias("units"))

    first = F.create_map(F.lit("Revenues"), unit("a"), F.lit("NetIncomeLoss"), unit("b"), F.lit("Assets"), unit("c"))
    second = F.create_map(F.lit("Revenue"), unit("x"), F.lit("ProfitLoss"), unit("x"), F.lit("Assets"), unit("x"))
    second_only = F.create_map(F.lit("Revenue"), unit("a"), F.lit("ProfitLoss"), unit("b"), F.lit("Assets"), unit("c"))
    both = F.create_map(F.lit("ifrs-full"), second, F.lit("us-gaap"), first)
    body = F.to_json(F.struct(F.col("symbol").alias("entityName"), F.when(_number() % 3 == 0, F.create_map(F.lit("ifrs-full"), second_only)).otherwise(both).alias("facts")))
    annual, _, _ = CF.normalize(LJ.company_facts(per.select("symbol", body.alias("body"))))
    return annual.select("symbol", "fiscal_year", *[F.round(c, 2).alias(c) for c in ("total_revenue", "net_income", "total_assets")])


def reported_per_share(spark, d):
    """Quarters that were derived from the year: per-share values stay only where they were reported."""
    k = F.col("o_orderkey")
    source = F.create_map(F.lit("basic_eps"), F.struct(F.when(k % 5 == 0, "derived").otherwise("reported").alias("kind")))
    rows = T.table(spark, d, "orders").select(
        "o_orderkey", (k % 2 == 0).alias("derived_from_annual"), (F.col("o_totalprice") * 2).alias("basic_eps"), F.col("o_totalprice").alias("net_income"),
        F.when(k % 3 == 0, F.array(F.lit("net_income"), F.lit("basic_eps"))).otherwise(F.array(F.lit("net_income"))).alias("derived_metrics"),
        F.when(k % 7 != 0, source).alias("metric_sources"),
    )
    return ST.without_derived_per_share(rows).select("o_orderkey", "basic_eps", "net_income")


# --- breaks, reports, reviews, holdings -----------------------------------------------------


def leaders_without_breaks(spark, d):
    """Leaders where one listed symbol is in the table of broken histories, written in lower case."""
    rename = lambda df: df.withColumn("symbol", F.when(F.col("symbol") == "S5", "chrd").otherwise(F.col("symbol")))
    out = L.long_run_leaders(rename(RPR.adjusted(spark, d)), rename(T.listing(spark, d)), RPR.AS_OF, min_return=-100.0, **RPR.PLAN)
    return out.select("rank", "symbol", F.round("annualized_return_pct", 5).alias("annualized_return_pct"), "ending_value")


def report_choice(spark, d):
    """Two reports for each filing: the first that reconciles counts; some filings have none."""
    both = RT.segment_tables(spark, d, off=4, report=1).unionByName(RT.segment_tables(spark, d, off=8, report=2))
    out = FI.first_reconciled(FI.reconciled_segments(FI.segment_pairs(FI.candidate_reports(both, "(?i)revenue by", 6))))
    return out.select("symbol", "report", "total", F.size("segments").alias("parts"))


def segment_shares_varied(spark, d):
    n = F.col("n")
    rows = T.listing(spark, d).select("symbol", _number().alias("n"))
    parts = F.array(F.struct(F.lit("x").alias("name"), (n * 3.0).alias("amount")), F.struct(F.lit("y").alias("name"), (n + 7.0).alias("amount")))
    total = F.when(n % 10 == 0, 0.0).otherwise(n * 4.0 + 7.0)
    reviewed = F.date_sub(F.lit(AS_OF).cast("date"), n * 5 - 20).cast("string")
    profile = F.struct(F.struct(total.alias("total"), parts.alias("segments")).alias("revenue_breakdown"), reviewed.alias("reviewed_at"))
    out = RE.with_segment_shares(rows.select("symbol", profile.alias("p")), AS_OF)
    return out.select("symbol", "review_age_days", "needs_review", F.inline("segments"))


def index_file_dates(spark, d):
    """A constituents file of 300 members whose last row has another date, next to one that has a single date."""
    k = F.col("p_partkey")
    rows = T.table(spark, d, "part").where("p_partkey <= 300").select(
        F.when(k == 300, "20011031").otherwise("20011030.0").alias("date"), F.lit("300.0").alias("index_code"), k.cast("string").alias("code"), F.col("p_name").alias("name"),
        F.lit("Shanghai Stock Exchange").alias("exchange"),
    )
    files = [U.index_members(df).withColumn("group", F.lit("CSI300")) for df in (rows, rows.withColumn("date", F.lit("20011030")))]
    reports = [U.validate_members(f, AS_OF).withColumn("file", F.lit(i)) for i, f in enumerate(files, 1)]
    return reports[0].unionByName(reports[1])


# --- filing texts ------------------------------------------------------------------------------


def topic_windows(spark, d):
    """Documents as long business sections with mentions of the topics at varied places."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    body = F.concat(
        F.substring(text, 1, 2500), F.when(k % 3 == 0, " We sell to Distributors abroad. ").otherwise(" "), text, F.when(k % 2 == 0, " COMPETITION is keen. ").otherwise(" "),
        F.substring(text, 1, 1500), F.when(k % 5 == 0, " Our products are many. ").otherwise(" "), text, F.when(k % 7 < 3, " Pricing follows cost. ").otherwise(" "), text,
    )
    rows = T.table(spark, d, "documents").select("doc_id", FI.topic_text(body).alias("told"))
    return rows.select("doc_id", F.length("told").alias("chars"), F.md5("told").alias("digest"))


def filing_profiles_segments(spark, d):
    """Profiles with the segments of their reports; one in four reports does not reconcile."""
    html = F.concat(F.lit("<p>Item 1. Business</p>"), F.col("html"), F.lit("<p>Competition</p><p>There are many rivals in this field.</p><p>Item 1A. Risk Factors</p>"))
    pages = T.table(spark, d, "pages").select(F.concat(F.lit("S"), F.col("page_id").cast("string")).alias("symbol"), html.alias("html"))
    segments = FI.first_reconciled(FI.reconciled_segments(FI.segment_pairs(RT.segment_tables(spark, d))))
    out = FI.filing_profiles(pages, segments=segments)
    return out.select("symbol", F.col("found.revenue_segments").alias("has_segments"), F.col("revenue_segments.total").alias("total"), F.size("revenue_segments.segments").alias("parts"))


def exchange_symbols_markets(spark, d):
    """Charting-site symbols of listings in every market; Hong Kong codes with and without leading zeros."""
    rows, n = T.listing(spark, d), _number()

    def padded(width, fill):
        # lpad cuts longer numbers, and two listings would share a code.
        digits = n.cast("string")
        return F.lpad(digits, F.greatest(F.length(digits), width), F.lit(fill))

    code = (
        F.when(F.col("market") == "HK", F.concat(padded(F.when(n % 2 == 0, 4).otherwise(5), "0"), F.lit(".HK")))
        .when(F.col("market") == "TH", F.concat("symbol", F.lit(".BK")))
        .when(F.col("market") == "CN", F.concat(padded(F.lit(6), "6"), F.when(n % 3 == 0, ".SS").when(n % 3 == 1, ".SZ").otherwise("")))
        .otherwise(F.col("symbol"))
    )
    return rows.select(code.alias("code"), "market", U.exchange_symbol(code, F.lower("market")).alias("shown"))


def chosen_filing_profiles(spark, d):
    """Profiles of the chosen filings with their segments; the page of one company in four has not landed, other pages have."""
    chosen = RSO.chosen_filings(spark, d)
    line = F.trim(F.repeat(F.concat("entity_name", F.lit(" sells parts to many buyers. ")), 6))
    html = F.concat(F.lit("<p>Item 1. Business</p><p>"), line, F.lit("</p><p>Competition</p><p>There are many rivals.</p><p>Item 1A. Risk Factors</p><p>x</p>"))
    pages = chosen.where(_number() % 4 != 1).select("url", html.alias("html"))
    pages = pages.unionByName(chosen.select(F.concat("url", F.lit(".old")).alias("url"), html.alias("html")))
    segments = FI.first_reconciled(FI.reconciled_segments(FI.segment_pairs(RT.segment_tables(spark, d))))
    out = FI.chosen_profiles(chosen, pages, segments)
    return out.select(
        "symbol", "cik", "industry", "form", "filed_at", "period", "source_url", F.md5("business_summary").alias("summary_digest"), F.col("found.revenue_segments").alias("has_segments"),
        F.round("revenue_segments.total", 3).alias("total"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        scan_thresholds, scan_texts, scan_decisions, wide_overview, wide_verification_counts, facts_voted, facts_provenance, landed_taxonomies, reported_per_share, leaders_without_breaks, report_choice, segment_shares_varied,
        index_file_dates, topic_windows, filing_profiles_segments, chosen_filing_profiles,
        exchange_symbols_markets,
    )
}

# --- SQL -----------------------------------------------------------------------------------------

_OWN = """
scan_own AS (
  SELECT symbol, date, rn, 'afloat' AS name, 'BUY' AS side, least(85, 55 + (close / hi60 - 0.8) * 100) AS score, 50.0 AS confidence, hi60 AS level
  FROM scan_f WHERE rn >= 60 AND close > hi60 * 0.8
)"""


def n(value, digits):
    """A number as the messages print it: halves up, fixed digits."""
    return f"CAST(round(CAST({value} AS DECIMAL(30, 12)), {digits}) AS VARCHAR)"


def _joined(*cases):
    return "concat_ws('; ', " + ", ".join(f"CASE {c} END" for c in cases) + ")"


_BOOKS = (
    f"WHEN roe < 12 THEN 'ROE weak ' || {n('roe', 1)} || '%'", f"WHEN roa < 4 THEN 'ROA low ' || {n('roa', 1)} || '%'",
    f"WHEN debt_to_equity > 1.8 THEN 'debt/equity high ' || {n('debt_to_equity', 2)} || 'x'", f"WHEN growth < 0 THEN 'growth negative ' || {n('growth', 1)} || '%'",
    f"WHEN net_margin < 8 THEN 'net margin thin ' || {n('net_margin', 1)} || '%'", "WHEN liq < 40 THEN 'liquidity low'",
)
_GOOD = (
    f"WHEN roe >= 20 THEN 'ROE strong ' || {n('roe', 1)} || '%' WHEN roe >= 12 THEN 'ROE acceptable ' || {n('roe', 1)} || '%'",
    f"WHEN roa >= 8 THEN 'ROA healthy ' || {n('roa', 1)} || '%'", f"WHEN debt_to_equity <= 0.8 THEN 'debt/equity controlled ' || {n('debt_to_equity', 2)} || 'x'",
    f"WHEN growth >= 15 THEN 'growth strong ' || {n('growth', 1)} || '%' WHEN growth >= 5 THEN 'growth positive ' || {n('growth', 1)} || '%'",
    f"WHEN net_margin >= 18 THEN 'net margin high ' || {n('net_margin', 1)} || '%'", "WHEN liq >= 70 THEN 'liquid enough to execute'",
)
_PRICE = (
    f"WHEN valued AND pe IS NULL THEN 'no P/E: EPS is not positive' WHEN valued AND pe > 32 THEN 'P/E ' || {n('pe', 1)} || ' needs growth behind it'",
    f"WHEN valued AND growth > 0 AND pe / growth > 2.5 THEN 'PEG ' || {n('pe / growth', 2)} || ': price runs ahead of growth'",
    f"WHEN valued AND pbv IS NULL THEN 'no P/BV from these statements' WHEN valued AND pbv > 6 THEN 'P/BV ' || {n('pbv', 2)} || ' is expensive'",
    f"WHEN valued AND up < 0 THEN 'price is ' || {n('abs(up)', 1)} || '% above the appraised value'",
)
_NOTE = """CASE WHEN px IS NULL THEN 'no_exchange_rate' WHEN NOT valued THEN 'no_eps_or_equity' WHEN pe IS NULL THEN 'book_value_only'
  WHEN trading <> reporting THEN 'converted_to_reporting_currency' ELSE 'same_currency' END"""
_CHECKS = (
    "WHEN bearish THEN 'bearish chart structure'", "WHEN fin < 55 THEN 'books do not confirm the chart'", "WHEN NOT history THEN 'statement history incomplete'",
    f"WHEN NOT valued THEN 'valuation: ' || {_NOTE}", "WHEN NOT research THEN 'business quality not reviewed'", "WHEN verdict <> 'edge' THEN 'evidence: ' || verdict",
    "WHEN NOT fresh THEN 'price stale since ' || CAST(price_as_of AS DATE)",
    f"WHEN level <> 'full' THEN 'score capped at ' || {n(RS._CAP, 0)} || ' (' || level || ')'",
    f"WHEN round(usd, 2) <> 0 AND round(usd, 2) < 1000000 THEN 'thin turnover ' || {n('round(usd, 2) / 1000000', 2)} || 'M USD a day'",
)


def _label(value, high, a, mid, b, low):
    return f"CASE WHEN {value} >= {high} THEN '{a}' WHEN {value} >= {mid} THEN '{b}' ELSE '{low}' END"


_BIZ = "CASE WHEN research THEN biz ELSE 0.0 END"
_WIDE = S.with_(
    *RS.scan_ctes(_OWN),
    f"""
told AS (
  SELECT symbol, string_agg(name, ', ' ORDER BY ord) AS names, string_agg(name || ' level ' || {n('"level"', 2)}, '; ' ORDER BY ord) AS levels FROM last_hits GROUP BY 1
),
rev AS (
  SELECT 'S' || s_suppkey AS symbol, CASE s_suppkey % 5 WHEN 0 THEN 'wide' WHEN 1 THEN 'strong' WHEN 2 THEN 'medium' WHEN 3 THEN 'niche' ELSE 'none' END AS moat,
    CASE s_suppkey % 4 WHEN 0 THEN 'leader' WHEN 1 THEN 'beneficiary' WHEN 2 THEN 'neutral' ELSE 'laggard' END AS trend FROM supplier
)""",
    recursive=True,
)

_BODY = """substring(text, 1, 2500) || CASE WHEN doc_id % 3 = 0 THEN ' We sell to Distributors abroad. ' ELSE ' ' END || text || CASE WHEN doc_id % 2 = 0 THEN ' COMPETITION is keen. ' ELSE ' ' END
  || substring(text, 1, 1500) || CASE WHEN doc_id % 5 = 0 THEN ' Our products are many. ' ELSE ' ' END || text || CASE WHEN doc_id % 7 < 3 THEN ' Pricing follows cost. ' ELSE ' ' END || text"""
_MENTIONS = ", ".join(f"regexp_extract(body, '(?i)({p})')" for p in FI.TOPIC_PATTERNS)

SQL = {
    "scan_thresholds": _WIDE
    + f"SELECT symbol, market, round(final, 5) AS final_score, liq AS liquidity_score, grade, decision, patterns FROM sd WHERE final >= {LEAST_SCORE} AND liq >= {LEAST_LIQUIDITY}",
    "scan_texts": _WIDE
    + f"""SELECT sd.symbol, {_joined(*_BOOKS, *_PRICE, *_CHECKS)} AS warnings,
  {_label('tech', 78, 'A setup', 58, 'Watch', 'Weak')} || ' / detected: ' || names || ' / ' || levels AS technical,
  {_label('fin', 75, 'Strong', 55, 'Check', 'Weak')} || CASE WHEN fin >= 65 THEN ' / supports the setup / ' ELSE ' / needs caution / ' END || {_joined(*_GOOD, *_BOOKS)} AS financial,
  {_label(_BIZ, 75, 'Quality', 55, 'Neutral', 'Low quality')} || ' / moat and trend / moat ' || moat || '; trend ' || trend AS business,
  {_label('val', 72, 'Attractive', 55, 'Fair', 'Expensive')} || ' / price against value / ' || {_joined(*_PRICE)} AS valuation,
  grade || ' / ' || sd.symbol || ': ' || decision || ' / technical ' || {n('tech', 1)} || ', financial ' || {n('fin', 1)} || '; business ' || {n(_BIZ, 1)} || ', valuation ' || {n('val', 1)} AS report
FROM sd JOIN told ON told.symbol = sd.symbol JOIN rev ON rev.symbol = sd.symbol JOIN (SELECT symbol, price_as_of FROM tm) t ON t.symbol = sd.symbol""",
    "scan_decisions": _WIDE
    + f"""SELECT sd.symbol, NOT bearish AS technical_pass, names AS technical_label, history AS financials_verified, true AS financials_data_verified,
  'ROE ' || {n('roe', 1)} || '%, D/E ' || {n('debt_to_equity', 2)} || ', growth ' || {n('revenue_growth', 1)} || '%' AS financials_detail,
  valued AS valuation_verified, {RS._VERDICT} AS valuation_label, {_NOTE} AS valuation_detail,
  'stop ' || {n('CASE WHEN bearish THEN short_stop ELSE long_stop END', 2)} || ' ' || trading AS risk_label,
  CASE WHEN bearish THEN short_risk ELSE long_risk END / r3.last_price * 100 > 12 AS risk_wide,
  'entry ' || {n('r3.last_price', 2)} || ', first target ' || {n('CASE WHEN bearish THEN st[1] ELSE lt[1] END', 2)} || ', R:R '
    || {n('CASE WHEN bearish THEN 3.0::DOUBLE ELSE (lt[3] - r3.last_price) / long_risk END', 2)} AS risk_detail,
  verdict = 'edge' AS evidence_tradeable, verdict AS evidence_label, chosen.name AS evidence_pattern
FROM sd JOIN told ON told.symbol = sd.symbol JOIN r3 ON r3.symbol = sd.symbol
  JOIN (SELECT h.symbol, h.name, row_number() OVER (PARTITION BY h.symbol ORDER BY CASE WHEN ev.verdict = 'edge' THEN 2 WHEN ev.verdict IS NOT NULL THEN 1 ELSE 0 END DESC,
    CASE WHEN ev.verdict = 'edge' THEN return_edge_pp ELSE coalesce(nullif(return_edge_pp, 0), -999) END DESC, ord) AS pick FROM last_hits h LEFT JOIN ev ON ev.pattern = h.name) chosen
  ON chosen.symbol = sd.symbol AND chosen.pick = 1""",
    "wide_overview": _WIDE
    + """, bm AS (SELECT market, count(*) AS n, max(final) AS best FROM sd GROUP BY 1)
SELECT (SELECT count(*) FROM sd) AS results, round((SELECT max(final) FROM sd), 5) AS best_score, (SELECT count(*) FROM sd WHERE grade IN ('A', 'A+')) AS top_grades,
  (SELECT market FROM bm ORDER BY n DESC, best DESC, market LIMIT 1) AS busiest_market""",
    "wide_verification_counts": _WIDE
    + f"""SELECT l.level, count(sd.symbol) AS results FROM (VALUES {", ".join(f"('{k}')" for k in X.LEVELS)}) AS l(level) LEFT JOIN sd ON sd.level = l.level GROUP BY 1""",
    "facts_voted": """WITH l AS (SELECT l_suppkey AS k, year(l_shipdate) AS fy, quarter(l_shipdate) AS q, l_extendedprice AS p, l_tax FROM lineitem WHERE NOT (l_suppkey % 4 = 2 AND year(l_shipdate) > 1997)),
y AS (SELECT DISTINCT k, fy FROM l),
votes AS (
  SELECT k, count(*) FILTER (fy >= CASE k % 4 WHEN 1 THEN 1997 ELSE 1995 END AND k % 4 <> 3) AS ahead, count(*) AS filings FROM y GROUP BY 1
),
s AS (SELECT k, CASE WHEN 2 * ahead >= filings THEN 1 ELSE 0 END AS shift FROM votes)
SELECT 'S' || k AS symbol, fy + shift AS fiscal_year, make_date(fy, 12, 31) AS period_end, round(sum(p), 4) AS total_revenue, 'FY' AS quarter FROM l JOIN s USING (k) WHERE fy % 5 <> 3 GROUP BY k, fy, shift
UNION ALL
SELECT 'S' || k, fy + shift, last_day(make_date(fy, q * 3, 1)), round(sum(p), 4), 'Q' || q FROM l JOIN s USING (k) WHERE q < 4 AND NOT (k % 3 = 0 AND q = 2) GROUP BY k, fy, q, shift""",
    "facts_provenance": """WITH y AS (SELECT DISTINCT l_suppkey AS k, year(l_shipdate) AS fy FROM lineitem)
SELECT 'S' || k AS symbol, fy AS fiscal_year, metric, 'reported' AS kind, CASE WHEN metric = 'total_assets' THEN 'us-gaap:Assets' WHEN k % 7 = 0 THEN 'ifrs-full:Revenue' ELSE 'us-gaap:Revenues' END AS concept,
  CASE WHEN metric = 'total_revenue' THEN make_date(fy, 1, 1) END AS period_start, make_date(fy, 12, 31) + 50 AS filed_at, '10-K' AS source_form, 'S' || k || '-K-' || fy AS accession
FROM y, (VALUES ('total_revenue'), ('total_assets')) AS m(metric)""",
    "landed_taxonomies": """SELECT 'S' || l_suppkey AS symbol, year(l_shipdate) AS fiscal_year, round(sum(l_extendedprice), 2) AS total_revenue, round(round(sum(l_extendedprice), 2) * 2, 2) AS net_income,
  round(round(sum(l_extendedprice), 2) * 4, 2) AS total_assets FROM lineitem GROUP BY l_suppkey, year(l_shipdate)""",
    "reported_per_share": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 OR (o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0) THEN o_totalprice * 2 END AS basic_eps,
  o_totalprice AS net_income FROM orders""",
    "leaders_without_breaks": S.with_(S.SMOOTH, S.LISTING, RPR.MONTHS, RPR.PLANS, recursive=True)
    + """SELECT row_number() OVER (ORDER BY rate DESC, round(ending, 2) DESC, p.symbol) AS rank, p.symbol, round(rate, 5) AS annualized_return_pct, round(ending, 2) AS ending_value
FROM plans p JOIN listing l ON l.symbol = p.symbol WHERE p.symbol <> 'S5' AND rate >= -100""",
    "report_choice": """WITH p AS (SELECT l_suppkey AS k, l_returnflag, round(sum(l_quantity), 0) AS v FROM lineitem GROUP BY 1, 2),
t AS (SELECT k, sum(v) AS t, count(*) AS parts FROM p GROUP BY 1)
SELECT 'S' || k AS symbol, CASE WHEN k % 4 <> 0 THEN 1 ELSE 2 END AS report, round(t / 1000, 3) AS total, parts FROM t WHERE parts >= 2 AND k % 8 <> 0""",
    "segment_shares_varied": S.with_(S.LISTING, f"""
c AS (SELECT symbol, CAST(substr(symbol, 2) AS INT) AS n FROM listing),
t AS (SELECT *, greatest(0, n * 5 - 20) AS age, CASE WHEN n % 10 = 0 THEN NULL ELSE n * 4.0::DOUBLE + 7 END AS total FROM c)""")
    + f"""SELECT symbol, age AS review_age_days, age > {RE.REVIEW_DAYS} AS needs_review, s.name, CASE s.name WHEN 'x' THEN n * 3.0::DOUBLE ELSE n + 7.0::DOUBLE END AS amount,
  round(CASE s.name WHEN 'x' THEN n * 3.0::DOUBLE ELSE n + 7.0::DOUBLE END / total * 100, 2) AS share_pct FROM t, (VALUES ('x'), ('y')) AS s(name)""",
    "index_file_dates": """SELECT 'CSI300' AS "group", count(*) AS members, DATE '2001-10-31' AS as_of, CASE WHEN count(*) FILTER (p_partkey = 300) > 0 THEN 'mixed_dates' ELSE 'count_out_of_bounds' END AS error, 1 AS file
FROM part WHERE p_partkey <= 300 UNION ALL
SELECT 'CSI300', count(*), DATE '2001-10-30', CASE WHEN count(*) <> 300 THEN 'count_out_of_bounds' END, 2 FROM part WHERE p_partkey <= 300""",
    "topic_windows": f"""WITH b AS (SELECT doc_id, {_BODY} AS body FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
m AS (SELECT doc_id, body, unnest([{_MENTIONS}]) AS m FROM b),
spans AS (
  SELECT doc_id, 0 AS a, {FI.OPENING_CHARS} AS b FROM b
  UNION ALL SELECT doc_id, greatest(0, strpos(body, m) - 1 - {FI.BEFORE_CHARS}), greatest(0, strpos(body, m) - 1 - {FI.BEFORE_CHARS}) + {FI.WINDOW_CHARS} FROM m WHERE m <> ''
),
marked AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS opens FROM spans),
island AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM marked),
merged AS (SELECT doc_id, i, min(a) AS a, max(b) AS b FROM island GROUP BY 1, 2),
told AS (SELECT doc_id, string_agg(substring(body, a + 1, b - a), chr(10) || '[...]' || chr(10) ORDER BY a) AS told FROM merged JOIN (SELECT doc_id, body FROM b) USING (doc_id) GROUP BY 1)
SELECT doc_id, length(told) AS chars, md5(told) AS digest FROM told""",
    "exchange_symbols_markets": S.with_(S.LISTING, """
c AS (
  SELECT *, CAST(substr(symbol, 2) AS INT) AS n FROM listing
),
k AS (
  SELECT market, n, CASE market WHEN 'HK' THEN lpad(n::VARCHAR, CASE WHEN n % 2 = 0 THEN 4 ELSE 5 END, '0') || '.HK' WHEN 'TH' THEN symbol || '.BK'
    WHEN 'CN' THEN lpad(n::VARCHAR, 6, '6') || CASE n % 3 WHEN 0 THEN '.SS' WHEN 1 THEN '.SZ' ELSE '' END ELSE symbol END AS code, symbol FROM c
)""")
    + """SELECT code, market, CASE market WHEN 'HK' THEN 'HKEX:' || n WHEN 'TH' THEN 'SET:' || symbol
  WHEN 'CN' THEN CASE n % 3 WHEN 0 THEN 'SSE:' || lpad(n::VARCHAR, 6, '6') WHEN 1 THEN 'SZSE:' || lpad(n::VARCHAR, 6, '6') ELSE code END ELSE code END AS shown FROM k""",
    "chosen_filing_profiles": S.with_(f"""
p AS (SELECT l_suppkey AS k, round(sum(l_quantity), 0) AS v FROM lineitem GROUP BY l_suppkey, l_returnflag),
t AS (SELECT k, sum(v) AS t, count(*) AS parts FROM p GROUP BY 1),
ok AS (SELECT * FROM t WHERE parts >= 2 AND k % 4 <> 0),
c AS ({RSO.SQL["annual_filing_choice"]}),
n AS (SELECT c.*, s_suppkey AS k, s_name AS name FROM c JOIN supplier ON c.symbol = 'S' || s_suppkey)""")
    + """SELECT symbol, lpad(k::VARCHAR, 10, '0') AS cik, industry, form, '2001-02-20' AS filed_at, '2000-12-31' AS period, url AS source_url,
  md5(trim(repeat(name || ' sells parts to many buyers. ', 6))) AS summary_digest, ok.k IS NOT NULL AS has_segments, round(t / 1000, 3) AS total
FROM n LEFT JOIN ok USING (k) WHERE k % 4 <> 1""",
    "filing_profiles_segments": """WITH p AS (SELECT l_suppkey AS k, round(sum(l_quantity), 0) AS v FROM lineitem GROUP BY l_suppkey, l_returnflag),
t AS (SELECT k, sum(v) AS t, count(*) AS parts FROM p GROUP BY 1),
ok AS (SELECT * FROM t WHERE parts >= 2 AND k % 4 <> 0)
SELECT 'S' || page_id AS symbol, k IS NOT NULL AS has_segments, round(t / 1000, 3) AS total, coalesce(parts, NULL) AS parts FROM pages LEFT JOIN ok ON k = page_id""",
}
