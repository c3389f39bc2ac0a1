"""Filing facts and filing text."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import company_facts as CF
from barloom.operators import filings as FI
from barloom.registry import sql as S
from barloom.session import cut_lineage
from barloom.sources import trade_ticks as T

_CONCEPTS = {"total_revenue": "Revenues", "net_income": "NetIncomeLoss", "operating_cash_flow": "NetCashProvidedByUsedInOperatingActivities"}


def clean_facts(spark, d):
    """Supplier sales as filed facts: yearly 10-K values, quarterly 10-Q values, year-to-date cash flow."""
    lines = T.table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.year("l_shipdate").alias("fy"), F.quarter("l_shipdate").alias("q"),
        F.col("l_extendedprice").alias("total_revenue"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("net_income"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("operating_cash_flow"),
    )
    sums = [F.round(F.sum(m), 4).alias(m) for m in _CONCEPTS]
    year_start = F.make_date("fy", F.lit(1), F.lit(1))
    quarterly = lines.groupBy("symbol", "fy", "q").agg(*sums).withColumns(
        {"qs": F.make_date("fy", F.col("q") * 3 - 2, F.lit(1)), "end": F.last_day(F.make_date("fy", F.col("q") * 3, F.lit(1)))}
    )
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "fy").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    quarterly = quarterly.withColumn("ytd", F.round(F.sum("operating_cash_flow").over(w), 4)).filter("q < 4")
    annual = lines.groupBy("symbol", "fy").agg(*sums, F.round(F.sum("total_revenue") * 2, 4).alias("assets"))

    def fact(concept, value, start, unit="USD"):
        return F.struct(F.lit(concept).alias("concept"), value.alias("val"), start.alias("start"), F.lit(unit).alias("unit"))

    a = annual.select(
        "symbol", "fy", F.make_date("fy", F.lit(12), F.lit(31)).alias("end"), F.lit("10-K").alias("form"),
        F.concat("symbol", F.lit("-K-"), F.col("fy").cast("string")).alias("accn"),
        F.inline(F.array(
            *[fact(c, F.col(m), year_start) for m, c in _CONCEPTS.items()],
            fact("Assets", F.col("assets"), F.lit(None).cast("date")),
            fact("StockholdersEquity", F.col("assets") * 0.5, F.lit(None).cast("date")),
            fact("LongTermDebtCurrent", F.col("assets") * 0.1, F.lit(None).cast("date")),
            fact("ShortTermBorrowings", F.col("assets") * 0.05, F.lit(None).cast("date")),
            fact("CostOfRevenue", F.col("total_revenue") * 0.6, year_start),
            fact("PaymentsToAcquirePropertyPlantAndEquipment", F.col("total_revenue") * 0.02, year_start),
            fact("EarningsPerShareBasic", F.col("net_income") / 1000, year_start, "USD/shares"),
        )),
    )
    qrow = quarterly.select(
        "symbol", "fy", "end", F.lit("10-Q").alias("form"), F.concat("symbol", F.lit("-Q-"), F.col("fy").cast("string"), F.col("q").cast("string")).alias("accn"),
        F.inline(F.array(
            fact("Revenues", F.col("total_revenue"), F.col("qs")), fact("NetIncomeLoss", F.col("net_income"), F.col("qs")),
            fact(_CONCEPTS["operating_cash_flow"], F.col("ytd"), year_start),
        )),
    )
    clean = a.unionByName(qrow).withColumns(
        {"taxonomy": F.lit("us-gaap"), "filed": F.date_add("end", 50), "fp": F.lit("FY")}
    )
    # Every seventh filer reports under the other taxonomy.
    other = F.create_map(*[F.lit(x) for kv in _IFRS.items() for x in kv])
    ifrs = (F.substring("symbol", 2, 20).cast("int") % 7 == 0) & F.col("concept").isin(*_IFRS)
    return clean.withColumns(
        {"taxonomy": F.when(ifrs, "ifrs-full").otherwise(F.col("taxonomy")), "concept": F.when(ifrs, other[F.col("concept")]).otherwise(F.col("concept"))}
    )


def raw_facts(spark, d):
    """The filed facts together with facts that must change nothing."""
    clean = clean_facts(spark, d)
    return clean.unionByName(_noise(clean))


#: The other taxonomy's names of the concepts in use.
_IFRS = {
    "Revenues": "Revenue", "NetIncomeLoss": "ProfitLoss", "NetCashProvidedByUsedInOperatingActivities": "CashFlowsFromUsedInOperatingActivities",
    "EarningsPerShareBasic": "BasicEarningsLossPerShare",
}


def _noise(clean):
    """Facts that must change nothing: overruled, in another currency, invalid or of another period."""
    annual = clean.filter("form = '10-K'")
    flows = annual.filter("start is not null and unit = 'USD'")
    wrong = {"val": F.col("val") * 3}
    rows = [
        # Reported earlier and corrected by the later filing.
        flows.withColumns({**wrong, "filed": F.date_sub("filed", 20), "accn": F.concat("accn", F.lit("-old"))}),
        # A concept that is less preferred, in the same filing.
        flows.filter("concept = 'Revenues'").withColumns({**wrong, "concept": F.lit("SalesRevenueNet")}),
        # A second currency, in the older years only.
        flows.filter("fy < 1997").withColumns({**wrong, "unit": F.lit("EUR")}),
        # Filed before its period ends; a month under an annual form; a form that does not count.
        flows.withColumns({**wrong, "filed": F.date_sub("end", 5), "accn": F.concat("accn", F.lit("-early"))}),
        flows.withColumns({**wrong, "start": F.date_sub("end", 30), "accn": F.concat("accn", F.lit("-short")), "form": F.lit("10-K/A")}).filter("fy % 5 = 0"),
        flows.withColumns({**wrong, "form": F.lit("8-K"), "accn": F.concat("accn", F.lit("-8"))}),
        # A fiscal year of the same label that ends five days earlier, filed earlier.
        flows.filter("concept in ('Revenues', 'Revenue') and fy % 3 = 0").withColumns(
            {**wrong, "start": F.date_sub("start", 5), "end": F.date_sub("end", 5), "filed": F.date_sub("filed", 25), "accn": F.concat("accn", F.lit("-near"))}
        ),
        # A transition period after the year's end, and values that are no numbers.
        flows.filter("fy = 2001").withColumns({"start": F.date_add("end", 1), "end": F.date_add("end", 92), "filed": F.date_add("filed", 92), "form": F.lit("10-KT"), "accn": F.concat("accn", F.lit("-t"))}),
        flows.withColumns({"val": F.lit(float("nan")), "filed": F.date_add("filed", 9), "accn": F.concat("accn", F.lit("-nan"))}),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def facts_annual(spark, d):
    annual, _, _ = CF.normalize(raw_facts(spark, d))
    return annual.select(
        "symbol", "fiscal_year", "period_end", "period_start", "currency", *[F.round(c, 4).alias(c) for c in ("total_revenue", "net_income", "operating_cash_flow", "total_assets")],
        F.round("basic_eps", 8).alias("basic_eps"), "source_form",
    )


def facts_derived(spark, d):
    """What the reported figures imply: liabilities, debt, gross profit, capital spending, free cash flow."""
    annual, _, _ = CF.normalize(raw_facts(spark, d))
    names = ("total_liabilities", "total_debt", "gross_profit", "capital_expenditure", "free_cash_flow")
    return annual.select("symbol", "fiscal_year", *[F.round(c, 4).alias(c) for c in names], F.size("metric_sources").alias("sources"))


def excluded_facts(spark, d):
    """Transition periods after the last accepted year."""
    facts = cut_lineage(raw_facts(spark, d))
    annual, _, _ = CF.normalize(facts)
    return CF.excluded_periods(facts, annual)


def facts_quarterly(spark, d):
    _, quarters, _ = CF.normalize(raw_facts(spark, d))
    return quarters.select(
        "symbol", "fiscal_year", "quarter", "period_end", *[F.round(c, 6).alias(c) for c in ("total_revenue", "net_income", "operating_cash_flow")],
        F.col("metric_sources")["operating_cash_flow"]["kind"].alias("cash_kind"),
    )


def page_text(spark, d):
    text = T.table(spark, d, "pages").select("page_id", FI.plain_text(F.col("html")).alias("t"))
    return text.select("page_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


def _docs(spark, d):
    return T.table(spark, d, "documents").select("doc_id", "text")


def business_sections(spark, d):
    body = F.concat(F.lit("Item 1. Business\nItem 1A. Risk\nItem 1. Business\n"), F.col("text"), F.lit("\nItem 1A. Risk Factors\n"))
    out = _docs(spark, d).select("doc_id", FI.section_body(body).alias("b"))
    return out.select("doc_id", F.length("b").alias("chars"), F.md5("b").alias("digest"))


def business_summaries(spark, d):
    return _docs(spark, d).select("doc_id", FI.business_summary(F.col("text")).alias("summary"))


def customer_sentences(spark, d):
    """Natural text in which some line starts are a customer phrase."""
    text = F.regexp_replace("text", CUSTOMER_OPENING, "One customer $1")
    return _docs(spark, d).select("doc_id", FI.customer_concentration(text).alias("customers")).filter("customers <> ''")


#: Line starts that the check turns into a customer phrase: rare, as in a filing.
CUSTOMER_OPENING = r"(?m)^(Of|In|The|De|Die|La) "


def section_excerpts(spark, d):
    body = F.concat(F.lit("Intro\nCompetition\n"), F.col("text"), F.lit("\nEmployees\nmore"))
    return _docs(spark, d).select("doc_id", FI.section_excerpt(body).alias("excerpt"))


def filing_profiles(spark, d):
    """Pages as filings between the section's headings."""
    html = F.concat(F.lit("<p>Item 1. Business</p>"), F.col("html"), F.lit("<p>Item 1A. Risk Factors</p>"))
    out = FI.filing_profiles(T.table(spark, d, "pages").select("page_id", html.alias("html")))
    return out.select(
        "page_id", F.md5("business_summary").alias("summary_digest"), F.col("found.business_summary").alias("has_summary"),
        F.col("found.competition").alias("has_competition"), F.col("found.customer_concentration").alias("has_customers"), "schema_version",
    )


def segment_tables(spark, d, off=4, report=1):
    """Supplier revenue by return flag written as filing tables, with a total row; one total in ``off`` is wrong."""
    key = F.col("l_suppkey")
    parts = T.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.sum("l_quantity"), 0).alias("v"))
    cell = F.concat(
        F.lit("<tr><td>Operating Segments | Flag "), "l_returnflag", F.lit("</td></tr><tr><td>Revenues</td><td>$ "), F.format_number("v", 0), F.lit("</td></tr>")
    )
    per = parts.withColumn("cell", cell).groupBy("l_suppkey").agg(
        F.concat_ws("", F.sort_array(F.collect_list("cell"))).alias("rows"), F.sum("v").alias("t")
    )
    total = F.format_number(F.when(key % off == 0, F.col("t") * 2).otherwise(F.col("t")), 0)
    page = F.concat(
        F.lit("<table><tr><th>Revenue (Details) - USD ($) $ in Thousands</th></tr><tr><td>Total company</td></tr><tr><td>Net sales</td><td>"), total,
        F.lit("</td></tr>"), "rows", F.lit("</table>"),
    )
    return per.select(F.concat(F.lit("S"), key.cast("string")).alias("symbol"), F.lit(report).alias("report"), F.lit("Revenue by flag (Details)").alias("title"), page.alias("html"))


def reconciled_segments(spark, d):
    reports = FI.candidate_reports(segment_tables(spark, d), r"(?i)(disaggregat|net sales|net operating revenue|revenue by|segment (information|data|reporting))")
    out = FI.first_reconciled(FI.reconciled_segments(FI.segment_pairs(reports)))
    return out.select("symbol", "total", "currency", F.inline("segments"))


QUERIES = {
    f.__name__: f
    for f in (facts_annual, facts_quarterly, page_text, business_sections, business_summaries, customer_sentences, reconciled_segments, section_excerpts, filing_profiles, facts_derived, excluded_facts)
}

_TEXT = "html"
for _pattern, _new in (
    ("'(?is)<script.*?</script>|<style.*?</style>'", "' '"),
    ("'(?i)</(p|div|tr|h[1-6]|li|table)>'", "chr(10)"),
    ("'<[^>]+>'", "' '"),
):
    _TEXT = f"regexp_replace({_TEXT}, {_pattern}, {_new}, 'g')"
for _entity, _char in (("&middot;", "chr(183)"), ("&copy;", "chr(169)"), ("&quot;", "chr(34)"), ("&amp;", "'&'"), ("&amp", "'&'")):
    _TEXT = f"replace({_TEXT}, '{_entity}', {_char})"
_TEXT = f"regexp_replace(regexp_replace({_TEXT}, '[ \\t\\x{{a0}}]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g')"
_TEXT = f"regexp_replace(regexp_replace({_TEXT}, '^\\s+', ''), '\\s+$', '')"

_STRIP = "regexp_replace(regexp_replace({0}, '^[\\s\\x{{85}}\\x{{a0}}]+', ''), '[\\s\\x{{85}}\\x{{a0}}]+$', '')"

SQL = {
    "facts_annual": """SELECT 'S' || l_suppkey AS symbol, year(l_shipdate) AS fiscal_year, make_date(year(l_shipdate), 12, 31) AS period_end, make_date(year(l_shipdate), 1, 1) AS period_start,
  'USD' AS currency, round(sum(l_extendedprice), 4) AS total_revenue, round(sum(l_extendedprice * l_discount), 4) AS net_income,
  round(sum(l_extendedprice * l_tax), 4) AS operating_cash_flow, round(sum(l_extendedprice) * 2, 4) AS total_assets,
  round(round(sum(l_extendedprice * l_discount), 4) / 1000, 8) AS basic_eps, '10-K' AS source_form FROM lineitem GROUP BY l_suppkey, year(l_shipdate)""",
    "facts_quarterly": """WITH b AS (SELECT 'S' || l_suppkey AS symbol, year(l_shipdate) AS fy, quarter(l_shipdate) AS q, sum(l_extendedprice) AS r, sum(l_extendedprice * l_discount) AS n,
  sum(l_extendedprice * l_tax) AS c FROM lineitem GROUP BY 1, 2, 3 HAVING quarter(l_shipdate) < 4),
p AS (SELECT *, lag(q) OVER (PARTITION BY symbol, fy ORDER BY q) AS pq FROM b)
SELECT symbol, fy AS fiscal_year, 'Q' || q AS quarter, last_day(make_date(fy, q * 3, 1)) AS period_end, round(r, 6) AS total_revenue, round(n, 6) AS net_income,
  CASE WHEN q = 1 OR pq = q - 1 THEN round(c, 6) END AS operating_cash_flow,
  CASE WHEN q = 1 THEN 'reported' WHEN pq = q - 1 THEN 'derived_ytd_difference' END AS cash_kind FROM p""",
    "facts_derived": """WITH y AS (SELECT 'S' || l_suppkey AS symbol, year(l_shipdate) AS fiscal_year, round(sum(l_extendedprice), 4) AS r, round(sum(l_extendedprice) * 2, 4) AS a, round(sum(l_extendedprice * l_tax), 4) AS c FROM lineitem GROUP BY 1, 2)
SELECT symbol, fiscal_year, round(a - a * 0.5::DOUBLE, 4) AS total_liabilities, round(a * 0.1::DOUBLE + a * 0.05::DOUBLE, 4) AS total_debt, round(r - r * 0.6::DOUBLE, 4) AS gross_profit,
  round(-(r * 0.02::DOUBLE), 4) AS capital_expenditure, round(c - r * 0.02::DOUBLE, 4) AS free_cash_flow, 10 AS sources FROM y""",
    "excluded_facts": "SELECT DISTINCT 'S' || l_suppkey AS symbol, DATE '2002-04-02' AS period_end, '10-KT' AS source_form, 91 AS duration_days FROM lineitem WHERE year(l_shipdate) = 2001",
    "page_text": f"WITH t AS (SELECT page_id, {_TEXT} AS t FROM pages) SELECT page_id, len(t) AS chars, md5(t) AS digest FROM t",
    "business_sections": f"""WITH t AS (SELECT doc_id, {_STRIP.format('text')} AS t FROM documents) SELECT doc_id, len(t) AS chars, md5(t) AS digest FROM t""",
    "business_summaries": """WITH l AS (SELECT doc_id, trim(l) AS line, i FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(l, i)),
k AS (SELECT * FROM l WHERE len(line) >= 120 AND NOT regexp_matches(line, '(?i)^(part\\s+[ivx]+\\b|table of contents)'))
SELECT d.doc_id, coalesce(string_agg(k.line, ' ' ORDER BY k.i), '') AS summary FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id""",
    "customer_sentences": f"""WITH h AS (SELECT doc_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS h, i FROM documents,
  unnest(regexp_extract_all(regexp_replace(text, '{CUSTOMER_OPENING}', 'One customer \\1', 'g'), '(?i)[^.\\n]*{FI.CUSTOMER_PHRASES}[^.\\n]*\\.')) WITH ORDINALITY AS u(x, i)),
d AS (SELECT doc_id, h, min(i) AS i FROM h WHERE h <> '' GROUP BY 1, 2)
SELECT doc_id, string_agg(h, ' ' ORDER BY i) AS customers FROM d GROUP BY 1""",
    "section_excerpts": """WITH l AS (SELECT doc_id, trim(l) AS line, i FROM documents, unnest(string_split(text || chr(10) || 'Employees' || chr(10) || 'more', chr(10))) WITH ORDINALITY AS u(l, i)),
s AS (SELECT doc_id, min(i) AS stop FROM l WHERE regexp_matches(line, '^[A-Z].{0,70}$') GROUP BY 1),
e AS (SELECT l.doc_id, trim(regexp_replace(string_agg(line, ' ' ORDER BY i), '\\s+', ' ', 'g')) AS t FROM l JOIN s ON s.doc_id = l.doc_id AND i < stop GROUP BY 1)
SELECT doc_id, CASE WHEN coalesce(t, '') = '' THEN '' ELSE 'Competition — ' || t END AS excerpt FROM documents LEFT JOIN e USING (doc_id)""",
    "filing_profiles": f"""WITH t AS (SELECT page_id, {_TEXT} AS t FROM pages),
l AS (SELECT page_id, trim(l) AS line, i FROM t, unnest(string_split(t, chr(10))) WITH ORDINALITY AS u(l, i)),
k AS (SELECT page_id, string_agg(line, ' ' ORDER BY i) AS s FROM l WHERE len(line) >= 120 AND NOT regexp_matches(line, '(?i)^(part\\s+[ivx]+\\b|table of contents)') GROUP BY 1)
SELECT page_id, md5(coalesce(s, '')) AS summary_digest, coalesce(s, '') <> '' AS has_summary, false AS has_competition, false AS has_customers, 1 AS schema_version FROM t LEFT JOIN k USING (page_id)""",
    "reconciled_segments": """WITH p AS (SELECT 'S' || l_suppkey AS symbol, l_suppkey AS k, 'Flag ' || l_returnflag AS name, round(sum(l_quantity), 0) AS v FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT symbol, sum(v) AS t, count(*) AS n FROM p GROUP BY 1)
SELECT p.symbol, round(t.t / 1000, 3) AS total, 'USD' AS currency, p.name, round(p.v / 1000, 3) AS amount FROM p JOIN t ON t.symbol = p.symbol WHERE k % 4 <> 0 AND n >= 2""",
}
