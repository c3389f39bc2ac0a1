"""Statements, ratios, growth, coverage and snapshot fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import statements as ST
from barloom.registry import sql as S
from barloom.session import cut_lineage
from barloom.sources import order_statements as O
from barloom.sources import trade_ticks as T


def annual(spark, d):
    return O.annual_statements(spark, d)


def quarters(spark, d):
    return O.quarterly_statements(spark, d)


def five(spark, d):
    return ST.add_ratios(ST.last_periods(annual(spark, d), 5))


def _round(df, *names, digits=5):
    return df.withColumns({n: F.round(n, digits) for n in names})


RATIOS = list(ST.RATIOS)


def statement_ratios(spark, d):
    out = ST.add_ratios(annual(spark, d))
    return _round(out, *RATIOS).select("symbol", "fiscal_year", *RATIOS, "roe_withheld", "debt_to_equity_withheld", "negative_equity")


def last_five_years(spark, d):
    return ST.last_periods(annual(spark, d), 5).select("symbol", "fiscal_year", "period_end", "total_revenue")


def statement_growth(spark, d):
    out = ST.yearly_growth(annual(spark, d))
    return _round(out, "revenue_growth", "profit_growth").select("symbol", "fiscal_year", "revenue_growth", "profit_growth")


SUMMARY = [
    "revenue_cagr", "net_income_cagr", "free_cash_flow_cagr", "net_margin_change", "roe_change", "debt_to_equity_change",
    "revenue_progress", "profit_progress", "roe_progress", "debt_progress", "thesis_score",
]


def growth_summary(spark, d):
    out = ST.thesis_score(ST.growth_summary(five(spark, d)), 10, 10, 15, 1.0)
    return _round(out, *SUMMARY).select("symbol", "period", "elapsed_years", *SUMMARY)


def q4_derivation(spark, d):
    q = ST.to_long(quarters(spark, d))
    a = ST.to_long(annual(spark, d))
    out = ST.derive_q4(q, a)
    return out.withColumn("value", F.round("value", 5))


#: Leaves one year in five of every symbol out, another one for each symbol.
_GAP = "(fiscal_year + CAST(substring(symbol, 2) AS INTEGER)) % 5 <> 0"


def quarter_alignment(spark, d):
    a = annual(spark, d).filter(_GAP)
    q = quarters(spark, d).drop("fiscal_year", "quarter").select("symbol", "period_end")
    return ST.align_quarters(q, a).select("symbol", "period_end", "fiscal_year", "quarter")


def reconciliation(spark, d):
    out = ST.reconciliation_issues(annual(spark, d), quarters(spark, d))
    return _round(out, "annual_value", "quarter_sum", "difference", digits=6)


def _full_quarters(spark, d):
    """Quarters with the derived Q4 added back in, wide."""
    q = cut_lineage(ST.to_long(quarters(spark, d)))
    added = ST.derive_q4(q, ST.to_long(annual(spark, d))).select("symbol", "fiscal_year", "quarter", "period_end", "metric", "value")
    return ST.to_wide(q.unionByName(added), ["symbol", "fiscal_year", "quarter", "period_end"])


def _coverage(spark, d):
    return ST.coverage(annual(spark, d), _full_quarters(spark, d), T.listing(spark, d))


def statement_coverage(spark, d):
    out = _coverage(spark, d)
    return out.select(
        "symbol", "annual_periods", F.concat_ws(",", F.transform("annual_years", lambda y: y.cast("string"))).alias("annual_years"),
        "consecutive_annual_years", "quarter_periods",
        F.concat_ws(",", F.transform("full_quarter_years", lambda y: y.cast("string"))).alias("full_quarter_years"),
        "reconciliation_issues", "annual_complete", "quarterly_complete", "status", "core_metric_coverage_pct",
        "quarter_core_metric_coverage_pct",
    )


def missing_quarters(spark, d):
    out = ST.missing_quarters(quarters(spark, d))
    return out.select("symbol", "fiscal_year", F.concat_ws(",", "missing_quarters").alias("missing_quarters"))


def coverage_audit(spark, d):
    return ST.audit(_coverage(spark, d), T.listing(spark, d))


def snapshot_fields(spark, d):
    out = ST.snapshot_fields(ST.add_ratios(annual(spark, d)))
    names = ["roe", "roa", "debt_to_equity", "gross_margin", "net_margin", "revenue_growth", "profit_growth", "eps", "book_value_per_share"]
    return _round(out, *names).select("symbol", *names, "as_of")


def history_status(spark, d):
    return ST.history_status(annual(spark, d), quarters(spark, d))


def backfill_plan(spark, d):
    return ST.backfill_plan(annual(spark, d).filter(_GAP))


def merged_periods(spark, d):
    new = ST.to_long(annual(spark, d).select("symbol", "period_end", "total_revenue", "net_income")).filter("value > 0")
    old = ST.to_long(
        quarters(spark, d).filter("quarter = 'Q4'").select("symbol", "period_end", "total_revenue", "net_income", "total_debt")
    )
    return ST.merge_period_metrics(old, new)


def currency_presentation(spark, d):
    rows = T.listing(spark, d).select(
        F.concat("symbol", "suffix").alias("symbol"), "market", F.when(F.col("account_balance") > 5000, "usd").alias("currency")
    )
    out = ST.with_currency_presentation(rows)
    return out.select("symbol", "currency", "currency_source", "currency_label", "per_share_unit")


def year_change_badges(spark, d):
    rows = ST.to_long(annual(spark, d).select("symbol", "fiscal_year", "period_end", "net_income", "total_debt", "operating_cash_flow"))
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "metric").orderBy("fiscal_year")
    previous = F.when(F.col("fiscal_year") - F.lag("fiscal_year").over(w) == 1, F.lag("value").over(w))
    out = rows.withColumn("previous", previous)
    kind = ST.change_kind(F.col("value"), F.col("previous"), F.col("metric"), F.lit(False))
    out = out.withColumn("kind", kind)
    return out.withColumn("change", F.round(ST.change_value(F.col("value"), F.col("previous"), F.col("kind")), 5)).select(
        "symbol", "fiscal_year", "metric", "kind", "change"
    )


QUERIES = {
    "statement_ratios": statement_ratios,
    "last_five_years": last_five_years,
    "statement_growth": statement_growth,
    "growth_summary": growth_summary,
    "q4_derivation": q4_derivation,
    "quarter_alignment": quarter_alignment,
    "statement_reconciliation": reconciliation,
    "statement_coverage": statement_coverage,
    "missing_quarters": missing_quarters,
    "coverage_audit": coverage_audit,
    "snapshot_fields": snapshot_fields,
    "history_status": history_status,
    "backfill_plan": backfill_plan,
    "merged_periods": merged_periods,
    "currency_presentation": currency_presentation,
    "year_change_badges": year_change_badges,
}

_SUMS = """
  round(sum(l_extendedprice), 6) AS total_revenue,
  round(sum(l_extendedprice * 0.6::DOUBLE * (1 - l_discount)), 6) AS cost_of_revenue,
  round(sum(l_extendedprice * (l_discount - 0.02::DOUBLE)), 6) AS operating_income,
  round(sum(l_extendedprice * (l_discount - 0.03::DOUBLE)), 6) AS pretax_income,
  round(sum(l_extendedprice * 0.01::DOUBLE), 6) AS tax_provision,
  round(sum(l_extendedprice * (l_discount - 0.04::DOUBLE)), 6) AS net_income,
  round(sum(l_extendedprice * (l_tax - 0.02::DOUBLE)), 6) AS operating_cash_flow,
  round(sum(l_quantity * -20), 6) AS capital_expenditure,
  round(sum(l_quantity * 100), 6) AS total_debt"""

_DERIVED = """*, round(total_revenue - cost_of_revenue, 6) AS gross_profit, round(net_income / 10, 6) AS basic_eps,
  round(total_revenue * 0.5::DOUBLE + 100000, 6) AS total_assets,
  round(total_revenue * 0.1::DOUBLE + s_acctbal * 20, 6) AS stockholders_equity,
  round(operating_cash_flow + capital_expenditure, 6) AS free_cash_flow"""

STATEMENTS = f"""
annual0 AS (
  SELECT l_suppkey, year(l_shipdate) AS fiscal_year, {_SUMS} FROM lineitem GROUP BY 1, 2
),
annual1 AS (
  SELECT 'S' || s_suppkey AS symbol, make_date(fiscal_year, 12, 31) AS period_end, {_DERIVED}
  FROM annual0 JOIN supplier ON s_suppkey = l_suppkey
),
annual AS (SELECT *, round(total_assets - stockholders_equity, 6) AS total_liabilities FROM annual1),
quarters0 AS (
  SELECT l_suppkey, year(l_shipdate) AS fiscal_year, quarter(l_shipdate) AS q, {_SUMS} FROM lineitem
  WHERE (l_suppkey % 5 <> 0 OR l_discount < 0.09)
    AND NOT (l_suppkey % 2 = 1 AND quarter(l_shipdate) = 4) AND NOT (l_suppkey % 7 = 3 AND quarter(l_shipdate) = 2)
  GROUP BY 1, 2, 3
),
quarters1 AS (
  SELECT 'S' || s_suppkey AS symbol, 'Q' || q AS quarter, last_day(make_date(fiscal_year, q * 3, 1)) AS period_end, {_DERIVED}
  FROM quarters0 JOIN supplier ON s_suppkey = l_suppkey
),
quarters AS (SELECT *, round(total_assets - stockholders_equity, 6) AS total_liabilities FROM quarters1)"""

_B = "PARTITION BY symbol ORDER BY period_end"


def ratios_sql(source, name):
    return f"""
{name}0 AS (
  SELECT *, coalesce((stockholders_equity + lag(stockholders_equity) OVER ({_B})) / 2, stockholders_equity) AS eq,
    coalesce((total_assets + lag(total_assets) OVER ({_B})) / 2, total_assets) AS ta
  FROM {source}
),
{name} AS (
  SELECT *, CASE WHEN eq > 0 AND NOT (eq / ta < 0.01) THEN net_income / eq * 100 END AS roe,
    net_income / ta * 100 AS roa, net_income / total_revenue * 100 AS net_margin,
    gross_profit / total_revenue * 100 AS gross_margin,
    CASE WHEN stockholders_equity > 0 AND NOT (stockholders_equity / total_assets < 0.01) THEN total_debt / stockholders_equity END AS debt_to_equity,
    free_cash_flow / total_revenue * 100 AS fcf_margin,
    NOT (eq > 0 AND NOT (eq / ta < 0.01)) AS roe_withheld,
    NOT (stockholders_equity > 0 AND NOT (stockholders_equity / total_assets < 0.01)) AS debt_to_equity_withheld,
    stockholders_equity <= 0 AS negative_equity
  FROM {name}0
)"""


FIVE = "five0 AS (SELECT * FROM annual QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) <= 5)"

_LINES = (
    "total_revenue", "cost_of_revenue", "gross_profit", "operating_income", "pretax_income", "tax_provision", "net_income", "basic_eps",
    "total_assets", "total_liabilities", "total_debt", "stockholders_equity", "operating_cash_flow", "capital_expenditure", "free_cash_flow",
)


def _long(source, name, keys):
    return f"{name} AS (SELECT {keys}, metric, value FROM (UNPIVOT (SELECT {keys}, {', '.join(_LINES)} FROM {source}) ON {', '.join(_LINES)} INTO NAME metric VALUE value))"


_FLOWS = ", ".join(f"'{m}'" for m in ST.FLOW_METRICS)

Q4 = [
    _long("annual", "al", "symbol, fiscal_year, period_end"),
    _long("quarters", "ql", "symbol, fiscal_year, quarter, period_end"),
    f"""
qd AS (SELECT symbol, fiscal_year, max(period_end) FILTER (quarter = 'Q1') AS e1, max(period_end) FILTER (quarter = 'Q2') AS e2,
         max(period_end) FILTER (quarter = 'Q3') AS e3, max(period_end) FILTER (quarter = 'Q4') AS e4 FROM ql GROUP BY 1, 2),
qv AS (SELECT symbol, fiscal_year, metric, max(value) FILTER (quarter = 'Q1') AS v1, max(value) FILTER (quarter = 'Q2') AS v2,
         max(value) FILTER (quarter = 'Q3') AS v3, max(value) FILTER (quarter = 'Q4') AS v4 FROM ql GROUP BY 1, 2, 3),
q4 AS (
  SELECT a.symbol, a.fiscal_year, 'Q4' AS quarter, a.period_end, a.metric,
    CASE WHEN a.metric IN ({_FLOWS}) THEN CASE WHEN e1 < e2 AND e2 < e3 AND e3 < a.period_end AND a.period_end - e1 <= 330 THEN a.value - (v1 + v2 + v3) END
      ELSE a.value END AS value,
    CASE WHEN a.metric IN ({_FLOWS}) THEN 'derived_annual_less_q1_q3' ELSE 'annual_closing_balance' END AS kind
  FROM al a LEFT JOIN qd d ON a.symbol = d.symbol AND a.fiscal_year = d.fiscal_year
    LEFT JOIN qv v ON a.symbol = v.symbol AND a.fiscal_year = v.fiscal_year AND a.metric = v.metric
  WHERE v4 IS NULL AND a.metric <> 'basic_eps' AND (e4 IS NULL OR e4 = a.period_end)
)""",
]

_ISSUE_LINES = ("total_revenue", "net_income", "operating_cash_flow")


def _issues(source, name):
    parts = []
    for m in _ISSUE_LINES:
        parts.append(
            f"SELECT a.symbol, a.fiscal_year, '{m}' AS metric, a.{m} AS annual_value, s.{m} AS quarter_sum, s.{m} - a.{m} AS difference "
            f"FROM annual a JOIN (SELECT symbol, fiscal_year, count(DISTINCT quarter) AS n, "
            f"CASE WHEN count({m}) = 4 THEN sum({m}) END AS {m} FROM {source} GROUP BY 1, 2) s "
            f"ON a.symbol = s.symbol AND a.fiscal_year = s.fiscal_year WHERE s.n = 4 AND abs(s.{m} - a.{m}) > greatest(1, abs(a.{m}) * 0.005)"
        )
    return f"{name} AS ({' UNION ALL '.join(parts)})"


_CORE = " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE 1 END" for m in ST.CORE_METRICS)

COVERAGE = [
    STATEMENTS,
    *Q4,
    S.LISTING,
    """
fql AS (SELECT symbol, fiscal_year, quarter, period_end, metric, value FROM ql
        UNION ALL SELECT symbol, fiscal_year, quarter, period_end, metric, value FROM q4 WHERE value IS NOT NULL),
fq AS (SELECT symbol, fiscal_year, quarter, period_end, """
    + ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in _LINES)
    + " FROM fql GROUP BY 1, 2, 3, 4)",
    _issues("fq", "issues"),
    FIVE,
    f"""
ca AS (SELECT symbol, count(*) AS annual_periods, list_sort(list(DISTINCT fiscal_year)) AS years, sum({_CORE}) AS vals, min({_CORE}) AS poorest FROM five0 GROUP BY 1),
cy AS (SELECT symbol, fiscal_year, count(DISTINCT quarter) AS have, count(*) AS n, sum({_CORE}) AS vals, min({_CORE}) AS poorest FROM fq GROUP BY 1, 2),
ci AS (SELECT symbol, fiscal_year, count(*) AS bad FROM issues GROUP BY 1, 2),
cq AS (
  SELECT y.symbol, sum(have) AS quarter_periods, round(sum(vals) * 100.0::DOUBLE / (sum(n) * 5), 1) AS qcov, coalesce(sum(bad), 0) AS bad,
    list_sort(coalesce(list(y.fiscal_year) FILTER (have = 4 AND vals * 100.0::DOUBLE / (n * 5) >= 80 AND poorest >= 4 AND bad IS NULL), [])) AS full_years
  FROM cy y LEFT JOIN ci i ON y.symbol = i.symbol AND y.fiscal_year = i.fiscal_year GROUP BY 1
),
cov AS (
  SELECT l.symbol, l.market, coalesce(annual_periods, 0) AS annual_periods, coalesce(years, []) AS years,
    coalesce(quarter_periods, 0) AS quarter_periods, coalesce(full_years, []) AS full_years, coalesce(bad, 0) AS bad,
    coalesce(len(years) = 5 AND years[5] - years[1] = 4, false) AS consecutive,
    coalesce(vals * 100.0::DOUBLE / (annual_periods * 5), 0) AS share, poorest, coalesce(qcov, 0) AS qcov
  FROM listing l LEFT JOIN ca ON l.symbol = ca.symbol LEFT JOIN cq ON l.symbol = cq.symbol
),
cov2 AS (
  SELECT *, consecutive AND share >= 80 AND coalesce(poorest, 0) >= 4 AS annual_complete,
    consecutive AND len(list_intersect(years, full_years)) >= 5 AS quarterly_complete FROM cov
),
cov3 AS (
  SELECT *, CASE WHEN annual_complete AND quarterly_complete THEN 'complete' WHEN annual_complete THEN 'annual_complete'
    WHEN annual_periods > 0 THEN 'partial' ELSE 'missing' END AS status FROM cov2
)""",
]


def _cagr(name):
    return f"CASE WHEN z.{name} > 0 AND a.{name} > 0 AND z.fiscal_year > a.fiscal_year THEN (pow(z.{name} / a.{name}, 1.0::DOUBLE / (z.fiscal_year - a.fiscal_year)) - 1) * 100 END"


_PROGRESS = "greatest(0, least(100, {0} / {1}::DOUBLE * 100))"

_AUDIT = """count(*) AS symbols, count(*) FILTER (status <> 'missing') AS cached, count(*) FILTER (annual_complete) AS annual_5y,
  count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status IN ('annual_complete', 'partial')) AS partial,
  count(*) FILTER (status = 'missing') AS missing,
  round(count(*) FILTER (status <> 'missing') * 100.0::DOUBLE / count(*), 1) AS cached_coverage_pct,
  round(count(*) FILTER (annual_complete) * 100.0::DOUBLE / count(*), 1) AS annual_5y_coverage_pct,
  round(count(*) FILTER (status = 'complete') * 100.0::DOUBLE / count(*), 1) AS complete_coverage_pct"""

SNAPSHOT = f"""
snap0 AS (
  SELECT *, lag(total_revenue) OVER ({_B}) AS prev_revenue, lag(net_income) OVER ({_B}) AS prev_income,
    row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS pick FROM ar
),
snap AS (
  SELECT symbol, period_end AS as_of, coalesce(roe, 0) AS roe, coalesce(roa, 0) AS roa, coalesce(debt_to_equity, 0) AS debt_to_equity,
    coalesce(gross_margin, 0) AS gross_margin, coalesce(net_margin, 0) AS net_margin,
    CASE WHEN coalesce(prev_revenue, 0) = 0 THEN 0 ELSE (total_revenue / prev_revenue - 1) * 100 END AS revenue_growth,
    CASE WHEN coalesce(prev_income, 0) = 0 THEN 0 ELSE (net_income / prev_income - 1) * 100 END AS profit_growth,
    basic_eps AS eps,
    CASE WHEN basic_eps <> 0 AND net_income / basic_eps > 0 THEN coalesce(stockholders_equity / (net_income / basic_eps), 0) ELSE 0 END AS book_value_per_share
  FROM snap0 WHERE pick = 1
)"""

_R5 = lambda *names: ", ".join(f"round({n}, 5) AS {n}" for n in names)

SQL = {
    "statement_ratios": S.with_(STATEMENTS, ratios_sql("annual", "ar"))
    + f"SELECT symbol, fiscal_year, {_R5(*RATIOS)}, roe_withheld, debt_to_equity_withheld, negative_equity FROM ar",
    "last_five_years": S.with_(STATEMENTS, FIVE) + "SELECT symbol, fiscal_year, period_end, total_revenue FROM five0",
    "statement_growth": S.with_(
        STATEMENTS,
        f"""
g AS (SELECT *, CASE WHEN fiscal_year - lag(fiscal_year) OVER ({_B}) = 1 THEN lag(total_revenue) OVER ({_B}) END AS pr,
  CASE WHEN fiscal_year - lag(fiscal_year) OVER ({_B}) = 1 THEN lag(net_income) OVER ({_B}) END AS pn FROM annual)""",
    )
    + """SELECT symbol, fiscal_year, round(CASE WHEN pr > 0 AND total_revenue >= 0 THEN (total_revenue / pr - 1) * 100 END, 5) AS revenue_growth,
  round(CASE WHEN pn > 0 AND net_income >= 0 THEN (net_income / pn - 1) * 100 END, 5) AS profit_growth FROM g""",
    "growth_summary": S.with_(
        STATEMENTS,
        FIVE,
        ratios_sql("five0", "ar"),
        f"""
a AS (SELECT * FROM ar QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end) = 1),
z AS (SELECT * FROM ar QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) = 1),
s AS (
  SELECT z.symbol, a.fiscal_year || '-' || z.fiscal_year AS period, z.fiscal_year - a.fiscal_year AS elapsed_years,
    {_cagr('total_revenue')} AS revenue_cagr, {_cagr('net_income')} AS net_income_cagr, {_cagr('free_cash_flow')} AS free_cash_flow_cagr,
    CASE WHEN z.fiscal_year > a.fiscal_year THEN z.net_margin - a.net_margin END AS net_margin_change,
    CASE WHEN z.fiscal_year > a.fiscal_year THEN z.roe - a.roe END AS roe_change,
    CASE WHEN z.fiscal_year > a.fiscal_year THEN z.debt_to_equity - a.debt_to_equity END AS debt_to_equity_change,
    z.roe, z.debt_to_equity AS de
  FROM z JOIN a ON a.symbol = z.symbol
),
p AS (
  SELECT *, CASE WHEN revenue_cagr IS NOT NULL THEN {_PROGRESS.format('revenue_cagr', 10)} END AS revenue_progress,
    CASE WHEN net_income_cagr IS NOT NULL THEN {_PROGRESS.format('net_income_cagr', 10)} END AS profit_progress,
    CASE WHEN roe IS NOT NULL THEN {_PROGRESS.format('roe', 15)} END AS roe_progress,
    CASE WHEN de IS NULL THEN NULL WHEN de = 0 THEN 100 WHEN de < 0 THEN 0 ELSE greatest(0, least(100, 1.0::DOUBLE / de * 100)) END AS debt_progress
  FROM s
)""",
    )
    + f"""SELECT symbol, period, elapsed_years, {_R5(*SUMMARY[:-1])},
  round((revenue_progress + profit_progress + roe_progress + debt_progress) / 4) AS thesis_score FROM p""",
    "q4_derivation": S.with_(STATEMENTS, *Q4)
    + "SELECT symbol, fiscal_year, quarter, period_end, metric, round(value, 5) AS value, kind FROM q4 WHERE value IS NOT NULL",
    "quarter_alignment": S.with_(
        STATEMENTS,
        f"""
y AS (SELECT symbol, period_end AS e, fiscal_year AS fy FROM annual WHERE {_GAP}),
l AS (SELECT symbol, max(e) AS last_end, max(fy) AS last_fy FROM y GROUP BY 1),
m AS (
  SELECT q.symbol, q.period_end, y.e, y.fy, l.last_end, l.last_fy,
    row_number() OVER (PARTITION BY q.symbol, q.period_end ORDER BY y.e NULLS LAST) AS pick
  FROM quarters q LEFT JOIN y ON y.symbol = q.symbol AND y.e - q.period_end BETWEEN 0 AND 330 LEFT JOIN l ON l.symbol = q.symbol
)""",
    )
    + """
SELECT symbol, period_end, CASE WHEN e IS NOT NULL THEN fy WHEN last_end IS NOT NULL THEN last_fy + 1 ELSE year(period_end) END AS fiscal_year,
  CASE WHEN e IS NOT NULL THEN 'Q' || CAST(greatest(1, least(4, 4 - round_even((e - period_end) / 91.31::DOUBLE, 0))) AS INTEGER)
    WHEN last_end IS NOT NULL THEN 'Q' || CAST(greatest(1, least(3, round_even((period_end - last_end) / 91.31::DOUBLE, 0))) AS INTEGER)
    ELSE 'Q' || quarter(period_end) END AS quarter
FROM m WHERE pick = 1 AND (e IS NOT NULL OR last_end IS NULL OR period_end - last_end BETWEEN 45 AND 310)""",
    "statement_reconciliation": S.with_(STATEMENTS, _issues("quarters", "issues"))
    + "SELECT symbol, fiscal_year, metric, round(annual_value, 6) AS annual_value, round(quarter_sum, 6) AS quarter_sum, round(difference, 6) AS difference FROM issues",
    "statement_coverage": S.with_(*COVERAGE)
    + """SELECT symbol, annual_periods, array_to_string(years, ',') AS annual_years, consecutive AS consecutive_annual_years, quarter_periods,
  array_to_string(full_years, ',') AS full_quarter_years, bad AS reconciliation_issues, annual_complete, quarterly_complete, status,
  round(share, 1) AS core_metric_coverage_pct, qcov AS quarter_core_metric_coverage_pct FROM cov3""",
    "missing_quarters": S.with_(STATEMENTS)
    + """SELECT symbol, fiscal_year, array_to_string(list_sort(list_filter(['Q1', 'Q2', 'Q3', 'Q4'], lambda x: NOT list_contains(list(quarter), x))), ',') AS missing_quarters
FROM quarters GROUP BY 1, 2""",
    "coverage_audit": S.with_(*COVERAGE)
    + f"""
SELECT 'market' AS group_kind, market AS "group", {_AUDIT} FROM cov3 GROUP BY market
UNION ALL SELECT 'source', 'missing', {_AUDIT} FROM cov3
UNION ALL SELECT 'total', 'all', {_AUDIT} FROM cov3""",
    "snapshot_fields": S.with_(STATEMENTS, ratios_sql("annual", "ar"), SNAPSHOT)
    + f"""SELECT symbol, as_of, {_R5('roe', 'roa', 'debt_to_equity', 'gross_margin', 'net_margin', 'revenue_growth', 'profit_growth', 'eps', 'book_value_per_share')} FROM snap""",
    "history_status": S.with_(
        STATEMENTS,
        FIVE,
        """
fqy AS (SELECT symbol, fiscal_year FROM quarters GROUP BY 1, 2 HAVING count(DISTINCT quarter) = 4),
n AS (SELECT f.symbol, count(DISTINCT f.fiscal_year) AS years, count(DISTINCT f.fiscal_year) FILTER (q.fiscal_year IS NOT NULL) AS full_years
  FROM five0 f LEFT JOIN fqy q ON q.symbol = f.symbol AND q.fiscal_year = f.fiscal_year GROUP BY 1)""",
    )
    + "SELECT symbol, CASE WHEN years >= 5 AND full_years >= 5 THEN 'complete' WHEN years > 0 THEN 'partial' ELSE 'missing' END AS status FROM n",
    "backfill_plan": S.with_(
        STATEMENTS,
        f"""
b AS (SELECT * FROM annual WHERE {_GAP}
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) <= 5),
s AS (SELECT symbol, count(*) AS n, min({_CORE}) AS poorest, max(fiscal_year) AS y FROM b GROUP BY 1)""",
    )
    + "SELECT symbol, NOT (n = 5 AND poorest >= 4) AS needed, make_date(y - 5, 1, 1) AS from_date, make_date(y - 2, 1, 1) AS to_date FROM s",
    "merged_periods": S.with_(STATEMENTS, _long("annual", "al", "symbol, period_end"), _long("quarters", "ql", "symbol, quarter, period_end"))
    + """
SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.period_end, o.period_end) AS period_end, coalesce(n.metric, o.metric) AS metric,
  coalesce(n.value, o.value) AS value
FROM (SELECT * FROM al WHERE metric IN ('total_revenue', 'net_income') AND value > 0) n
FULL JOIN (SELECT * FROM ql WHERE quarter = 'Q4' AND metric IN ('total_revenue', 'net_income', 'total_debt')) o
  ON n.symbol = o.symbol AND n.period_end = o.period_end AND n.metric = o.metric""",
    "currency_presentation": S.with_(
        S.LISTING,
        """
c AS (SELECT symbol || suffix AS symbol, account_balance > 5000 AS given,
  CASE WHEN account_balance > 5000 THEN 'USD' ELSE CASE market WHEN 'US' THEN 'USD' WHEN 'TH' THEN 'THB' WHEN 'HK' THEN 'HKD' WHEN 'CN' THEN 'CNY' ELSE 'GBP' END END AS currency FROM listing)""",
    )
    + """SELECT symbol, currency, CASE WHEN given THEN 'provider' ELSE 'exchange_default' END AS currency_source,
  currency || ' (' || CASE currency WHEN 'USD' THEN 'ดอลลาร์สหรัฐ' WHEN 'THB' THEN 'บาท' WHEN 'HKD' THEN 'ดอลลาร์ฮ่องกง' WHEN 'CNY' THEN 'หยวนจีน' ELSE 'ปอนด์สเตอร์ลิง' END || ')' AS currency_label,
  currency || ' per share' AS per_share_unit FROM c""",
    "year_change_badges": S.with_(
        STATEMENTS,
        _long("annual", "al", "symbol, fiscal_year"),
        """
p AS (SELECT *, CASE WHEN fiscal_year - lag(fiscal_year) OVER w = 1 THEN lag(value) OVER w END AS prev,
    metric IN ('net_income', 'operating_cash_flow') AS profit
  FROM al WHERE metric IN ('net_income', 'total_debt', 'operating_cash_flow') WINDOW w AS (PARTITION BY symbol, metric ORDER BY fiscal_year)),
k AS (SELECT *, CASE WHEN prev IS NULL THEN NULL
  WHEN profit AND prev <= 0 AND value = prev THEN 'unchanged' WHEN profit AND prev < 0 AND value > 0 THEN 'turned_to_profit'
  WHEN profit AND prev <= 0 AND value = 0 THEN 'break_even' WHEN profit AND prev = 0 AND value > 0 THEN 'became_positive'
  WHEN profit AND prev < 0 AND value > prev THEN 'smaller_loss' WHEN profit AND prev < 0 THEN 'larger_loss'
  WHEN profit AND prev >= 0 AND value < 0 THEN 'turned_to_loss' WHEN prev <= 0 OR value < 0 THEN NULL ELSE 'percent' END AS kind FROM p)""",
    )
    + "SELECT symbol, fiscal_year, metric, kind, CASE WHEN kind = 'percent' THEN round((value / prev - 1) * 100, 5) END AS change FROM k",
}
