"""Contribution plans and company profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import contribution as C
from barloom.operators import profile as P
from barloom.operators import statements as ST
from barloom.operators.asof import asof_join
from barloom.plans import leaders as L
from barloom.plans import stock_profile as SP
from barloom.registry import scan as RC
from barloom.registry import sql as S
from barloom.registry import statements as RS
from barloom.registry.bars import raw, smooth
from barloom.sources import order_statements as O
from barloom.sources import trade_ticks as T

AS_OF = "2001-10-31"
PLAN = dict(years=5, min_months=55)


def adjusted(spark, d):
    """Smooth bars with both adjusted prices; bars of a round volume lack them."""
    bars = smooth(spark, d)
    return bars.withColumns(
        {
            "adjusted_close": F.when(F.col("volume") % 10 != 0, F.col("close")),
            "adjusted_open": F.col("open"),
        }
    )


def monthly_records(spark, d):
    return C.monthly_records(adjusted(spark, d), F.lit(AS_OF).cast("date"))


def _plans(spark, d):
    return C.evaluate_plans(adjusted(spark, d), AS_OF, **PLAN)


def contribution_plans(spark, d):
    return _plans(spark, d).withColumn("annualized_return_pct", F.round("annualized_return_pct", 5))


def leaders(spark, d):
    out = L.long_run_leaders(adjusted(spark, d), T.listing(spark, d), AS_OF, min_return=0.0, **PLAN)
    return out.select("rank", "symbol", "market", F.round("annualized_return_pct", 5).alias("annualized_return_pct"), "ending_value")


def podium(spark, d):
    return L.podium(leaders(spark, d))


def leaders_search(spark, d):
    return L.search(L.long_run_leaders(adjusted(spark, d), T.listing(spark, d), AS_OF, min_return=0.0, **PLAN), " #00000001 ").select("rank", "symbol")


def leader_counts(spark, d):
    names = T.listing(spark, d)
    broken = C.continuity_issues(names.select("symbol"), C.breaks_table(spark), F.lit(AS_OF).cast("date"))
    return L.leader_counts(_plans(spark, d), names, broken, 0.0)


def price_return(spark, d):
    bars = adjusted(spark, d).withColumn("adjusted_close", F.when(F.col("symbol") != "S7", F.col("close") * 0.5))
    return P.price_return(bars)


def period_closes(spark, d):
    ends = RS.annual(spark, d).select("symbol", F.col("period_end").alias("date"), "fiscal_year")
    out = asof_join(ends, raw(spark, d).select("symbol", "date", "close", F.col("date").alias("bar_date")), ["close", "bar_date"])
    return out.select("symbol", "fiscal_year", F.round("close", 6).alias("close"), "bar_date")


def _profiles(spark, d):
    names = (
        T.listing(spark, d).select("symbol", "sector")
        .join(O.currencies(spark, d), "symbol")
        .join(O.reviews(spark, d).select("symbol", F.col("fair_value").alias("analyst_fair_value"), F.col("research_verified").alias("company_profile_verified")), "symbol")
    )
    return SP.stock_profiles(RS.five(spark, d), smooth(spark, d), names, O.fx_rates(spark, d))


STATE = [c for parts in P.STAGES.values() for c in parts]


def quality_stages(spark, d):
    return _profiles(spark, d).select("symbol", *P.STAGES, *STATE, "passed_stages", "roic")


def company_types(spark, d):
    return _profiles(spark, d).select("symbol", "company_type", "revenue_cagr", "profit_cagr", "profit_volatility", "pbv")


def fair_values(spark, d):
    out = _profiles(spark, d)
    return out.select(
        "symbol", "fx_adjusted", F.size("pe_history").alias("pe_years"),
        F.concat_ws("|", F.transform("methods", lambda m: m["key"])).alias("methods"), "fair_value_low", "fair_value_high", "spread", "estimates_agree",
        "margin_of_safety_pct", "verdict", "passed_checks",
    )


def growth_snapshot(spark, d):
    out = _profiles(spark, d)
    g = F.col("growth_snapshot")
    t = lambda i: F.col("series_summary")[i]["trend"]
    return out.select(
        "symbol", g["revenue"]["years"].alias("years"), g["revenue"]["growth"]["cagr_pct"].alias("revenue_cagr"),
        g["net_income"]["growth"]["total_change_pct"].alias("income_change"), t(1)["kind"].alias("income_trend"), t(1)["tone"].alias("income_tone"),
        t(6)["kind"].alias("margin_trend"), t(6)["value"].alias("margin_change"), t(7)["tone"].alias("debt_tone"),
    )


def thesis_fields(spark, d):
    """Snapshots assembled from listing, statements, reviews and currencies."""
    return RC.snapshots(spark, d).select(
        "symbol", "market", "moat", "ai_trend", "analyst_fair_value", "research_status", "research_verified",
        "fundamentals_verified", "financial_history_complete", "reporting_currency", "trading_currency",
    )


QUERIES = {
    "monthly_records": monthly_records,
    "contribution_plans": contribution_plans,
    "long_run_leaders": leaders,
    "leader_counts": leader_counts,
    "podium": podium,
    "leaders_search": leaders_search,
    "price_return": price_return,
    "asof_period_close": period_closes,
    "quality_stages": quality_stages,
    "company_types": company_types,
    "fair_values": fair_values,
    "growth_snapshot": growth_snapshot,
    "snapshot_assembly": thesis_fields,
}

_W = "PARTITION BY symbol ORDER BY date"
MONTHS = f"""
adj AS (SELECT *, CASE WHEN volume % 10 <> 0 THEN close END AS adjusted_close, open AS adjusted_open FROM smooth_bars),
mr AS (
  SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS contribution_date, max(date) AS latest_date,
    arg_min(adjusted_open, date) AS purchase_price, arg_max(adjusted_close, date) AS close
  FROM adj WHERE adjusted_close > 0 AND adjusted_open > 0 AND date <= DATE '{AS_OF}' GROUP BY 1, 2
)"""

# An independent solver: bisection over a recursive table of brackets.
PLANS = f"""
hist AS (SELECT * FROM mr WHERE contribution_date >= DATE '1996-10-01'),
hs AS (
  SELECT symbol, count(*) AS months, min(contribution_date) AS start_date, max(latest_date) AS end_date,
    max(year(contribution_date) * 12 + month(contribution_date)) - min(year(contribution_date) * 12 + month(contribution_date)) + 1 AS span,
    arg_min(purchase_price, contribution_date) AS p0, arg_max(close, contribution_date) AS pz FROM hist GROUP BY 1
),
ok AS (SELECT * FROM hs WHERE months >= 55 AND span = months AND start_date - DATE '1996-10-01' <= 45 AND DATE '{AS_OF}' - end_date <= 45),
pay AS (
  SELECT h.symbol, h.contribution_date AS d, CASE WHEN h.contribution_date = o.start_date THEN 100000 ELSE 5000 END::DOUBLE AS amount, h.purchase_price
  FROM hist h JOIN ok o ON o.symbol = h.symbol
),
val AS (SELECT p.symbol, sum(amount / purchase_price) * any_value(o.pz) AS ending, sum(amount) AS invested FROM pay p JOIN ok o ON o.symbol = p.symbol GROUP BY 1),
flows AS (
  SELECT p.symbol, (p.d - o.start_date) / 365.0::DOUBLE AS t, -amount AS a FROM pay p JOIN ok o ON o.symbol = p.symbol
  UNION ALL SELECT o.symbol, (o.end_date - o.start_date) / 365.0::DOUBLE, v.ending FROM ok o JOIN val v ON v.symbol = o.symbol
),
fl AS (SELECT symbol, list(t ORDER BY t, a) AS ts, list(a ORDER BY t, a) AS amounts FROM flows GROUP BY 1),
solve AS (
  SELECT symbol, 0 AS i, -0.9999::DOUBLE AS lo, 1024.0::DOUBLE AS hi, ts, amounts FROM fl
  UNION ALL
  SELECT symbol, i + 1, CASE WHEN v > 0 THEN m ELSE lo END, CASE WHEN v > 0 THEN hi ELSE m END, ts, amounts FROM (
    SELECT *, (lo + hi) / 2 AS m, list_sum(list_transform(list_zip(ts, amounts), lambda x: x[2] / pow(1 + (lo + hi) / 2, x[1]))) AS v FROM solve WHERE i < 100)
),
irr AS (SELECT symbol, (lo + hi) / 2 * 100 AS rate FROM solve WHERE i = 100),
falls AS (SELECT symbol, min(close / pk - 1) AS worst FROM (
  SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY contribution_date ROWS UNBOUNDED PRECEDING) AS pk FROM hist) GROUP BY 1),
plans AS (
  SELECT o.symbol, o.start_date, o.end_date, o.months, o.months - 1 AS dca_payments, (o.end_date - o.start_date) / 365.2425::DOUBLE AS y,
    v.invested, v.ending, irr.rate, o.p0, o.pz, f.worst
  FROM ok o JOIN val v ON v.symbol = o.symbol JOIN irr ON irr.symbol = o.symbol JOIN falls f ON f.symbol = o.symbol
)"""

_F = f"SELECT row_number() OVER (PARTITION BY symbol ORDER BY period_end) AS i, count(*) OVER (PARTITION BY symbol) AS n, * FROM "

PROFILE = f"""
ap AS (
  SELECT *, CASE WHEN coalesce(total_debt, 0) + coalesce(stockholders_equity, 0) <> 0 THEN operating_income * (1 - least(greatest(CASE WHEN pretax_income > 0 THEN tax_provision / pretax_income ELSE 0.2 END, 0), 0.45))
      / (coalesce(total_debt, 0) + coalesce(stockholders_equity, 0)) * 100 END AS roic,
    CASE WHEN basic_eps <> 0 AND net_income / basic_eps > 0 THEN net_income / basic_eps END AS shares,
    operating_income / total_revenue * 100 AS operating_margin,
    row_number() OVER (PARTITION BY symbol ORDER BY period_end) AS i, count(*) OVER (PARTITION BY symbol) AS n,
    lag(fiscal_year) OVER w AS pfy, lag(total_revenue) OVER w AS prev_revenue, lag(basic_eps) OVER w AS prev_eps, lag(net_income) OVER w AS prev_income
  FROM ar WINDOW w AS (PARTITION BY symbol ORDER BY period_end)
),
st AS (
  SELECT *,
    max(CASE WHEN coalesce(fiscal_year - pfy = 1 AND total_revenue > prev_revenue, false) THEN 0 ELSE i END) OVER v AS br,
    max(CASE WHEN coalesce(fiscal_year - pfy = 1 AND basic_eps > prev_eps, false) THEN 0 ELSE i END) OVER v AS be,
    max(CASE WHEN coalesce(fiscal_year - pfy = 1 AND net_income > prev_income, false) THEN 0 ELSE i END) OVER v AS bp,
    CASE WHEN prev_income > 0 THEN (net_income / prev_income - 1) * 100 END AS pg
  FROM ap WINDOW v AS (PARTITION BY symbol)
),
one AS (
  SELECT symbol, any_value(n) AS n, any_value(n - br) AS sr, any_value(n - be) AS se, any_value(n - bp) AS sp,
    arg_max(roe, i) FILTER (i = n) AS roe, arg_max(roic, i) FILTER (i = n) AS roic, arg_max(debt_to_equity, i) FILTER (i = n) AS de,
    arg_max(negative_equity, i) FILTER (i = n) AS neg, bool_and(operating_cash_flow > 0) AS cash,
    CASE WHEN n >= 2 THEN avg(gross_margin) FILTER (i > n - greatest(1, n // 2)) >= avg(gross_margin) FILTER (i <= greatest(1, n // 2)) - 1 END AS eg,
    CASE WHEN n >= 2 THEN avg(operating_margin) FILTER (i > n - greatest(1, n // 2)) >= avg(operating_margin) FILTER (i <= greatest(1, n // 2)) - 1 END AS eo,
    CASE WHEN n >= 2 THEN avg(net_margin) FILTER (i > n - greatest(1, n // 2)) >= avg(net_margin) FILTER (i <= greatest(1, n // 2)) - 1 END AS en,
    greatest(1, max(fiscal_year) - min(fiscal_year)) AS yrs, max(fiscal_year) - min(fiscal_year) AS span,
    arg_min(shares, i) FILTER (shares IS NOT NULL) AS s1, arg_max(shares, i) FILTER (shares IS NOT NULL) AS s2, count(shares) AS sn,
    max(total_revenue) FILTER (i = 1) AS r1, max(total_revenue) FILTER (i = n) AS r2, max(net_income) FILTER (i = 1) AS p1, max(net_income) FILTER (i = n) AS p2,
    max(basic_eps) FILTER (i = 1) AS e1, max(basic_eps) FILTER (i = n) AS e2, max(shares) FILTER (i = n) AS sh, max(stockholders_equity) FILTER (i = n) AS eq,
    CASE WHEN count(pg) >= 2 THEN stddev_pop(pg) END AS vol, coalesce(bool_or(net_income < 0) FILTER (i < n), false) AS lost,
    max(net_margin) FILTER (i = n) - max(net_margin) FILTER (i = 1) AS nm, max(debt_to_equity) FILTER (i = n) AS d2,
    arg_min(debt_to_equity, i) FILTER (debt_to_equity IS NOT NULL) AS kd1, arg_max(debt_to_equity, i) FILTER (debt_to_equity IS NOT NULL) AS kd2, count(debt_to_equity) AS kdn
  FROM st GROUP BY symbol, n
),
cg AS (
  SELECT *, CASE WHEN r1 > 0 AND r2 > 0 THEN (pow(r2 / r1, 1.0::DOUBLE / yrs) - 1) * 100 END AS rc, CASE WHEN p1 > 0 AND p2 > 0 THEN (pow(p2 / p1, 1.0::DOUBLE / yrs) - 1) * 100 END AS pc,
    CASE WHEN e1 > 0 AND e2 > 0 THEN (pow(e2 / e1, 1.0::DOUBLE / yrs) - 1) * 100 END AS ec,
    CASE WHEN sn >= 2 THEN (pow(s2 / s1, 1.0::DOUBLE / yrs) - 1) * 100 END AS dil
  FROM one WHERE n >= 2
),
qs AS (
  SELECT *, sr >= 3 AS growth_revenue, se >= 3 AS growth_eps, sp >= 3 AS growth_profit, CASE WHEN neg THEN false ELSE roe >= 15 END AS quality_roe,
    roic >= 10 AS quality_roic, cash AS quality_cash, CASE WHEN neg THEN false ELSE de <= 1.5 END AS quality_debt,
    eg AS efficiency_gross, eo AS efficiency_operating, en AS efficiency_net, dil <= 5 AS management_dilution FROM cg
),
qq AS (
  SELECT *, growth_revenue AND growth_eps AND growth_profit AS stage_growth,
    coalesce(quality_roe, false) AND coalesce(quality_roic, false) AND coalesce(quality_cash, false) AND coalesce(quality_debt, false) AS stage_quality,
    coalesce(efficiency_gross, false) AND coalesce(efficiency_operating, false) AND coalesce(efficiency_net, false) AS stage_efficiency,
    coalesce(management_dilution, false) AS stage_management FROM qs
),
cur AS (
  SELECT symbol, {RC._QUOTE} AS trading, CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 4 = 0 THEN 'USD' ELSE {RC._QUOTE} END AS reporting FROM listing
),
fxr AS (SELECT symbol, trading, reporting, CASE WHEN trading = reporting THEN 1.0 ELSE {RC._RATE.format('trading')} END::DOUBLE AS kf, CASE WHEN trading = reporting THEN 1.0 ELSE {RC._RATE.format('reporting')} END::DOUBLE AS kt FROM cur),
pc AS (
  SELECT a.symbol, a.period_end, a.basic_eps, (SELECT arg_max(b.close, b.date) FROM smooth_bars b WHERE b.symbol = a.symbol AND b.date <= a.period_end) AS px FROM ap a
),
ph AS (SELECT p.symbol, count(*) AS years, avg(round(px / kf * kt / basic_eps, 2)) AS mean_pe FROM pc p JOIN fxr ON fxr.symbol = p.symbol
  WHERE basic_eps > 0 AND px / kf * kt IS NOT NULL GROUP BY 1),
lp AS (SELECT symbol, arg_max(close, date) AS last FROM smooth_bars GROUP BY 1),
fv0 AS (
  SELECT q.*, fxr.trading, fxr.reporting, last / kf * kt AS price, nullif(coalesce(eq, 0) / sh, 0) AS bps, coalesce(ph.years, 0) AS pe_years,
    CASE WHEN ph.years > 0 AND e2 > 0 THEN round(mean_pe * e2, 4) END AS m1, CASE WHEN e2 > 0 AND ec >= 10 THEN round(least(ec, 40) * e2, 4) END AS m2,
    CASE WHEN CAST(substr(q.symbol, 2) AS BIGINT) % 2 = 0 THEN round(((CAST(substr(q.symbol, 2) AS BIGINT) % 10) * 10000.0::DOUBLE + 20000) / kf * kt, 4) END AS m4,
    CAST(substr(q.symbol, 2) AS BIGINT) % 3 = 0 AS business_ok
  FROM qq q JOIN fxr ON fxr.symbol = q.symbol LEFT JOIN ph ON ph.symbol = q.symbol LEFT JOIN lp ON lp.symbol = q.symbol
),
fv1 AS (
  SELECT *, list_filter([m1, m2, m4], lambda x: x IS NOT NULL AND x <> 0) AS est, stage_growth AND stage_quality AND stage_efficiency AND stage_management AS quality_ok,
    CASE WHEN bps > 0 AND price <> 0 THEN price / bps END AS pbv FROM fv0
),
fv2 AS (SELECT *, list_median(est) AS fair, CASE WHEN len(est) > 1 AND list_min(est) > 0 THEN list_max(est) / list_min(est) ELSE 1 END AS spread FROM fv1),
fv3 AS (SELECT *, CASE WHEN fair > 0 AND price <> 0 THEN (fair - price) / fair * 100 END AS mos, spread <= 1.8 AS agree FROM fv2),
fv AS (SELECT *, coalesce(mos >= 20, false) AND agree AS price_ok, fair IS NOT NULL AND agree AS value_ok FROM fv3)"""

_PROF = [S.SMOOTH, S.LISTING, RS.STATEMENTS, RS.FIVE, RS.ratios_sql("five0", "ar"), PROFILE]
_TREND = lambda a, b: f"CASE WHEN n < 2 OR span <= 0 THEN 'none' WHEN ({a} <= 0 AND {b} > 0) OR ({a} > 0 AND {b} <= 0) THEN 'turn' WHEN {a} <= 0 THEN 'none' ELSE 'cagr' END"

SQL = {
    "monthly_records": S.with_(S.SMOOTH, MONTHS) + "SELECT * FROM mr",
    "contribution_plans": S.with_(S.SMOOTH, MONTHS, PLANS, recursive=True)
    + """SELECT symbol, start_date, end_date, months, dca_payments, round(y, 2) AS years, round(invested, 2) AS total_invested, round(ending, 2) AS ending_value,
  round(ending - invested, 2) AS profit, round((ending - invested) / invested * 100, 2) AS total_gain_pct, round(ending / invested, 2) AS wealth_multiple,
  round(rate, 5) AS annualized_return_pct, round((pow(pz / p0, 1 / y) - 1) * 100, 2) AS price_cagr_pct, round(-worst * 100, 2) AS max_monthly_drawdown_pct FROM plans""",
    "long_run_leaders": S.with_(S.SMOOTH, S.LISTING, MONTHS, PLANS, recursive=True)
    + """SELECT row_number() OVER (ORDER BY rate DESC, round(ending, 2) DESC, p.symbol) AS rank, p.symbol, l.market, round(rate, 5) AS annualized_return_pct,
  round(ending, 2) AS ending_value FROM plans p JOIN listing l ON l.symbol = p.symbol WHERE rate >= 0""",
    "leader_counts": S.with_(S.SMOOTH, S.LISTING, MONTHS, PLANS, recursive=True)
    + """SELECT (SELECT count(*) FROM listing) AS universe_count, (SELECT count(*) FROM plans) AS evaluated, (SELECT count(*) FROM plans WHERE rate >= 0) AS qualified,
  0 AS excluded_corporate_actions, (SELECT count(*) FROM listing) - (SELECT count(*) FROM plans) AS insufficient_history""",
    "price_return": S.with_(
        S.SMOOTH,
        f"""
p AS (SELECT symbol, date, CASE WHEN symbol <> 'S7' THEN close * 0.5::DOUBLE ELSE close END AS px FROM smooth_bars),
f AS (SELECT *, px / max(px) OVER ({_W} ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM p),
g AS (SELECT symbol, min(date) AS start_date, max(date) AS end_date, arg_min(px, date) AS a, arg_max(px, date) AS z, min(fall) AS worst FROM f GROUP BY 1)""",
    )
    + """SELECT symbol, start_date, end_date, round((end_date - start_date) / 365.2425::DOUBLE, 2) AS years, round((z / a - 1) * 100, 2) AS total_return_pct,
  round((pow(z / a, 365.2425::DOUBLE / (end_date - start_date)) - 1) * 100, 2) AS annualized_return_pct, round(-worst * 100, 2) AS max_drawdown_pct,
  CASE WHEN symbol = 'S7' THEN 'close' ELSE 'adjusted_close' END AS basis FROM g WHERE end_date > start_date""",
    "asof_period_close": S.with_(S.RAW, RS.STATEMENTS)
    + """SELECT a.symbol, a.fiscal_year, round(b.close, 6) AS close, b.date AS bar_date FROM annual a ASOF LEFT JOIN raw_bars b ON a.symbol = b.symbol AND a.period_end >= b.date""",
    "quality_stages": S.with_(*_PROF)
    + "SELECT symbol, stage_growth, stage_quality, stage_efficiency, stage_management, "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} THEN 'pass' ELSE 'fail' END AS {c}" for c in STATE)
    + ", stage_growth::INT + stage_quality::INT + stage_efficiency::INT + stage_management::INT AS passed_stages, round(roic, 4) AS roic FROM qq",
    "company_types": S.with_(*_PROF)
    + """SELECT symbol, CASE WHEN lost AND p2 > 0 THEN 'turnaround' WHEN pbv < 1 AND (roe IS NULL OR roe < 8) THEN 'asset_play' WHEN vol > 45 THEN 'cyclical'
  WHEN coalesce(rc, pc) >= 20 THEN 'fast_grower' WHEN coalesce(rc, pc) >= 8 THEN 'stalwart' ELSE 'slow_grower' END AS company_type,
  round(rc, 4) AS revenue_cagr, round(pc, 4) AS profit_cagr, round(vol, 4) AS profit_volatility, round(pbv, 2) AS pbv FROM fv""",
    "fair_values": S.with_(*_PROF)
    + """SELECT symbol, price IS NOT NULL AND trading <> reporting AS fx_adjusted, pe_years,
  concat_ws('|', CASE WHEN m1 IS NOT NULL THEN 'historical_pe' END, CASE WHEN m2 IS NOT NULL THEN 'peg' END, CASE WHEN bps IS NOT NULL THEN 'book_value' END,
    CASE WHEN m4 IS NOT NULL THEN 'analyst' END) AS methods, round(list_min(est), 4) AS fair_value_low, round(list_max(est), 4) AS fair_value_high, round(spread, 2) AS spread, agree AS estimates_agree,
  round(mos, 2) AS margin_of_safety_pct, CASE WHEN NOT quality_ok THEN 'avoid' WHEN NOT business_ok THEN 'research' WHEN price_ok THEN 'buy' ELSE 'wait' END AS verdict,
  quality_ok::INT + business_ok::INT + value_ok::INT + price_ok::INT AS passed_checks FROM fv""",
    "growth_snapshot": S.with_(*_PROF)
    + f"""SELECT symbol, span AS years, round(rc, 2) AS revenue_cagr, CASE WHEN p1 > 0 AND p2 > 0 THEN round((p2 / p1 - 1) * 100, 2) END AS income_change,
  {_TREND('p1', 'p2')} AS income_trend, CASE WHEN p1 <= 0 AND p2 > 0 THEN 'ok' WHEN p1 <= 0 OR p2 <= 0 THEN 'bad' WHEN pc >= 0.5 THEN 'ok' WHEN pc <= -0.5 THEN 'bad' ELSE 'warn' END AS income_tone,
  CASE WHEN abs(nm) < 0.5 THEN 'flat' ELSE 'change' END AS margin_trend, round(nm, 2) AS margin_change,
  CASE WHEN kdn < 2 THEN 'unknown' WHEN abs(kd2 - kd1) < 0.05 THEN 'warn' WHEN kd2 < kd1 THEN 'ok' ELSE 'bad' END AS debt_tone FROM fv""",
    "snapshot_assembly": S.with_(S.LISTING, RS.STATEMENTS, "complete AS (SELECT symbol, arg_max(operating_cash_flow, period_end) > 0 AS done FROM annual GROUP BY 1)")
    + f"""SELECT l.symbol, l.market, CASE n % 5 WHEN 0 THEN 'wide' WHEN 1 THEN 'strong' WHEN 2 THEN 'medium' WHEN 3 THEN 'niche' ELSE 'none' END AS moat,
  CASE n % 4 WHEN 0 THEN 'leader' WHEN 1 THEN 'beneficiary' WHEN 2 THEN 'neutral' ELSE 'laggard' END AS ai_trend,
  CASE WHEN n % 2 = 0 THEN (n % 10) * 10000.0::DOUBLE + 20000 ELSE 0 END AS analyst_fair_value, CASE WHEN n % 3 = 0 THEN 'Approved' ELSE 'Watch' END AS research_status,
  n % 3 = 0 AS research_verified, c.done IS NOT NULL AS fundamentals_verified, coalesce(c.done, false) AS financial_history_complete,
  CASE WHEN n % 4 = 0 THEN 'USD' ELSE {RC._QUOTE} END AS reporting_currency, {RC._QUOTE} AS trading_currency
FROM (SELECT *, CAST(substr(symbol, 2) AS BIGINT) AS n FROM listing) l LEFT JOIN complete c ON c.symbol = l.symbol""",
}

SQL["podium"] = f"SELECT * FROM ({SQL['long_run_leaders']}) WHERE rank <= 3"
SQL["leaders_search"] = f"SELECT rank, symbol FROM ({SQL['long_run_leaders']}) JOIN supplier ON 'S' || s_suppkey = symbol WHERE contains(lower(symbol || ' ' || s_name), '#00000001')"
