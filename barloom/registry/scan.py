"""Liquidity, currency, valuation, scores, risk and the market scan."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barloom.functions import currency as C
from barloom.operators import filters as FL
from barloom.operators import liquidity as L
from barloom.operators import risk as R
from barloom.operators import scoring as X
from barloom.operators import snapshots as SN
from barloom.operators import statements as ST
from barloom.operators import study as STU
from barloom.operators import valuation as V
from barloom.operators.bars import completed, dealt_by_symbol
from barloom.operators.patterns import STUDY_PATTERNS
from barloom.plans import event_study as ES
from barloom.plans import scan as SC
from barloom.registry import patterns as RP
from barloom.registry import sql as S
from barloom.registry import statements as RS
from barloom.registry.bars import smooth
from barloom.session import cut_lineage, work_folder
from barloom.sources import evidence_store as EV
from barloom.sources import order_statements as O
from barloom.sources import trade_ticks as T
from barloom.sources.sinks import publish_version, read_current

AS_OF = S.AS_OF


def daily(spark, d):
    return completed(smooth(spark, d), AS_OF)


def snapshots(spark, d):
    statements = cut_lineage(O.annual_statements(spark, d))
    fields = ST.snapshot_fields(ST.add_ratios(statements)).drop("as_of")
    # History counts as complete where the newest year has positive operating cash.
    complete = statements.groupBy("symbol").agg(
        (F.max_by("operating_cash_flow", "period_end") > 0).alias("financial_history_complete")
    )
    fields = fields.join(complete, "symbol")
    names = T.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    out = SN.assemble(names, T.listing(spark, d), None, fields, O.reviews(spark, d))
    # Here the suffix is not part of the symbol, so the market decides the currency.
    number = F.substring("symbol", 2, 20).cast("long")
    return out.withColumn("reporting_currency", F.when(number % 4 == 0, "USD").otherwise(F.col("trading_currency")))


def expected_eod(spark, d):
    days = T.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return days.select("date", FL.expected_eod(F.col("date")).alias("expected"))


def eligible_symbols(spark, d):
    rows = FL.eligible(T.listing(spark, d), "th", "g1")
    return rows.select("symbol", "market", "index_groups")


def target_selection(spark, d):
    rows = FL.select_targets(T.listing(spark, d), ["US", "HK"], ["g0", "g2"], limit=20)
    return rows.select("symbol", "market")


def target_selection_all(spark, d):
    rows = FL.select_targets(T.listing(spark, d), ["US", "HK"], ["g0", "g2"])
    return rows.select("symbol", "market")


def liquidity(spark, d):
    rows = L.tail_metrics(daily(spark, d)).join(T.listing(spark, d), "symbol")
    out = L.with_liquidity(rows, O.fx_rates(spark, d))
    return out.select(
        "symbol", "market", "currency", "turnover", "turnover_usd", "liquidity_score", "liquidity_verified",
        F.round("atr", 5).alias("atr"), "support", "resistance", "last_price", "price_as_of",
    )


def currencies(spark, d):
    rows = T.listing(spark, d)
    symbol = F.concat("symbol", "suffix")
    return rows.select(
        symbol.alias("symbol"), C.trading_currency(symbol, F.col("market")).alias("currency"), C.price_scale(symbol).alias("scale")
    )


def fx_conversion(spark, d):
    fx = O.fx_rates(spark, d)
    rows = O.currencies(spark, d).join(T.listing(spark, d).select("symbol", "account_balance"), "symbol")
    rows = C.with_rate(C.with_rate(rows, fx, "trading_currency", "a"), fx, "reporting_currency", "b")
    amount = C.convert(F.col("account_balance"), F.col("trading_currency"), F.col("reporting_currency"), F.col("a"), F.col("b"))
    return rows.select("symbol", "trading_currency", "reporting_currency", F.round(amount, 6).alias("converted"))


def _valued(spark, d):
    rows = snapshots(spark, d).drop("liquidity_score").join(L.tail_metrics(daily(spark, d)), "symbol")
    return V.derive_valuation(L.with_liquidity(rows, O.fx_rates(spark, d)), O.fx_rates(spark, d))


def valuation(spark, d):
    return _valued(spark, d).select(
        "symbol", "trading_currency", "reporting_currency", "pe", "pbv", "upside_pct", "fx_adjusted", "fx_rate",
        "valuation_verified", "valuation_note",
    )


def scores(spark, d):
    rows = _valued(spark, d)
    out = rows.withColumns(
        {
            "financial_score": X.financial_score(),
            "business_score": X.business_score(),
            "valuation_score": X.valuation_score(),
            "verification_level": X.verification_level(),
        }
    )
    level = F.col("verification_level")
    final = X.final_score(
        level, F.lit(80.0), F.when(F.col("fundamentals_verified"), F.col("financial_score")).otherwise(0.0),
        F.col("valuation_score"), F.when(F.col("research_verified"), F.col("business_score")).otherwise(0.0), F.lit(False),
    )
    out = out.withColumn("final_score", final)
    return out.select(
        "symbol", "financial_score", "business_score", "valuation_score", "verification_level",
        X.score_cap(level).alias("score_cap"), F.round("final_score", 5).alias("final_score"),
        X.grade(F.col("final_score"), level == "full").alias("grade"), X.valuation_verdict(F.col("valuation_score")).alias("verdict"),
        F.size(X.financial_warnings()).alias("financial_warnings"), F.size(X.valuation_warnings()).alias("valuation_warnings"),
    )


def _risk(bearish):
    def run(spark, d):
        rows = L.tail_metrics(daily(spark, d))
        plan = R.risk_plan(F.col("last_price"), F.col("atr"), F.col("support"), F.col("resistance"), F.lit(bearish))
        p = rows.select("symbol", plan.alias("p"))
        return p.select(
            "symbol", "p.bias", *[F.round(f"p.{c}", 6).alias(c) for c in ("entry", "stop", "reward_risk", "risk_pct")],
            *[F.round(F.col("p.targets")[i], 6).alias(f"target{i + 1}") for i in range(3)],
        )

    return run


_folders: dict[tuple[str, str, str], str] = {}


def _once(spark, d, name, make):
    """A folder that is written once in a session for each input folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _folders:
        folder = work_folder(spark, name)
        make(folder)
        _folders[key] = folder
    return _folders[key]


def _written(spark, d, name, make):
    """A table that is written once in a session, as read from its folder."""
    return spark.read.parquet(_once(spark, d, name, lambda folder: make(spark, d).write.parquet(folder)))


def _bars(spark, d):
    """The daily bars, which the study, the scan and the details read, in bounded tasks by symbol."""
    bars = _written(spark, d, "bars", smooth)
    return dealt_by_symbol(bars, bars.count())


def _evidence_folder(spark, d):
    """Where the weekly study's evidence lies; the first that asks runs the study, as a nightly job would."""

    def make(folder):
        edges = ES.event_study(_bars(spark, d), T.listing(spark, d), as_of=AS_OF, **RP.WEEKLY).edges
        EV.write_evidence(STU.evidence(edges, "W"), folder, "W", AS_OF)

    return _once(spark, d, "evidence", make)


def stored_evidence(spark, d):
    """Evidence as the store gives it ten days later, and what it gives when the study is too old: nothing."""
    folder = _evidence_folder(spark, d)
    rows = EV.read_evidence(spark, folder, "W", "2001-11-12").unionByName(EV.read_evidence(spark, folder, "W", "2002-06-30"))
    rows = rows.unionByName(EV.read_evidence(spark, folder, "W", "2001-11-01")).unionByName(EV.read_evidence(spark, folder, "M", AS_OF))
    return rows.select("pattern", "timeframe", "verdict", "tradeable", "signals", "horizon_bars", "return_edge_pp", "hit_rate_edge_pp", "measured_on")


def _inputs(spark, d):
    """What a scan reads: bars, snapshots and rates, each written once."""
    return [_bars(spark, d), _written(spark, d, "snapshots", snapshots), _written(spark, d, "rates", O.fx_rates)]


def _scan(spark, d, detail=False, patterns=STUDY_PATTERNS, measured=AS_OF, **limits):
    bars, snaps, rates = _inputs(spark, d)
    evidence = EV.read_evidence(spark, _evidence_folder(spark, d), "W", measured)
    rows = SC.scan_market(
        bars, snaps, rates, evidence, as_of=AS_OF, patterns=patterns, timeframe="W", detail=detail, in_order=False, **{"min_score": 0.0, "min_liquidity": 0.0, **limits}
    )
    return SC.ranked(cut_lineage(rows))


def published_scan(spark, d):
    """The scan's result as a published table, which the overview, the counts, the details and the export read."""
    folder = _once(spark, d, "scan", lambda folder: publish_version(_scan(spark, d, detail=True), folder, AS_OF))
    return read_current(spark, folder)


def market_scan(spark, d):
    out = _scan(spark, d)
    return out.select(
        "symbol", "market", "market_phase", *[F.round(c, 5).alias(c) for c in ("technical_score", "final_score")],
        "fundamental_score", "business_score", "valuation_score", "grade", "decision", "verification_level",
        F.concat_ws("|", F.transform("patterns", lambda h: h["name"])).alias("patterns"),
        F.round("risk_plan.stop", 5).alias("stop"), F.col("evidence.verdict").alias("evidence"), "price_is_fresh",
        F.size("warnings").alias("warnings"),
    )


def scan_detail(spark, d):
    """Scan rows with the nested insights and summary flattened to a few checks."""
    out = published_scan(spark, d)
    return out.select(
        "symbol", F.size("insights").alias("insights"), F.col("insights")[0]["label"].alias("technical_label"),
        F.col("insights")[1]["label"].alias("financial_label"), F.col("decision_summary.technical.pass").alias("technical_pass"),
        F.col("decision_summary.risk.wide").alias("wide_risk"),
    )


def scan_overview(spark, d):
    out = SC.scan_overview(published_scan(spark, d))
    return out.withColumn("best_score", F.round("best_score", 5))


def symbol_detail(spark, d):
    results = published_scan(spark, d)
    bars = _written(spark, d, "bars", smooth)
    rows = SC.symbol_detail(results, completed(bars, AS_OF), T.listing(spark, d))
    return rows.select("symbol", "date", F.round("close", 6).alias("close"), F.round("result.final_score", 5).alias("final_score"), F.col("snapshot.name").alias("name"))


def verification_counts(spark, d):
    return SC.verification_counts(published_scan(spark, d))


QUERIES = {
    "expected_eod": expected_eod,
    "eligible_symbols": eligible_symbols,
    "target_selection": target_selection,
    "target_selection_all": target_selection_all,
    "liquidity_profile": liquidity,
    "trading_currency": currencies,
    "fx_conversion": fx_conversion,
    "valuation": valuation,
    "scores": scores,
    "risk_plan_long": _risk(False),
    "risk_plan_bearish": _risk(True),
    "market_scan": market_scan,
    "scan_detail": scan_detail,
    "scan_overview": scan_overview,
    "verification_counts": verification_counts,
    "symbol_detail": symbol_detail,
    "stored_evidence": stored_evidence,
}

_DAY = f"done AS (SELECT * FROM smooth_bars WHERE date < DATE '{AS_OF}')"

TAIL = """
tail AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS back,
    lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM done
),
tm AS (
  SELECT symbol, coalesce(median(close * volume) FILTER (back < 60 AND volume > 0 AND close > 0), 0) AS turnover,
    avg(CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END) FILTER (back < 14) AS atr,
    min(low) FILTER (back < 35) AS support,
    coalesce(max(high) FILTER (back BETWEEN 1 AND 60), max(high) FILTER (back = 0)) AS resistance,
    max(close) FILTER (back = 0) AS last_price, max(date) AS price_as_of
  FROM tail GROUP BY symbol
)"""

_QUOTE = "CASE market WHEN 'US' THEN 'USD' WHEN 'TH' THEN 'THB' WHEN 'HK' THEN 'HKD' WHEN 'CN' THEN 'CNY' ELSE 'GBP' END"
_RATE = "CASE {0} WHEN 'USD' THEN 1.0 WHEN 'THB' THEN 32.0 WHEN 'HKD' THEN 7.8 WHEN 'GBP' THEN 0.78 END::DOUBLE"


def _score_case():
    parts = []
    anchors = L.TURNOVER_SCORES
    for (a, x), (b, y) in zip(anchors, anchors[1:]):
        parts.append(
            f"WHEN usd < {b} THEN round({x}::DOUBLE + (ln(usd) - ln({a})) / (ln({b}) - ln({a})) * ({y}::DOUBLE - {x}::DOUBLE), 1)"
        )
    return f"CASE WHEN usd IS NULL OR usd <= 0 THEN 0 WHEN usd <= 20000 THEN round(usd * 5 / 20000, 1) {' '.join(parts)} ELSE 100 END"


LIQ = f"""
lq AS (
  SELECT tm.*, l.market, {_QUOTE} AS currency, turnover / ({_RATE.format('(' + _QUOTE + ')')}) AS usd FROM tm JOIN listing l ON l.symbol = tm.symbol
)"""

SNAPS = f"""
complete AS (SELECT symbol, arg_max(operating_cash_flow, period_end) > 0 AS done FROM annual GROUP BY 1),
rv AS (
  SELECT 'S' || s_suppkey AS symbol, s_suppkey AS n,
    CASE s_suppkey % 5 WHEN 0 THEN 24 WHEN 1 THEN 20 WHEN 2 THEN 14 WHEN 3 THEN 12 ELSE 8 END AS moat_points,
    CASE s_suppkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 15 WHEN 2 THEN 5 ELSE 0 END AS trend_points,
    CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 10) * 10000.0::DOUBLE + 20000 ELSE 0 END AS fair, s_suppkey % 3 = 0 AS research
  FROM supplier
),
sn0 AS (
  SELECT s.*, c.done AS history, lq.market, lq.currency AS trading, CASE WHEN n % 4 = 0 THEN 'USD' ELSE lq.currency END AS reporting,
    lq.last_price, lq.usd, {_score_case()} AS liq, rv.moat_points, rv.trend_points, rv.fair, rv.research
  FROM snap s JOIN complete c ON c.symbol = s.symbol JOIN lq ON lq.symbol = s.symbol JOIN rv ON rv.symbol = s.symbol
),
sn1 AS (
  SELECT *, CASE WHEN trading = reporting THEN last_price ELSE last_price / {_RATE.format('trading')} * {_RATE.format('reporting')} END AS px FROM sn0
),
sn2 AS (
  SELECT *, CASE WHEN eps > 0 THEN round(px / eps, 2) END AS pe,
    CASE WHEN book_value_per_share > 0 THEN round(px / book_value_per_share, 2) END AS pbv,
    CASE WHEN fair <> 0 AND last_price <> 0 THEN round((fair / last_price - 1) * 100, 2) END AS up
  FROM sn1
),
sn3 AS (SELECT *, px IS NOT NULL AND (pe IS NOT NULL OR pbv IS NOT NULL) AS valued, (revenue_growth + profit_growth) / 2 AS growth FROM sn2),
sn4 AS (
  SELECT *,
    greatest(0, least(100, CASE WHEN roe >= 20 THEN 22 WHEN roe >= 12 THEN 15 ELSE 5 END + CASE WHEN roa >= 8 THEN 14 WHEN roa >= 4 THEN 8 ELSE 0 END
      + CASE WHEN debt_to_equity <= 0.8 THEN 16 WHEN debt_to_equity <= 1.8 THEN 9 ELSE 2 END
      + CASE WHEN growth >= 15 THEN 20 WHEN growth >= 5 THEN 12 WHEN growth >= 0 THEN 6 ELSE 0 END
      + CASE WHEN net_margin >= 18 THEN 15 WHEN net_margin >= 8 THEN 9 ELSE 0 END + CASE WHEN liq >= 70 THEN 13 WHEN liq >= 40 THEN 7 ELSE 0 END))::DOUBLE AS fin,
    least(100, 44 + moat_points + trend_points)::DOUBLE AS biz,
    CASE WHEN NOT valued THEN 0 ELSE greatest(0, least(100, 50
      + CASE WHEN pe IS NULL THEN -8 WHEN pe <= 12 THEN 18 WHEN pe <= 20 THEN 12 WHEN pe <= 32 THEN 5 ELSE -6 END
      + CASE WHEN pe IS NULL OR growth <= 0 THEN 0 WHEN pe / growth <= 1 THEN 8 WHEN pe / growth > 2.5 THEN -4 ELSE 0 END
      + CASE WHEN pbv IS NULL THEN 0 WHEN pbv <= 1.5 THEN 12 WHEN pbv <= 3 THEN 8 WHEN pbv <= 6 THEN 2 ELSE -6 END
      + CASE WHEN up IS NULL THEN 0 WHEN up >= 25 THEN 20 WHEN up >= 10 THEN 12 WHEN up < 0 THEN -12 ELSE 0 END)) END::DOUBLE AS val,
    CASE WHEN history AND valued AND research THEN 'full' WHEN history AND valued THEN 'valuation' WHEN history THEN 'financial' ELSE 'financial_partial' END AS level,
    (roe < 12)::INT + (roa < 4)::INT + (debt_to_equity > 1.8)::INT + (growth < 0)::INT + (net_margin < 8)::INT + (liq < 40)::INT AS fw,
    CASE WHEN NOT valued THEN 0 ELSE (pe IS NULL OR pe > 32)::INT + coalesce(growth > 0 AND pe / growth > 2.5, false)::INT
      + (pbv IS NULL OR pbv > 6)::INT + coalesce(up < 0, false)::INT END AS vw
  FROM sn3
)"""

_CAP = "CASE level WHEN 'full' THEN 100 WHEN 'valuation' THEN 90 WHEN 'financial' THEN 82 ELSE 78 END::DOUBLE"


def _final(tech):
    return f"""least({_CAP}, CASE level WHEN 'full' THEN {tech} * 0.38 + fin * 0.27 + val * 0.20 + CASE WHEN research THEN biz ELSE 0 END * 0.15
    WHEN 'valuation' THEN {tech} * 0.46 + fin * 0.32 + val * 0.22 WHEN 'financial' THEN {tech} * 0.60 + fin * 0.40 ELSE {tech} * 0.65 + fin * 0.35 END)"""


_GRADE = "CASE WHEN level = 'full' THEN '' ELSE 'T-' END || CASE WHEN final >= 88 THEN 'A+' WHEN final >= 78 THEN 'A' WHEN final >= 68 THEN 'B' WHEN final >= 58 THEN 'C' ELSE 'D' END"
_VERDICT = f"CASE WHEN NOT valued THEN '{X.VERDICTS['unverified']}' WHEN val >= 72 THEN '{X.VERDICTS['cheap']}' WHEN val >= 55 THEN '{X.VERDICTS['fair']}' ELSE '{X.VERDICTS['dear']}' END"
_BASE = [S.SMOOTH, S.LISTING, _DAY, TAIL, LIQ]
_SNAP = [RS.STATEMENTS, RS.ratios_sql("annual", "ar"), RS.SNAPSHOT, SNAPS]

_STOPS = """
r0 AS (SELECT *, greatest(atr, last_price * 0.015) AS u FROM tm),
r1 AS (SELECT *, least(last_price - u * 1.4, greatest(support, last_price - u * 3)) AS long_stop,
  least(greatest(resistance, last_price + u * 1.4), last_price + u * 3) AS short_stop FROM r0),
r2 AS (SELECT *, greatest(last_price - long_stop, u * 0.5) AS long_risk, greatest(short_stop - last_price, u) AS short_risk FROM r1),
r3 AS (SELECT *, list_sort([greatest(resistance, last_price + long_risk * 1.5), last_price + long_risk * 2.2, last_price + long_risk * 3]) AS lt,
  list_reverse_sort([greatest(0.01, support), greatest(0.01, last_price - short_risk * 1.5), greatest(0.01, last_price - short_risk * 2.2)]) AS st FROM r2)"""


def _risk_sql(bearish):
    side, bias = ("short", "Risk-off / avoid long") if bearish else ("long", "Long candidate")
    t = "st" if bearish else "lt"
    rr = "3.0::DOUBLE" if bearish else "(lt[3] - last_price) / long_risk"
    return (
        S.with_(S.SMOOTH, _DAY, TAIL, _STOPS)
        + f"""SELECT symbol, '{bias}' AS bias, round(last_price, 6) AS entry, round({side}_stop, 6) AS stop, round({rr}, 6) AS reward_risk,
  round({side}_risk / last_price * 100, 6) AS risk_pct, round({t}[1], 6) AS target1, round({t}[2], 6) AS target2, round({t}[3], 6) AS target3 FROM r3"""
    )


def scan_ctes(own=""):
    """All CTEs of the scan; ``own`` defines ``scan_own``, hits of one more pattern."""
    study = RP._study_ctes()
    scan = RP.features_sql("W", base="done")[1:]
    names = (
        "tf_bars_all tf_bars nb em f0 f breakout retest cup_handle low_pivots db_bars feet necks chosen double_bottom high_pivots "
        "triples shoulder_bars head_shoulders all_hits"
    ).split()
    text = ",".join(scan)
    for name in names:
        # Names are CTE references unless quoted or aliased as a column.
        text = re.sub(rf"(?<=FROM )({name})\b|(?<=JOIN )({name})\b|(?m:^)({name})(?= AS \()", f"scan_{name}", text)
    if own:
        text = text.replace("scan_all_hits AS (", own.strip() + ",\nscan_all_hits AS (").replace("*, 4 FROM scan_head_shoulders", "*, 4 FROM scan_head_shoulders UNION ALL SELECT *, 5 FROM scan_own")
    return [*study, RP_EDGES, _DAY, TAIL, LIQ, *_SNAP, text, _STOPS, _SCAN]


RP_EDGES = RP._EDGES

_SCAN = f"""
ev AS (
  SELECT pattern, CASE WHEN samples < 200 THEN 'insufficient' WHEN return_edge_pp >= 0.5 AND hit_rate_edge_pp > 0 THEN 'edge'
    WHEN return_edge_pp > 0 THEN 'marginal' ELSE 'no_edge' END AS verdict, return_edge_pp
  FROM e WHERE pattern IS NOT NULL AND horizon = 20
),
last_hits AS (
  SELECT h.*, row_number() OVER (PARTITION BY h.symbol ORDER BY h.score DESC, h.pos) AS ord
  FROM scan_all_hits h JOIN scan_f f ON f.symbol = h.symbol AND f.rn = h.rn AND f.rn = f.n AND f.n >= 90
),
best_ev AS (
  SELECT h.symbol, coalesce(ev.verdict, 'unmeasured') AS verdict, row_number() OVER (PARTITION BY h.symbol ORDER BY
    CASE WHEN ev.verdict = 'edge' THEN 2 WHEN ev.verdict IS NOT NULL THEN 1 ELSE 0 END DESC,
    CASE WHEN ev.verdict = 'edge' THEN return_edge_pp ELSE coalesce(nullif(return_edge_pp, 0), -999) END DESC, ord) AS pick
  FROM last_hits h LEFT JOIN ev ON ev.pattern = h.name
),
hit AS (
  SELECT symbol, string_agg(name, '|' ORDER BY ord) AS patterns, max(score) AS best, bool_or(side = 'SELL') AS bearish FROM last_hits GROUP BY 1
),
lf AS (SELECT *, {RP._PHASE} AS phase FROM scan_f WHERE rn = n),
sc0 AS (
  SELECT n.*, h.patterns, h.bearish, b.verdict, lf.phase,
    least(100, greatest(0, h.best + (lf.close > lf.ema20)::INT * 4 + (lf.close > lf.ema50)::INT * 6 + (lf.close > lf.ema200)::INT * 7
      + (lf.vr20 >= 1.35)::INT * 6 + (lf.phase = 'RUN')::INT * 5 - h.bearish::INT * 14)) AS tech,
    CASE WHEN h.bearish THEN r.short_stop ELSE r.long_stop END AS stop, r.price_as_of >= DATE '2001-11-01' AS fresh
  FROM hit h JOIN sn4 n ON n.symbol = h.symbol JOIN best_ev b ON b.symbol = h.symbol AND b.pick = 1
    JOIN lf ON lf.symbol = h.symbol JOIN r3 r ON r.symbol = h.symbol
),
sc1 AS (SELECT *, CASE WHEN bearish THEN least(62, {_final('tech')}) ELSE {_final('tech')} END AS final FROM sc0),
sc AS (
  SELECT *, {_GRADE} AS grade,
    fw + vw + bearish::INT + (fin < 55)::INT + (NOT history)::INT + (NOT valued)::INT + (NOT research)::INT + (verdict <> 'edge')::INT + (NOT fresh)::INT
      + (level <> 'full')::INT + coalesce(round(usd, 2) <> 0 AND round(usd, 2) < 1000000, false)::INT AS warnings
  FROM sc1
),
sd AS (
  SELECT *, CASE WHEN NOT fresh THEN '{X.DECISIONS['stale_price']}' WHEN bearish THEN '{X.DECISIONS['bearish']}' WHEN NOT history THEN '{X.DECISIONS['need_history']}'
    WHEN NOT valued THEN '{X.DECISIONS['need_valuation']}' WHEN NOT research THEN '{X.DECISIONS['need_research']}'
    WHEN final >= 82 AND warnings = 0 AND verdict = 'edge' THEN 'Candidate' WHEN final >= 72 THEN 'Watchlist'
    WHEN final >= 60 THEN 'Needs confirmation' ELSE 'Reject' END AS decision FROM sc
)"""

SQL = {
    "expected_eod": """SELECT date, CASE WHEN isodow(date - 1) = 7 THEN date - 3 WHEN isodow(date - 1) = 6 THEN date - 2 ELSE date - 1 END AS expected
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)""",
    "eligible_symbols": S.with_(S.LISTING)
    + "SELECT symbol, market, index_groups FROM listing WHERE market = 'TH' AND list_contains(string_split(index_groups, '|'), 'G1')",
    "target_selection": S.with_(S.LISTING)
    + "SELECT symbol, market FROM listing WHERE market IN ('US', 'HK') AND (index_groups LIKE '%|G0' OR index_groups LIKE '%|G2') ORDER BY symbol LIMIT 20",
    "target_selection_all": S.with_(S.LISTING)
    + "SELECT symbol, market FROM listing WHERE market IN ('US', 'HK') AND (index_groups LIKE '%|G0' OR index_groups LIKE '%|G2')",
    "liquidity_profile": S.with_(*_BASE)
    + f"""SELECT symbol, market, currency, round(turnover, 2) AS turnover, round(usd, 2) AS turnover_usd, {_score_case()} AS liquidity_score,
  usd IS NOT NULL AS liquidity_verified, round(atr, 5) AS atr, support, resistance, last_price, price_as_of FROM lq""",
    "trading_currency": S.with_(S.LISTING)
    + f"SELECT symbol || suffix AS symbol, {_QUOTE} AS currency, CASE WHEN suffix = '.L' THEN 0.01 ELSE 1.0 END::DOUBLE AS scale FROM listing",
    "fx_conversion": S.with_(
        S.LISTING,
        f"c AS (SELECT symbol, account_balance, {_QUOTE} AS t, CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 4 = 0 THEN 'USD' ELSE {_QUOTE} END AS r FROM listing)",
    )
    + f"""SELECT symbol, t AS trading_currency, r AS reporting_currency,
  round(CASE WHEN t = r THEN account_balance ELSE account_balance / {_RATE.format('t')} * {_RATE.format('r')} END, 6) AS converted FROM c""",
    "valuation": S.with_(*_BASE, *_SNAP)
    + """SELECT symbol, trading AS trading_currency, reporting AS reporting_currency, pe, pbv, up AS upside_pct,
  px IS NOT NULL AND trading <> reporting AS fx_adjusted, CASE WHEN trading <> reporting THEN round(px / last_price, 6) END AS fx_rate,
  valued AS valuation_verified, CASE WHEN px IS NULL THEN 'no_exchange_rate' WHEN NOT valued THEN 'no_eps_or_equity' WHEN pe IS NULL THEN 'book_value_only'
    WHEN trading <> reporting THEN 'converted_to_reporting_currency' ELSE 'same_currency' END AS valuation_note FROM sn4""",
    "scores": S.with_(*_BASE, *_SNAP, f"fs AS (SELECT *, {_final('80.0::DOUBLE')} AS final FROM sn4)")
    + f"""SELECT symbol, fin AS financial_score, biz AS business_score, val AS valuation_score, level AS verification_level, {_CAP} AS score_cap,
  round(final, 5) AS final_score, {_GRADE} AS grade, {_VERDICT} AS verdict, fw AS financial_warnings, vw AS valuation_warnings FROM fs""",
    "risk_plan_long": _risk_sql(False),
    "risk_plan_bearish": _risk_sql(True),
    "market_scan": S.with_(*scan_ctes(), recursive=True)
    + """SELECT symbol, market, phase AS market_phase, round(tech, 5) AS technical_score, round(final, 5) AS final_score, fin AS fundamental_score,
  CASE WHEN research THEN biz ELSE 0 END AS business_score, val AS valuation_score, grade, decision, level AS verification_level, patterns,
  round(stop, 5) AS stop, verdict AS evidence, fresh AS price_is_fresh, warnings FROM sd""",
    "scan_detail": S.with_(*scan_ctes(), recursive=True)
    + """SELECT sd.symbol, 5 AS insights, CASE WHEN tech >= 78 THEN 'A setup' WHEN tech >= 58 THEN 'Watch' ELSE 'Weak' END AS technical_label,
  CASE WHEN fin >= 75 THEN 'Strong' WHEN fin >= 55 THEN 'Check' ELSE 'Weak' END AS financial_label, NOT bearish AS technical_pass,
  CASE WHEN bearish THEN short_risk ELSE long_risk END / r3.last_price * 100 > 12 AS wide_risk FROM sd JOIN r3 ON r3.symbol = sd.symbol""",
    "scan_overview": S.with_(
        *scan_ctes(),
        "bm AS (SELECT market, count(*) AS n, max(final) AS best FROM sd GROUP BY 1)",
        recursive=True,
    )
    + """SELECT (SELECT count(*) FROM sd) AS results, round((SELECT max(final) FROM sd), 5) AS best_score,
  (SELECT count(*) FROM sd WHERE grade IN ('A', 'A+')) AS top_grades, (SELECT market FROM bm ORDER BY n DESC, best DESC, market LIMIT 1) AS busiest_market""",
}

SQL["verification_counts"] = f"""SELECT l.level, count(m.symbol) AS results FROM (VALUES {", ".join(f"('{k}')" for k in X.LEVELS)}) AS l(level)
LEFT JOIN ({SQL["market_scan"]}) m ON m.verification_level = l.level GROUP BY 1"""
SQL["symbol_detail"] = S.with_(S.SMOOTH, S.LISTING, f"m AS ({SQL['market_scan']})", f"""
t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM smooth_bars WHERE date < DATE '{AS_OF}')""") + """
SELECT t.symbol, t.date, round(t.close, 6) AS close, m.final_score, l.name FROM t JOIN m ON m.symbol = t.symbol JOIN listing l ON l.symbol = t.symbol WHERE back <= 180"""
SQL["stored_evidence"] = f"SELECT *, DATE '{AS_OF}' AS measured_on FROM ({RP.SQL['pattern_evidence']})"
