"""Pattern detectors, cooldown and the event study."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.numeric import scaled_bars
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import patterns as P
from barloom.operators import study as ST
from barloom.plans import event_study as ES
from barloom.registry import sql as S
from barloom.registry.bars import smooth
from barloom.sources import trade_ticks as T

AS_OF = S.AS_OF
WEEKLY = dict(timeframe="W", horizons=(5, 10, 20), cooldown=8)
DAILY = dict(timeframe="D", horizons=(5, 10, 20), cooldown=20)
MONTHLY = dict(timeframe="M", horizons=(3, 6, 12), cooldown=4)


def bars_of(spark, d, timeframe):
    return B.resample(smooth(spark, d), timeframe, AS_OF)


def hits_of(spark, d, timeframe, patterns, keep=None):
    features = P.with_pattern_features(bars_of(spark, d, timeframe), timeframe, patterns)
    return P.detect(features, timeframe, patterns, keep=keep)


def _single(name, timeframe="D"):
    def run(spark, d):
        hits = hits_of(spark, d, timeframe, (name,))
        h = F.col("hits")[0]
        return hits.select(
            "symbol",
            "date",
            h["side"].alias("side"),
            *[F.round(h[c], 5).alias(c) for c in ("score", "confidence")],
            F.round(h["level"], 6).alias("level"),
        )

    return run


def _all_hits(timeframe):
    def run(spark, d):
        hits = hits_of(spark, d, timeframe, P.STUDY_PATTERNS, keep=["close", "ema20", "ema50", "ema200", "vr20", "phase"])
        return hits.select(
            "symbol",
            "date",
            F.concat_ws("|", F.transform("hits", lambda h: h["name"])).alias("patterns"),
            F.round(F.col("hits")[0]["score"], 5).alias("best_score"),
            F.round(P.technical_score(F.col("hits")), 5).alias("technical_score"),
            "phase",
        )

    return run


def bounded_averages(spark, d):
    bars = I.with_ema(smooth(spark, d), [20, 50])
    return bars.select(
        "symbol", "date", *[F.round(I.bounded_ema(f"ema{n}", n, 60), 6).alias(f"ema{n}") for n in (20, 50)]
    )


def cooldown_signals(spark, d):
    hits = hits_of(spark, d, "W", ("breakout", "retest"))
    kept = ST.apply_cooldown(hits.select("symbol", "rn", "date", F.col("hits")[0]["name"].alias("pattern")), 8)
    return kept.select("symbol", "date", "pattern")


def _study(spark, d, **extra):
    return ES.event_study(smooth(spark, d), T.listing(spark, d), as_of=AS_OF, **{**WEEKLY, **extra})


def event_study_events(spark, d):
    return _study(spark, d).events


def event_study_stats(spark, d):
    return _study(spark, d).stats


def event_study_baseline(spark, d):
    return _study(spark, d).baseline


def event_study_edges(spark, d):
    return _study(spark, d).edges.select(
        "pattern", "horizon", "samples", "return_edge_pp", "hit_rate_edge_pp", "baseline_return_pct_net"
    )


def _edges(setting):
    def run(spark, d):
        return _study(spark, d, **setting).edges.select(
            "pattern", "horizon", "samples", "return_edge_pp", "hit_rate_edge_pp", "baseline_return_pct_net"
        )

    return run


def study_places(spark, d):
    """Group summaries in their order: most signals first."""
    places = ST.by_signals(_study(spark, d).stats)
    return places.select("group_kind", "market", "pattern", "horizon", "samples", "place")


def pattern_reasons(spark, d):
    """Label and reasons of every weekly hit, with their numbers."""
    hits = hits_of(spark, d, "W", P.STUDY_PATTERNS).select("symbol", "date", F.explode("hits").alias("h"))
    return hits.select("symbol", "date", "h.name", "h.label", F.array_join("h.reasons", "; ").alias("reasons"))


def pattern_evidence(spark, d):
    return ST.evidence(_study(spark, d).edges, "W").select(
        "pattern", "timeframe", "verdict", "tradeable", "signals", "horizon_bars", "return_edge_pp", "hit_rate_edge_pp"
    )


QUERIES = {
    **{name: _single(name) for name in ("breakout", "retest", "cup_handle", "head_shoulders")},
    "double_bottom": _single("double_bottom"),
    "pattern_hits_weekly": _all_hits("W"),
    "pattern_hits_monthly": _all_hits("M"),
    "ema_bounded_window": bounded_averages,
    "cooldown_signals": cooldown_signals,
    "event_study_events": event_study_events,
    "event_study_stats": event_study_stats,
    "event_study_baseline": event_study_baseline,
    "event_study_edges": event_study_edges,
    "pattern_evidence": pattern_evidence,
    "event_study_daily": _edges(DAILY),
    "event_study_monthly": _edges(MONTHLY),
    "study_places": study_places,
    "pattern_reasons": pattern_reasons,
}


# --- SQL -------------------------------------------------------------------

_W = "PARTITION BY symbol ORDER BY date"


def _n(value, digits=2):
    """A number as reasons print it: halves up, fixed digits."""
    return f"CAST(round(CAST({value} AS DECIMAL(30, 12)), {digits}) AS VARCHAR)"


def _fr(first, last):
    def side(n):
        return "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"

    return f"OVER ({_W} ROWS BETWEEN {side(first)} AND {side(last)})"


def _restarted_ema(window, spans=(20, 50, 200)):
    """Averages over the newest ``window`` bars only."""
    values = ", ".join(f"list_reduce(v, lambda a, b: (b - a) * (2.0::DOUBLE / {n + 1}) + a) AS ema{n}" for n in spans)
    return f"""
em AS (SELECT symbol, rn, {values}
  FROM (SELECT symbol, rn, list(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS v FROM nb))"""


def features_sql(timeframe, base="smooth_bars", ctes=(), window=None):
    """CTEs ending in ``all_hits``: features and one row per hit. ``ctes`` may define ``base``; ``window`` restarts the averages."""
    b = lambda n: scaled_bars(n, timeframe)
    cup = b(170)
    ctes = [S.SMOOTH, *ctes]
    name = base
    if timeframe != "D":
        ctes.append(S.resampled(base, "tf_bars", timeframe))
        name = "tf_bars"
    ctes += [S.numbered(name, "nb"), _restarted_ema(window) if window else S.ema("nb", "em")]
    ctes.append(
        f"""
f0 AS (SELECT b.*, e.ema20, e.ema50, e.ema200 FROM nb b JOIN em e ON b.symbol = e.symbol AND b.rn = e.rn),
f AS (
  SELECT *, count(*) OVER (PARTITION BY symbol) AS n,
    max(high) {_fr(-b(60), -1)} AS hi60,
    coalesce(volume / avg(volume) {_fr(-b(20), -1)}, 1.0) AS vr,
    coalesce(volume / avg(volume) {_fr(-20, -1)}, 1.0) AS vr20,
    max(high) {_fr(-(b(90) - 1), -b(24))} AS base_hi,
    max(close) {_fr(-(b(24) - 1), -1)} AS recent_hi,
    lag(close) OVER ({_W}) AS prev_close,
    CASE WHEN rn > 30 THEN (close / lag(close, 29) OVER ({_W}) - 1) * 100 ELSE 0 END AS slope30,
    max(high) {_fr(-(cup - 1), b(45) - cup)} AS cl, min(low) {_fr(b(45) - cup + 1, b(125) - cup)} AS cb,
    max(high) {_fr(b(125) - cup + 1, b(150) - cup)} AS cr,
    max(high) {_fr(b(150) - cup + 1, -1)} AS hh, min(low) {_fr(b(150) - cup + 1, -1)} AS hl,
    min(low) {_fr(-(b(120) - 1), 0)} AS base_lo, min(close) {_fr(-b(6), -1)} AS confirm_lo,
    max(high) {_fr(-b(60), 0)} AS prior_hi,
    low = min(low) {_fr(-b(5), b(5))} AND rn > {b(5)} AND lead(low, {b(5)}) OVER ({_W}) IS NOT NULL AS is_low,
    high = max(high) {_fr(-b(4), b(4))} AND rn > {b(4)} AND lead(high, {b(4)}) OVER ({_W}) IS NOT NULL AS is_high
  FROM f0
),
breakout AS (
  SELECT symbol, date, rn, 'breakout' AS name, 'BUY' AS side,
    least(95, 58 + (close / hi60 - 1) * 160 + CASE WHEN close > ema200 THEN 8 ELSE 2 END + least(16, greatest(0, (vr - 1) * 18))) AS score,
    least(96, 62 + (close / hi60 - 1) * 100 + least(16, greatest(0, (vr - 1) * 18))) AS confidence, hi60 AS level
  FROM f WHERE rn >= {b(90)} AND close > hi60 * 1.006 AND close > ema50 AND vr >= 1.15 AND (close / hi60 - 1) * 100 <= 15
),
retest AS (
  SELECT symbol, date, rn, 'retest' AS name, 'BUY' AS side,
    least(92, 60 + greatest(0, 1 - abs(close - base_hi) / greatest(base_hi, 0.01)) * 14 + least(13, vr * 5)) AS score,
    least(93, 60 + greatest(0, 1 - abs(close - base_hi) / greatest(base_hi, 0.01)) * 20 + least(10, vr * 4)) AS confidence,
    base_hi AS level
  FROM f WHERE rn >= {b(110)} AND recent_hi > base_hi * 1.008 AND low <= base_hi * 1.035 AND close >= base_hi * 0.985
    AND close > prev_close AND close > base_hi
),
cup_handle AS (
  SELECT symbol, date, rn, 'cup_handle' AS name, 'BUY' AS side,
    least(96, 64 + (cl - cb) / cl * 55 + least(12, vr * 4)) AS score,
    least(95, 62 + (cl - cb) / cl * 50 + least(10, vr * 3)) AS confidence, hh AS level
  FROM f WHERE rn >= {b(180)} AND (cl - cb) / cl BETWEEN 0.12 AND 0.42 AND cr / cl BETWEEN 0.86 AND 1.25
    AND (hh - hl) / hh BETWEEN 0.025 AND 0.18 AND close > hh * 1.005
),
low_pivots AS (SELECT symbol, rn, low, prior_hi FROM f WHERE is_low),
db_bars AS (SELECT * FROM f WHERE rn >= {b(130)} AND vr >= 1 AND close > confirm_lo),
feet AS (
  SELECT c.symbol, c.rn, l.rn AS lrn, l.low AS llow, l.prior_hi, r.rn AS rrn, r.low AS rlow
  FROM db_bars c JOIN low_pivots l ON l.symbol = c.symbol AND l.rn BETWEEN c.rn - {b(120) - 1} AND c.rn - {b(5)}
  JOIN low_pivots r ON r.symbol = c.symbol AND r.rn BETWEEN l.rn + {b(18)} AND c.rn - {b(5)}
  WHERE abs(l.low - r.low) / greatest(l.low, r.low) <= 0.05 AND least(l.low, r.low) <= c.base_lo * 1.06
),
necks AS (
  SELECT d.symbol, d.lrn, d.rrn, max(x.high) AS neck
  FROM (SELECT DISTINCT symbol, lrn, rrn FROM feet) d JOIN f x ON x.symbol = d.symbol AND x.rn BETWEEN d.lrn AND d.rrn
  GROUP BY 1, 2, 3
),
chosen AS (
  SELECT f1.*, k.neck, (k.neck / least(llow, rlow) - 1) * 100 AS depth,
    row_number() OVER (PARTITION BY f1.symbol, f1.rn ORDER BY f1.rrn DESC, f1.lrn) AS pick
  FROM feet f1 JOIN necks k ON k.symbol = f1.symbol AND k.lrn = f1.lrn AND k.rrn = f1.rrn
  WHERE (k.neck / least(llow, rlow) - 1) * 100 >= 8
),
double_bottom AS (
  SELECT c.symbol, c.date, c.rn, 'double_bottom' AS name, 'BUY' AS side,
    least(94, 61 + p.depth * 0.7 + least(12, c.vr * 4)) AS score,
    least(94, 60 + p.depth * 0.65 + least(10, c.vr * 3)) AS confidence, p.neck AS level
  FROM db_bars c JOIN chosen p ON p.symbol = c.symbol AND p.rn = c.rn AND p.pick = 1
  WHERE (p.prior_hi / p.llow - 1) * 100 >= 12 AND c.close > p.neck * 1.005 AND c.confirm_lo <= p.neck * 1.005
    AND (c.close / p.neck - 1) * 100 <= 12
),
high_pivots AS (
  SELECT symbol, rn, high, lag(rn) OVER w AS hrn, lag(high) OVER w AS hhigh, lag(rn, 2) OVER w AS lrn, lag(high, 2) OVER w AS lhigh
  FROM f WHERE is_high WINDOW w AS (PARTITION BY symbol ORDER BY rn)
),
triples AS (
  SELECT t.symbol, t.rn AS rrn, t.lrn, t.hhigh, min(x.low) AS neck
  FROM high_pivots t JOIN f x ON x.symbol = t.symbol AND x.rn BETWEEN t.lrn AND t.rn
  WHERE t.hrn - t.lrn >= {b(10)} AND t.rn - t.hrn >= {b(10)} AND t.hhigh > t.lhigh * 1.04 AND t.hhigh > t.high * 1.04
    AND abs(t.lhigh - t.high) / greatest(t.lhigh, t.high) <= 0.15
  GROUP BY 1, 2, 3, 4
),
shoulder_bars AS (
  SELECT c.symbol, c.date, c.rn, c.close, t.neck, t.hhigh,
    row_number() OVER (PARTITION BY c.symbol, c.rn ORDER BY t.rrn DESC) AS pick
  FROM f c JOIN triples t ON t.symbol = c.symbol AND t.lrn >= c.rn - {b(125) - 1} AND t.rrn <= c.rn - {b(4)}
  WHERE c.rn >= {b(130)}
),
head_shoulders AS (
  SELECT symbol, date, rn, 'head_shoulders' AS name, 'SELL' AS side,
    least(91, 60 + (hhigh - neck) / greatest(neck, 0.01) * 85) AS score,
    least(91, 60 + (hhigh - neck) / greatest(neck, 0.01) * 70) AS confidence, neck AS level
  FROM shoulder_bars WHERE pick = 1 AND close < neck * 0.99
),
all_hits AS (
  SELECT *, 0 AS pos FROM breakout UNION ALL SELECT *, 1 FROM retest UNION ALL SELECT *, 2 FROM cup_handle
  UNION ALL SELECT *, 3 FROM double_bottom UNION ALL SELECT *, 4 FROM head_shoulders
)"""
    )
    return ctes


def _single_sql(name, timeframe="D"):
    return (
        S.with_(*features_sql(timeframe), recursive=True)
        + f"SELECT symbol, date, side, round(score, 5) AS score, round(confidence, 5) AS confidence, round(level, 6) AS level FROM {name}"
    )


_PHASE = """CASE WHEN rn < 60 THEN 'UNKNOWN'
    WHEN close > ema50 AND ema50 > ema200 AND slope30 > 2 THEN 'RUN'
    WHEN close < ema50 AND ema50 < ema200 AND slope30 < -2 THEN 'DOWN'
    WHEN abs(ema20 - ema50) / close < 0.035 THEN 'SW' ELSE 'TRANSITION' END"""


def _all_hits_sql(timeframe):
    return (
        S.with_(
            *features_sql(timeframe),
            f"""
g AS (
  SELECT symbol, rn, string_agg(name, '|' ORDER BY score DESC, pos) AS patterns, max(score) AS best, bool_or(side = 'SELL') AS bearish
  FROM all_hits GROUP BY 1, 2
),
h0 AS (SELECT f.*, g.patterns, g.best, g.bearish FROM f JOIN g ON f.symbol = g.symbol AND f.rn = g.rn),
h AS (SELECT *, {_PHASE} AS phase FROM h0)""",
            recursive=True,
        )
        + """
SELECT symbol, date, patterns, round(best, 5) AS best_score,
  round(least(100, greatest(0, best + CASE WHEN close > ema20 THEN 4 ELSE 0 END + CASE WHEN close > ema50 THEN 6 ELSE 0 END
    + CASE WHEN close > ema200 THEN 7 ELSE 0 END + CASE WHEN vr20 >= 1.35 THEN 6 ELSE 0 END
    + CASE WHEN phase = 'RUN' THEN 5 ELSE 0 END - CASE WHEN bearish THEN 14 ELSE 0 END)), 5) AS technical_score, phase
FROM h"""
    )


def _cooldown_ctes(source, cooldown):
    return f"""
nxt AS (
  SELECT a.symbol, a.rn, min(b.rn) AS next_rn FROM {source} a JOIN {source} b ON a.symbol = b.symbol AND b.rn >= a.rn + {cooldown}
  GROUP BY 1, 2
),
kept AS (
  SELECT symbol, min(rn) AS rn FROM {source} GROUP BY symbol
  UNION ALL
  SELECT k.symbol, n.next_rn FROM kept k JOIN nxt n ON n.symbol = k.symbol AND n.rn = k.rn
)"""


def _study_ctes(timeframe="W", horizons=(5, 10, 20), cooldown=8):
    start, longest = 24 if timeframe == "M" else 90, max(horizons)
    # Only daily histories are longer than the study's window.
    return [
        *features_sql(timeframe, window=P.STUDY_WINDOW if timeframe == "D" else None),
        S.LISTING,
        f"""
long_bars AS (SELECT f.*, l.market FROM f JOIN listing l ON f.symbol = l.symbol WHERE f.n >= {start + longest + 1}),
first_hits AS (
  SELECT h.symbol, h.rn, h.date, l.market, h.name AS pattern, h.side, row_number() OVER (PARTITION BY h.symbol, h.rn ORDER BY h.score DESC, h.pos) AS pick
  FROM all_hits h JOIN long_bars l ON l.symbol = h.symbol AND l.rn = h.rn WHERE h.rn - 1 >= {start} AND h.rn - 1 < l.n - {longest}
),
sig AS (SELECT * FROM first_hits WHERE pick = 1)""",
        _cooldown_ctes("sig", cooldown),
        f"""
horizons AS (SELECT unnest({list(horizons)}) AS horizon),
starts AS (
  SELECT s.symbol, s.rn, s.date, s.market, s.pattern, s.side, CASE WHEN s.side = 'SELL' THEN -1 ELSE 1 END AS dir
  FROM sig s JOIN kept k ON k.symbol = s.symbol AND k.rn = s.rn
),
base_starts AS (SELECT symbol, rn, 1 AS dir FROM long_bars WHERE rn - 1 >= {start} AND rn - 1 < n - {longest} AND (rn - 1 - {start}) % 10 = 0),
paths AS (
  SELECT b.symbol, b.rn, h.horizon, b.close AS entry,
    arg_max(x.close, x.rn) AS exit_close, min(x.low) AS lo, max(x.high) AS hi
  FROM long_bars b JOIN horizons h ON true JOIN long_bars x ON x.symbol = b.symbol AND x.rn BETWEEN b.rn + 1 AND b.rn + h.horizon
  WHERE b.rn + h.horizon <= b.n AND (b.symbol, b.rn) IN (SELECT symbol, rn FROM starts UNION SELECT symbol, rn FROM base_starts)
  GROUP BY 1, 2, 3, 4
),
events_out AS (
  SELECT s.symbol, s.market, s.pattern, s.side, '{timeframe}' AS timeframe, s.date AS signal_date, p.horizon,
    round((exit_close / entry - 1) * 100 * dir, 3) AS return_pct,
    round((exit_close / entry - 1) * 100 * dir - 0.3, 3) AS return_pct_net,
    round((CASE WHEN dir > 0 THEN lo ELSE hi END / entry - 1) * 100 * dir, 3) AS max_drawdown_pct,
    round((CASE WHEN dir > 0 THEN hi ELSE lo END / entry - 1) * 100 * dir, 3) AS max_favourable_pct
  FROM starts s JOIN paths p ON p.symbol = s.symbol AND p.rn = s.rn
),
base_out AS (
  SELECT p.horizon, round((exit_close / entry - 1) * 100 - 0.3, 3) AS return_pct_net, round((lo / entry - 1) * 100, 3) AS max_drawdown_pct
  FROM base_starts s JOIN paths p ON p.symbol = s.symbol AND p.rn = s.rn
)""",
    ]


_STATS = """count(*) AS samples,
  round(sum(CASE WHEN return_pct_net > 0 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 2) AS hit_rate_pct,
  round(avg(return_pct_net), 3) AS average_return_pct_net, round(median(return_pct_net), 3) AS median_return_pct_net,
  max(return_pct_net) AS best_pct, min(return_pct_net) AS worst_pct,
  round(avg(max_drawdown_pct), 3) AS average_max_drawdown_pct, min(max_drawdown_pct) AS worst_max_drawdown_pct"""

_EDGES = f"""
b AS (SELECT horizon, {_STATS} FROM base_out GROUP BY horizon),
s AS (SELECT pattern, horizon, {_STATS} FROM events_out GROUP BY GROUPING SETS ((pattern, horizon), (horizon))),
e AS (
  SELECT s.*, b.average_return_pct_net AS baseline_return_pct_net,
    round(s.average_return_pct_net - b.average_return_pct_net, 3) AS return_edge_pp,
    round(s.hit_rate_pct - b.hit_rate_pct, 2) AS hit_rate_edge_pp
  FROM s LEFT JOIN b ON s.horizon = b.horizon
)"""

SQL = {
    **{name: _single_sql(name) for name in P.STUDY_PATTERNS},
    "pattern_hits_weekly": _all_hits_sql("W"),
    "pattern_hits_monthly": _all_hits_sql("M"),
    "ema_bounded_window": S.with_(
        S.SMOOTH,
        f"x AS (SELECT symbol, date, list(close) OVER ({_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v FROM smooth_bars)",
    )
    + """
SELECT symbol, date, round(list_reduce(v, lambda a, b: (b - a) * (2.0::DOUBLE / 21) + a), 6) AS ema20,
  round(list_reduce(v, lambda a, b: (b - a) * (2.0::DOUBLE / 51) + a), 6) AS ema50 FROM x""",
    "cooldown_signals": S.with_(
        *features_sql("W"),
        """
two AS (SELECT *, row_number() OVER (PARTITION BY symbol, rn ORDER BY score DESC, pos) AS pick FROM all_hits WHERE name IN ('breakout', 'retest')),
sig AS (SELECT * FROM two WHERE pick = 1)""",
        _cooldown_ctes("sig", 8),
        recursive=True,
    )
    + "SELECT s.symbol, s.date, s.name AS pattern FROM sig s JOIN kept k ON s.symbol = k.symbol AND s.rn = k.rn",
    "event_study_events": S.with_(*_study_ctes(), recursive=True) + "SELECT * FROM events_out",
    "event_study_stats": S.with_(*_study_ctes(), recursive=True)
    + f"""
SELECT CASE WHEN GROUPING(pattern) = 0 THEN 'pattern' WHEN GROUPING(market) = 0 THEN 'market' ELSE 'overall' END AS group_kind,
  market, pattern, horizon, {_STATS}, count(*) >= 20 AS reliable
FROM events_out GROUP BY GROUPING SETS ((pattern, horizon), (market, horizon), (horizon))""",
    "event_study_baseline": S.with_(*_study_ctes(), recursive=True)
    + f"SELECT 'baseline' AS group_kind, horizon, {_STATS} FROM base_out GROUP BY horizon",
    "event_study_edges": S.with_(*_study_ctes(), _EDGES, recursive=True)
    + "SELECT pattern, horizon, samples, return_edge_pp, hit_rate_edge_pp, baseline_return_pct_net FROM e",
    **{
        name: S.with_(*_study_ctes(**setting), _EDGES, recursive=True)
        + "SELECT pattern, horizon, samples, return_edge_pp, hit_rate_edge_pp, baseline_return_pct_net FROM e"
        for name, setting in (("event_study_daily", DAILY), ("event_study_monthly", MONTHLY))
    },
    "study_places": S.with_(*_study_ctes(), recursive=True)
    + """
SELECT *, row_number() OVER (PARTITION BY group_kind, horizon ORDER BY samples DESC, pattern NULLS FIRST, market NULLS FIRST) AS place FROM (
  SELECT CASE WHEN GROUPING(pattern) = 0 THEN 'pattern' WHEN GROUPING(market) = 0 THEN 'market' ELSE 'overall' END AS group_kind, market, pattern, horizon, count(*) AS samples
  FROM events_out GROUP BY GROUPING SETS ((pattern, horizon), (market, horizon), (horizon)))""",
    "pattern_reasons": S.with_(*features_sql("W"), recursive=True)
    + f"""
SELECT h.symbol, h.date, h.name,
  CASE h.name WHEN 'breakout' THEN 'Breakout' WHEN 'retest' THEN 'Breakout Retest' WHEN 'cup_handle' THEN 'Cup & Handle' WHEN 'double_bottom' THEN 'Double Bottom' ELSE 'Head & Shoulders' END AS label,
  CASE h.name
    WHEN 'breakout' THEN 'close above the earlier high ' || {_n('f.hi60')} || '; volume ' || {_n('f.vr')} || ' times its average; close above EMA50' || CASE WHEN f.close > f.ema200 THEN '; close above EMA200' ELSE '' END
    WHEN 'retest' THEN 'earlier resistance ' || {_n('f.base_hi')} || ' held as support; close back above the level; volume ' || {_n('f.vr')} || ' times its average'
    WHEN 'cup_handle' THEN 'cup ' || {_n('(f.cl - f.cb) / f.cl * 100', 1)} || '% deep; handle gave back ' || {_n('(f.hh - f.hl) / f.hh * 100', 1)} || '%; close above the handle''s high ' || {_n('f.hh')}
    WHEN 'double_bottom' THEN 'two lows near ' || {_n('least(p.llow, p.rlow)')} || ' after a fall of ' || {_n('(p.prior_hi - p.llow) / p.prior_hi * 100', 1)} || '%; close above the neckline ' || {_n('p.neck')} || '; volume ' || {_n('f.vr')} || ' times its average'
    ELSE 'head at ' || {_n('s.hhigh')} || ' above both shoulders; close below the neckline ' || {_n('s.neck')} || '; bearish: lowers conviction in a long entry' END AS reasons
FROM all_hits h JOIN f ON f.symbol = h.symbol AND f.rn = h.rn LEFT JOIN chosen p ON p.symbol = h.symbol AND p.rn = h.rn AND p.pick = 1
  LEFT JOIN shoulder_bars s ON s.symbol = h.symbol AND s.rn = h.rn AND s.pick = 1""",
    "pattern_evidence": S.with_(*_study_ctes(), _EDGES, recursive=True)
    + """
SELECT pattern, 'W' AS timeframe,
  CASE WHEN samples < 200 THEN 'insufficient' WHEN return_edge_pp >= 0.5 AND hit_rate_edge_pp > 0 THEN 'edge'
    WHEN return_edge_pp > 0 THEN 'marginal' ELSE 'no_edge' END AS verdict,
  samples >= 200 AND return_edge_pp >= 0.5 AND hit_rate_edge_pp > 0 AS tradeable,
  samples AS signals, horizon AS horizon_bars, return_edge_pp, hit_rate_edge_pp
FROM e WHERE pattern IS NOT NULL AND horizon = 20""",
}
