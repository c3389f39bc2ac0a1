"""Bars, resampling and frame indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.registry import sql as S
from barloom.sources import trade_ticks as T

AS_OF = S.AS_OF


def raw(spark, d):
    return B.daily_bars(T.unit_ticks(spark, d), T.TICK_ORDER)


def smooth(spark, d):
    # The count reads the files' footers only.
    return B.smooth_bars(T.value_ticks(spark, d), rows=T.table(spark, d, "lineitem").count())


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


PRICES = ("open", "high", "low", "close")


def ohlcv_daily(spark, d):
    return _r(raw(spark, d), *PRICES)


def ohlcv_smooth(spark, d):
    return smooth(spark, d)


def ohlcv_weekly(spark, d):
    return _r(B.resample(raw(spark, d), "W", AS_OF), *PRICES)


def ohlcv_monthly(spark, d):
    return _r(B.resample(raw(spark, d), "M", AS_OF), *PRICES)


def completed_bars(spark, d):
    return _r(B.completed(raw(spark, d), AS_OF), *PRICES)


def indicators(spark, d):
    bars = I.with_atr(raw(spark, d))
    w = I.by_symbol()
    out = bars.select(
        "symbol",
        "date",
        I.sma("close", 20).alias("sma20"),
        F.col("true_range"),
        F.col("atr"),
        F.round(I.volume_ratio(20), 6).alias("volume_ratio"),
        I.rolling_high(60).alias("high60"),
        I.rolling_low(35, exclude_latest=False).alias("support"),
        I.rolling_high(30, exclude_latest=False).alias("high30"),
        I.rolling_low(30, exclude_latest=False).alias("low30"),
        I.slope_pct("close", 30).alias("slope30"),
        I.pct_change(F.col("close"), F.lag("close", 1).over(w)).alias("change_pct"),
    )
    return _r(out, "sma20", "true_range", "atr", "high60", "support", "high30", "low30", "slope30", "change_pct")


def pivots(spark, d):
    bars = raw(spark, d)
    return bars.select("symbol", "date", I.pivot_low(5).alias("is_low"), I.pivot_high(4).alias("is_high")).filter(
        "is_low or is_high"
    )


def drawdown(spark, d):
    out = I.with_drawdown(smooth(spark, d), "close")
    return out.groupBy("symbol").agg(F.round(-F.min("drawdown") * 100, 6).alias("max_drawdown_pct"))


def ema_phase(spark, d):
    bars = I.with_ema(smooth(spark, d), [20, 50, 200])
    rn = I.bar_number()
    out = bars.withColumns({"rn": rn, "slope30": I.slope_pct("close", 30)})
    return out.select(
        "symbol",
        "date",
        *[F.round(f"ema{n}", 6).alias(f"ema{n}") for n in (20, 50, 200)],
        I.market_phase(F.col("rn"), F.col("slope30")).alias("phase"),
    )


def ema_blocks(spark, d):
    """Short spans: a history takes several blocks of running sums."""
    bars = I.with_ema(smooth(spark, d), [3, 5])
    return bars.select("symbol", "date", *[F.round(f"ema{n}", 6).alias(f"ema{n}") for n in (3, 5)])


QUERIES = {
    "ohlcv_daily": ohlcv_daily,
    "ohlcv_smooth": ohlcv_smooth,
    "ohlcv_weekly": ohlcv_weekly,
    "ohlcv_monthly": ohlcv_monthly,
    "completed_bars": completed_bars,
    "indicators": indicators,
    "pivots": pivots,
    "max_drawdown": drawdown,
    "ema_phase": ema_phase,
    "ema_blocks": ema_blocks,
}

_OUT = "symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume"
_W = "PARTITION BY symbol ORDER BY date"

SQL = {
    "ohlcv_daily": S.with_(S.RAW) + f"SELECT {_OUT} FROM raw_bars",
    "ohlcv_smooth": S.with_(S.SMOOTH) + "SELECT * FROM smooth_bars",
    "ohlcv_weekly": S.with_(S.RAW, S.resampled("raw_bars", "weekly", "W")) + f"SELECT {_OUT} FROM weekly",
    "ohlcv_monthly": S.with_(S.RAW, S.resampled("raw_bars", "monthly", "M")) + f"SELECT {_OUT} FROM monthly",
    "completed_bars": S.with_(S.RAW) + f"SELECT {_OUT} FROM raw_bars WHERE date < DATE '{AS_OF}'",
    "indicators": S.with_(
        S.RAW,
        f"""
t AS (
  SELECT *, lag(close) OVER ({_W}) AS prev, row_number() OVER ({_W}) AS rn,
    lag(close, 29) OVER ({_W}) AS back29 FROM raw_bars
),
u AS (
  SELECT *, CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr FROM t
)""",
    )
    + f"""
SELECT symbol, date,
  round(avg(close) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS sma20,
  round(tr, 6) AS true_range,
  round(avg(tr) OVER ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS atr,
  round(coalesce(volume / avg(volume) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 1.0), 6) AS volume_ratio,
  round(coalesce(max(high) OVER ({_W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), high), 6) AS high60,
  round(min(low) OVER ({_W} ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 6) AS support,
  round(max(high) OVER ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS high30,
  round(min(low) OVER ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS low30,
  round(CASE WHEN rn > 30 THEN (close - back29) / back29 * 100 ELSE 0 END, 6) AS slope30,
  round((close - prev) / prev * 100, 6) AS change_pct
FROM u""",
    "pivots": S.with_(
        S.RAW,
        f"""
p AS (
  SELECT symbol, date, row_number() OVER ({_W}) AS rn, count(*) OVER (PARTITION BY symbol) AS n,
    low = min(low) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS lo,
    high = max(high) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS hi
  FROM raw_bars
),
q AS (SELECT symbol, date, lo AND rn > 5 AND rn <= n - 5 AS is_low, hi AND rn > 4 AND rn <= n - 4 AS is_high FROM p)""",
    )
    + "SELECT symbol, date, is_low, is_high FROM q WHERE is_low OR is_high",
    "max_drawdown": S.with_(
        S.SMOOTH,
        f"""
x AS (SELECT symbol, close / max(close) OVER ({_W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM smooth_bars)""",
    )
    + "SELECT symbol, round(-min(dd) * 100, 6) AS max_drawdown_pct FROM x GROUP BY symbol",
    "ema_blocks": S.with_(S.SMOOTH, S.numbered("smooth_bars", "nb"), S.ema("nb", "e", (3, 5)), recursive=True)
    + "SELECT b.symbol, b.date, round(ema3, 6) AS ema3, round(ema5, 6) AS ema5 FROM e JOIN nb b ON b.symbol = e.symbol AND b.rn = e.rn",
    "ema_phase": S.with_(
        S.SMOOTH, S.numbered("smooth_bars", "nb"), S.ema("nb", "e"), recursive=True
    )
    + f"""
SELECT symbol, date, round(ema20, 6) AS ema20, round(ema50, 6) AS ema50, round(ema200, 6) AS ema200,
  CASE WHEN rn < 60 THEN 'UNKNOWN'
    WHEN close > ema50 AND ema50 > ema200 AND slope > 2 THEN 'RUN'
    WHEN close < ema50 AND ema50 < ema200 AND slope < -2 THEN 'DOWN'
    WHEN abs(ema20 - ema50) / close < 0.035 THEN 'SW' ELSE 'TRANSITION' END AS phase
FROM (
  SELECT b.symbol, b.date, b.rn, b.close, e.ema20, e.ema50, e.ema200,
    CASE WHEN b.rn > 30 THEN (b.close / lag(b.close, 29) OVER (PARTITION BY b.symbol ORDER BY b.rn) - 1) * 100 ELSE 0 END AS slope
  FROM nb b JOIN e ON b.symbol = e.symbol AND b.rn = e.rn)""",
}
