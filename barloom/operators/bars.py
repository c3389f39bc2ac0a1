"""Building and resampling OHLCV bars.

A bar table has ``symbol, date, open, high, low, close, volume`` and one row per
(symbol, date). Raw ticks are always reduced to that grain first, with map-side
partial aggregation, so a symbol that owns a third of all ticks costs no more in
the later per-symbol windows than any other: its bars are bounded by the number
of calendar days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

OHLCV = ["symbol", "date", "open", "high", "low", "close", "volume"]
TIMEFRAMES = ("D", "W", "M")
_TRUNC = {"W": "week", "M": "month"}


def check_timeframe(value: str | None) -> str:
    timeframe = (value or "D").upper()
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"timeframe must be one of {TIMEFRAMES}, got {value!r}")
    return timeframe


def period_start(date: Column, timeframe: str) -> Column:
    """First day of the ISO week or calendar month that holds ``date``."""
    timeframe = check_timeframe(timeframe)
    if timeframe == "D":
        return date
    return F.date_trunc(_TRUNC[timeframe], date).cast("date")


def daily_bars(ticks: DataFrame, order: list[str]) -> DataFrame:
    """Ticks ``symbol, ts, price, size`` to daily bars.

    ``order`` must order the ticks of one day totally; ``price`` breaks what is
    left. The aggregate is partial on the map side, so hot symbols do not skew
    the shuffle.
    """
    key = F.struct(*[F.col(c) for c in order], F.col("price"), F.col("size"))
    return (
        ticks.select("symbol", F.col("ts").cast("date").alias("date"), "price", "size", key.alias("k"))
        .groupBy("symbol", "date")
        .agg(
            F.min("k")["price"].alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max("k")["price"].alias("close"),
            F.sum("size").alias("volume"),
        )
        .select(*OHLCV)
    )


#: Ticks or bars that a task takes through the windows by symbol, about.
ROWS_PER_TASK = 400_000


def dealt_by_symbol(table: DataFrame, rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``table`` in partitions by symbol whose number grows with ``rows``, so that a task's sorts and windows do not.

    The windows that follow share this exchange. The session's shuffle partitions
    do not matter: adaptive execution would merge them by the bytes of the narrow
    rows that move, and a task's memory is that of the wide rows it makes of them.
    """
    tasks = -(-rows // rows_per_task)
    return table.repartition(max(tasks, table.sparkSession.sparkContext.defaultParallelism), "symbol") if tasks > 1 else table


def smooth_bars(ticks: DataFrame, bars: int = 20, spread: float = 0.01, rows: int = 0) -> DataFrame:
    """Daily mean price averaged over ``bars`` bars, with a fixed high/low spread.

    Open is the previous close. Useful where raw ticks are too noisy for shapes.
    ``rows``: how many ticks there are, where the caller knows; see ``dealt_by_symbol``.
    """
    daily = ticks.groupBy("symbol", F.col("ts").cast("date").alias("date")).agg(
        F.round(F.avg("price"), 6).alias("mean_price"), F.sum("size").alias("volume")
    )
    daily = dealt_by_symbol(daily, rows)
    w = Window.partitionBy("symbol").orderBy("date")
    close = F.round(F.avg("mean_price").over(w.rowsBetween(-(bars - 1), 0)), 6)
    out = daily.withColumn("close", close)
    return out.select(
        "symbol",
        "date",
        F.coalesce(F.lag("close", 1).over(w), F.col("close")).alias("open"),
        F.round(F.col("close") * (1 + spread), 6).alias("high"),
        F.round(F.col("close") * (1 - spread), 6).alias("low"),
        "close",
        "volume",
    )


def completed(bars: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Drop the unfinished current day; the predicate reaches the scan."""
    return bars.filter(F.col("date") < F.lit(as_of).cast("date"))


def resample(
    bars: DataFrame,
    timeframe: str,
    as_of: dt.date | str | None = None,
    drop_incomplete: bool = True,
    extra_keys: list[str] | None = None,
) -> DataFrame:
    """Daily bars to weekly (ISO) or monthly bars.

    Open of the first day, close of the last, date of the last bar. The period
    that holds ``as_of`` is still trading and is dropped when it is a symbol's
    last one; a feed is not expected to hold bars after that period, and where
    it does the period is finished and stays.
    """
    timeframe = check_timeframe(timeframe)
    keys = ["symbol", *(extra_keys or [])]
    if timeframe == "D":
        return bars.select(*keys, *[c for c in OHLCV if c not in keys])
    out = (
        bars.withColumn("period", period_start(F.col("date"), timeframe))
        .groupBy(*keys, "period")
        .agg(
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
            F.max("date").alias("date"),
        )
    )
    if drop_incomplete and as_of is not None:
        # Only the last period of a symbol can be unfinished. The window shares
        # its exchange with the per-symbol indicator windows that follow.
        current = period_start(F.lit(as_of).cast("date"), timeframe)
        last = F.max("period").over(Window.partitionBy("symbol"))
        out = out.withColumn("_last", last).filter(
            (F.col("period") != current) | (F.col("period") != F.col("_last"))
        )
    return out.select(*keys, *[c for c in OHLCV if c not in keys])


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The most recent ``n`` bars of every symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    return bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def with_min_history(bars: DataFrame, timeframe: str, minimum: int | None = None) -> DataFrame:
    """Keep symbols with enough bars for the scan: 50 monthly, 90 otherwise."""
    need = minimum if minimum is not None else (50 if check_timeframe(timeframe) == "M" else 90)
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return bars.withColumn("bar_count", n).filter(F.col("bar_count") >= need)
