"""Tradability from median daily turnover, normalised to USD."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.functions.currency import convert, trading_currency, with_rate
from barloom.functions.numeric import computed_once
from barloom.operators.bars import last_bars

# Median daily turnover in USD -> score, log-interpolated between.
TURNOVER_SCORES = [
    (20_000, 5.0),
    (100_000, 25.0),
    (500_000, 45.0),
    (2_000_000, 62.0),
    (10_000_000, 80.0),
    (50_000_000, 92.0),
    (250_000_000, 100.0),
]


def liquidity_score(usd: Column) -> Column:
    floor, floor_score = TURNOVER_SCORES[0]
    score = F.when(usd.isNull() | (usd <= 0), F.lit(0.0)).when(usd <= floor, usd * floor_score / floor)
    for (low, low_score), (high, high_score) in zip(TURNOVER_SCORES, TURNOVER_SCORES[1:]):
        share = (F.ln(usd) - math.log(low)) / (math.log(high) - math.log(low))
        score = score.when(usd < high, F.lit(low_score) + share * (high_score - low_score))
    return F.round(score.otherwise(F.lit(100.0)), 1)


def tail_metrics(bars: DataFrame, turnover_bars: int = 60) -> DataFrame:
    """One row per symbol from its newest bars, in a single pass.

    Median turnover, ATR(14), 35-bar support, 60-bar resistance, last price and
    date: what liquidity and risk need from daily bars. Only the newest bars
    are kept before the aggregate, so its buffers are bounded.
    """
    newest = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    keep = max(turnover_bars, 61)
    tail = (
        # One bar more, as the close before the oldest kept bar; the rest of the history meets no window.
        last_bars(bars, keep + 1)
        .withColumns({"_back": F.row_number().over(newest) - 1, "_prev": F.lead("close", 1).over(newest)})
        .filter(F.col("_back") < keep)
        .withColumn(
            "_tr",
            F.greatest(
                F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev"))
            ),
        )
    )
    back = F.col("_back")
    traded = (back < turnover_bars) & (F.col("volume") > 0) & (F.col("close") > 0)
    latest = back == 0
    return tail.groupBy("symbol").agg(
        F.coalesce(F.median(F.when(traded, F.col("close") * F.col("volume"))), F.lit(0.0)).alias("turnover"),
        F.avg(F.when(back < 14, F.col("_tr"))).alias("atr"),
        F.min(F.when(back < 35, F.col("low"))).alias("support"),
        F.coalesce(F.max(F.when((back >= 1) & (back <= 60), F.col("high"))), F.max(F.when(latest, F.col("high")))).alias(
            "resistance"
        ),
        F.max(F.when(latest, F.col("close"))).alias("last_price"),
        F.max("date").alias("price_as_of"),
    )


def with_liquidity(df: DataFrame, fx: DataFrame) -> DataFrame:
    """Score, USD turnover and verification for rows with symbol, market, turnover."""
    out = df.withColumn("currency", trading_currency(F.col("symbol"), F.col("market")))
    out = with_rate(out, fx, "currency", "_rate")
    usd = convert(F.col("turnover"), F.col("currency"), F.lit("USD"), F.col("_rate"), F.lit(1.0))
    out = computed_once(out, {"_usd": usd})
    return computed_once(
        out,
        {
            "liquidity_score": liquidity_score(F.col("_usd")),
            "turnover_usd": F.round("_usd", 2),
            "liquidity_verified": F.col("_usd").isNotNull(),
            "turnover": F.round("turnover", 2),
        },
    ).drop("_usd", "_rate")
