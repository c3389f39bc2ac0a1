"""Deterministic bars and snapshots for tests and demos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Price anchors (share of history, price) of each demo scenario.
SCENARIOS = {
    "UPTREND": [(0.0, 40.0), (0.5, 55.0), (0.85, 70.0), (1.0, 80.0)],
    "BREAKOUT": [(0.0, 50.0), (0.4, 60.0), (0.9, 61.0), (0.97, 61.0), (1.0, 64.5)],
    "RETEST": [(0.0, 45.0), (0.6, 58.0), (0.88, 64.0), (0.96, 59.0), (1.0, 61.0)],
    "CUP": [(0.0, 60.0), (0.32, 82.0), (0.55, 62.0), (0.8, 80.0), (0.93, 78.0), (0.98, 77.0), (1.0, 83.0)],
    "DOUBLE_BOTTOM": [(0.0, 90.0), (0.55, 60.0), (0.68, 72.0), (0.82, 61.0), (0.97, 71.5), (1.0, 74.5)],
    "HEAD_SHOULDERS": [(0.0, 50.0), (0.5, 70.0), (0.6, 62.0), (0.7, 80.0), (0.8, 62.0), (0.88, 70.0), (1.0, 55.0)],
    "DOWNTREND": [(0.0, 90.0), (0.5, 70.0), (1.0, 48.0)],
    "SIDEWAYS": [(0.0, 60.0), (0.5, 61.0), (1.0, 60.0)],
    "VOLATILE": [(0.0, 50.0), (0.3, 65.0), (0.5, 45.0), (0.7, 66.0), (1.0, 52.0)],
}


def _interpolate(anchors: Column, x: Column) -> Column:
    left = F.element_at(F.filter(anchors, lambda a: a["x"] <= x), -1)
    right = F.coalesce(F.try_element_at(F.filter(anchors, lambda a: a["x"] > x), F.lit(1)), left)
    mix = F.coalesce(F.try_divide(x - left["x"], right["x"] - left["x"]), F.lit(0.0))
    return left["y"] + (right["y"] - left["y"]) * mix


def demo_bars(spark: SparkSession, days: int = 240, end: str = "2026-08-19") -> DataFrame:
    """``days`` weekday-agnostic daily bars of every scenario: anchors, waves, hash noise."""
    rows = [(name, [(x, y) for x, y in anchors]) for name, anchors in SCENARIOS.items()]
    base = spark.createDataFrame(rows, "symbol string, anchors array<struct<x:double,y:double>>")
    grid = base.select("symbol", "anchors", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("i"))
    x = F.col("i") / float(days - 1)
    wave = F.sin(F.col("i") * 0.45) * 0.004
    noise = (F.pmod(F.xxhash64("symbol", "i"), F.lit(1000)) / 1000.0 - 0.5) * 0.006
    close = F.round(_interpolate(F.col("anchors"), x) * (1 + wave + noise), 4)
    out = grid.withColumns({"close": close, "date": F.date_sub(F.lit(end).cast("date"), F.lit(days - 1) - F.col("i"))})
    swing = 0.006 + F.pmod(F.xxhash64("i", "symbol"), F.lit(100)) / 100.0 * 0.004
    late = F.when(F.col("i") >= days - 4, 1.8).otherwise(1.0)
    return out.select(
        "symbol",
        "date",
        F.round(F.col("close") * (1 - wave / 2), 4).alias("open"),
        F.round(F.col("close") * (1 + swing), 4).alias("high"),
        F.round(F.col("close") * (1 - swing), 4).alias("low"),
        "close",
        F.round((1_000_000 + F.pmod(F.xxhash64("symbol", "i", F.lit(7)), F.lit(200_000))) * late).alias("volume"),
    )


def demo_snapshots(bars: DataFrame, listing: DataFrame) -> DataFrame:
    """Snapshots whose EPS and book value are solved back from the last price, P/E and P/BV.

    ``listing`` has symbol, pe and pbv.
    """
    last = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("last_price"))
    return listing.join(last, "symbol").withColumns(
        {
            "eps": F.coalesce(F.try_divide("last_price", F.nullif("pe", F.lit(0.0))), F.lit(0.0)),
            "book_value_per_share": F.coalesce(F.try_divide("last_price", F.nullif("pbv", F.lit(0.0))), F.lit(0.0)),
        }
    )
