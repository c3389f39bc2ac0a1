"""Matching price shapes: resample to 64 points, z-score, correlate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.functions.numeric import clamp, computed_once
from barloom.operators.bars import check_timeframe, completed, last_bars, period_start
from barloom.operators.filters import eligible

POINTS = 64
MINIMUM_POINTS = 12
BEST = 8


def resample_points(values: Column, length: int = POINTS) -> Column:
    """Linear interpolation of an array onto ``length`` evenly spaced positions."""
    last = F.size(values) - 1

    def at(i: Column) -> Column:
        # One struct per point, so position and floor are not recomputed.
        p = F.transform(F.array(i * last / float(length - 1)), lambda x: F.struct(x.alias("x"), F.floor(x).cast("int").alias("l")))[0]
        return F.transform(
            F.array(p),
            lambda s: values[s["l"]] * (1 - (s["x"] - s["l"])) + values[F.least(last, s["l"] + 1)] * (s["x"] - s["l"]),
        )[0]

    return F.when(last > 0, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)).otherwise(
        F.when(last == 0, F.array_repeat(F.try_element_at(values, F.lit(1)), length))
    )


def zscore(values: Column) -> Column:
    """Population z-score; a constant series becomes zeros."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def scaled(mean: Column) -> Column:
        variance = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(values)
        deviation = F.coalesce(F.nullif(F.sqrt(variance), F.lit(0.0)), F.lit(1.0))
        return F.transform(F.array(deviation), lambda d: F.transform(values, lambda v: (v - mean) / d))[0]

    return F.transform(F.array(total / F.size(values)), scaled)[0]


def with_shape(df: DataFrame, values: str, name: str = "shape") -> DataFrame:
    out = computed_once(df, {"_points": resample_points(F.col(values))})
    return computed_once(out, {name: zscore(F.col("_points"))}).drop("_points")


def correlation(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(0.0), lambda s, p: s + F.coalesce(p["x"] * p["y"], F.lit(0.0)))
    return F.when(n > 0, dot / n).otherwise(F.lit(-1.0))


def shape_score(corr: Column) -> Column:
    return clamp((corr + 1) * 50, 0, 100)


def last_per_period(bars: DataFrame, timeframe: str) -> DataFrame:
    """Last close of every week or month."""
    if check_timeframe(timeframe) == "D":
        return bars.select("symbol", "date", "close")
    return (
        bars.groupBy("symbol", period_start(F.col("date"), timeframe).alias("_p"))
        .agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
        .drop("_p")
    )


def shape_index(bars: DataFrame, listing: DataFrame, as_of, timeframe: str = "D", bars_kept: int | None = None) -> DataFrame:
    """Symbols with the closes of their completed bars; of the newest ``bars_kept`` if given."""
    done = completed(bars, as_of)
    tail = last_per_period(done if bars_kept is None else last_bars(done, bars_kept), timeframe)
    series = tail.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "close")))["close"].alias("closes"))
    return series.join(listing, "symbol")


def match_shapes(index: DataFrame, query: DataFrame, market: str = "ALL", universe: str = "ALL", best: int = BEST) -> DataFrame:
    """The ``best`` symbols most correlated with the query's shape.

    ``query`` is one row with a ``shape`` array of 64 z-scored points; it enters
    the plan as a scalar subquery.
    """
    rows = eligible(index, market, universe).filter(F.size("closes") >= MINIMUM_POINTS)
    shaped = with_shape(rows, "closes")
    scored = computed_once(shaped, {"_q": query.select("shape").scalar()})
    return (
        scored.withColumn("score", shape_score(correlation(F.col("_q"), F.col("shape"))))
        .drop("_q", "shape", "closes")
        .orderBy(F.col("score").desc(), "symbol")
        .limit(best)
    )


def interpolate_missing(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Fill gaps of a series: flat at both ends, linear inside; all-missing series drop out."""
    back = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(position).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value)), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    out = df.withColumn("_k", known).withColumns(
        {"_l": F.last("_k", ignorenulls=True).over(back), "_r": F.first("_k", ignorenulls=True).over(ahead)}
    )
    left, right = F.col("_l"), F.col("_r")
    mix = F.coalesce(F.try_divide(F.col(position) - left["p"], right["p"] - left["p"]), F.lit(0.0))
    filled = F.when(left.isNull(), right["v"]).when(right.isNull(), left["v"]).otherwise(left["v"] * (1 - mix) + right["v"] * mix)
    return out.withColumn(value, filled).filter(F.col(value).isNotNull()).drop("_k", "_l", "_r")
