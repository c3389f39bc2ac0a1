"""Price indicators as window columns.

Every window is partitioned by symbol and ordered by date, so a chain of these
operators costs one exchange and the frames share it. All read only the bar
itself and earlier ones, except the centred pivot flags, whose consumers must
look no later than ``radius`` bars back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.functions.numeric import pct_change


def by_symbol():
    return Window.partitionBy("symbol").orderBy("date")


def frame(first: int, last: int):
    return by_symbol().rowsBetween(first, last)


def bar_number() -> Column:
    return F.row_number().over(by_symbol())


def sma(value: str, bars: int) -> Column:
    """Mean of the last ``bars`` values; shorter at the start of the history."""
    return F.avg(value).over(frame(-(bars - 1), 0))


def true_range() -> Column:
    previous = F.lag("close", 1).over(by_symbol())
    # greatest() skips NULLs, so the first bar falls back to high - low.
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)
    )


def with_atr(bars: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    """Simple mean of the true range over ``n`` bars."""
    return bars.withColumn("true_range", true_range()).withColumn(
        name, F.avg("true_range").over(frame(-(n - 1), 0))
    )


def volume_ratio(bars: int = 20) -> Column:
    """Volume over the mean of the ``bars`` bars before it; 1 when there is no base."""
    base = F.avg("volume").over(frame(-bars, -1))
    return F.coalesce(F.try_divide(F.col("volume"), base), F.lit(1.0))


def rolling_high(bars: int, exclude_latest: bool = True) -> Column:
    if exclude_latest:
        return F.coalesce(F.max("high").over(frame(-bars, -1)), F.col("high"))
    return F.max("high").over(frame(-(bars - 1), 0))


def rolling_low(bars: int, exclude_latest: bool = True) -> Column:
    if exclude_latest:
        return F.coalesce(F.min("low").over(frame(-bars, -1)), F.col("low"))
    return F.min("low").over(frame(-(bars - 1), 0))


def support() -> Column:
    return rolling_low(35, exclude_latest=False)


def resistance() -> Column:
    return rolling_high(60, exclude_latest=True)


def slope_pct(value: str, bars: int = 20) -> Column:
    """Change against the value ``bars - 1`` back; 0 unless more than ``bars`` bars exist."""
    earlier = F.lag(value, bars - 1).over(by_symbol())
    return F.when(bar_number() > bars, pct_change(F.col(value), earlier)).otherwise(F.lit(0.0))


def pivot_low(radius: int) -> Column:
    """True where the low is the lowest of the centred 2r+1 bars; ties all count."""
    lowest = F.min("low").over(frame(-radius, radius))
    ahead = F.lead("low", radius).over(by_symbol())
    return (bar_number() > radius) & ahead.isNotNull() & (F.col("low") == lowest)


def pivot_high(radius: int) -> Column:
    highest = F.max("high").over(frame(-radius, radius))
    ahead = F.lead("high", radius).over(by_symbol())
    return (bar_number() > radius) & ahead.isNotNull() & (F.col("high") == highest)


def with_drawdown(df: DataFrame, value: str, key: str = "symbol", order: str = "date") -> DataFrame:
    """Fall from the running peak as a fraction <= 0; non-positive values are skipped."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    positive = F.when(F.col(value) > 0, F.col(value))
    return df.withColumn("drawdown", F.try_divide(positive, F.max(positive).over(w)) - 1)


# --- exponential averages -------------------------------------------------


def _span_groups(spans: list[int]) -> list[list[int]]:
    """Spans that can share one block length without overflow (ratio below 16)."""
    groups: list[list[int]] = []
    for span in sorted(set(spans)):
        if groups and (span + 1) / (groups[-1][0] + 1) < 16:
            groups[-1].append(span)
        else:
            groups.append([span])
    return groups


def with_ema(bars: DataFrame, spans: list[int], value: str = "close", prefix: str = "ema") -> DataFrame:
    """Exponential averages with k = 2/(n+1), seeded with the first value.

    The recursion E = E' + k (x - E') unrolls to a weighted sum, so it needs no
    Python and no per-symbol array: inside a block of L bars

        E = q^p * (q * E_end_of_previous_block + k * sum(x_j * q^-p_j)),  q = 1 - k

    where p is the position in the block. L is 20 (n_max + 1): the weight of
    anything older than the previous block is below double precision, and
    q^-L stays far from overflow. Running sums cost O(1) a row.
    """
    w = by_symbol()
    out = bars.withColumn("_i", F.row_number().over(w) - 1)
    for number, group in enumerate(_span_groups(spans)):
        length = 20 * (max(group) + 1)
        block, pos = f"_b{number}", f"_p{number}"
        out = out.withColumn(block, F.floor(F.col("_i") / length)).withColumn(pos, F.col("_i") % length)
        inside = Window.partitionBy("symbol", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        ordered = Window.partitionBy("symbol").orderBy(block, "date")
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        sums, carries, results = {}, {}, {}
        for n in group:
            k = 2.0 / (n + 1)
            q = 1.0 - k
            sums[f"_s{n}"] = F.sum(F.col(value) * F.pow(F.lit(q), -F.col(pos))).over(inside)
        out = out.withColumns(sums)
        carries["_first"] = F.first(value).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        for n in group:
            # Sum of the last finished block, seen from the current one.
            ended = F.when(F.col(pos) == length - 1, F.col(f"_s{n}"))
            carries[f"_c{n}"] = F.last(ended, ignorenulls=True).over(before)
        out = out.withColumns(carries)
        for n in group:
            k = 2.0 / (n + 1)
            q = 1.0 - k
            previous_seed = F.when(F.col(block) == 1, F.col("_first") * (q**length)).otherwise(F.lit(0.0))
            carry = F.when(F.col(block) == 0, F.col("_first")).otherwise(
                previous_seed + F.col(f"_c{n}") * (k * q ** (length - 1))
            )
            results[f"{prefix}{n}"] = F.pow(F.lit(q), F.col(pos)) * (carry * q + F.col(f"_s{n}") * k)
        out = out.withColumns(results).drop(block, pos, "_first", *sums, *[f"_c{n}" for n in group])
    return out.drop("_i")


def bounded_ema(name: str, span: int, window: int, value: str = "close") -> Column:
    """The same average restarted ``window - 1`` bars back, from the full-history one.

    With full average F and window start s: F_t + (1-k)^(t-s) * (x_s - F_s).
    """
    w = by_symbol()
    q = 1.0 - 2.0 / (span + 1)
    back = window - 1
    correction = (F.lag(value, back).over(w) - F.lag(name, back).over(w)) * (q**back)
    return F.col(name) + F.coalesce(correction, F.lit(0.0))


def market_phase(rn: Column, slope30: Column) -> Column:
    """RUN, DOWN, SW, TRANSITION or UNKNOWN from EMA 20/50/200 and the 30-bar slope."""
    close, e20, e50, e200 = (F.col(c) for c in ("close", "ema20", "ema50", "ema200"))
    compression = F.coalesce(F.try_divide(F.abs(e20 - e50), close), F.lit(0.0))
    return (
        F.when(rn < 60, "UNKNOWN")
        .when((close > e50) & (e50 > e200) & (slope30 > 2.0), "RUN")
        .when((close < e50) & (e50 < e200) & (slope30 < -2.0), "DOWN")
        .when(compression < 0.035, "SW")
        .otherwise("TRANSITION")
    )
