"""Chart-pattern detectors evaluated at every bar of every symbol.

``with_pattern_features`` adds the frame statistics the detectors read in one
exchange by symbol. A detector is a function ``(timeframe) -> Column`` that
yields a hit struct or NULL from those columns; ``DETECTORS`` is the registry and
callers may register their own.

Wide range maxima and minima are built of blocks: the extreme of 4k bars is that
of four extremes of k bars, and any frame is at most four blocks, the oldest two
of which may overlap. That costs a handful of lags a row in place of hundreds of
updates, and every size of blocks is one more window over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.functions.numeric import clamp, message, pct_change, scaled_bars
from barloom.operators.bars import check_timeframe
from barloom.operators.indicators import (
    bounded_ema,
    by_symbol,
    frame,
    market_phase,
    pivot_high,
    pivot_low,
    with_ema,
)

# Pattern names and their display labels.
LABELS = {
    "breakout": "Breakout",
    "retest": "Breakout Retest",
    "cup_handle": "Cup & Handle",
    "double_bottom": "Double Bottom",
    "head_shoulders": "Head & Shoulders",
}
SCAN_PATTERNS = ("breakout", "retest", "cup_handle", "double_bottom")
STUDY_PATTERNS = ("breakout", "retest", "cup_handle", "double_bottom", "head_shoulders")
STUDY_WINDOW = 420
HIT_FIELDS = ("name", "side", "score", "confidence", "level", "label", "reasons")


def _frames(timeframe: str) -> dict[str, tuple[str, str, int, int]]:
    """Feature name -> (max|min, column, first offset, last offset)."""

    def b(n: int) -> int:
        return scaled_bars(n, timeframe)

    cup = b(170)
    return {
        "hi60": ("max", "high", -b(60), -1),
        "base_hi": ("max", "high", -(b(90) - 1), -b(24)),
        "recent_close_hi": ("max", "close", -(b(24) - 1), -1),
        "cup_left_hi": ("max", "high", -(cup - 1), b(45) - cup),
        "cup_bowl_lo": ("min", "low", b(45) - cup + 1, b(125) - cup),
        "cup_right_hi": ("max", "high", b(125) - cup + 1, b(150) - cup),
        "handle_hi": ("max", "high", b(150) - cup + 1, -1),
        "handle_lo": ("min", "low", b(150) - cup + 1, -1),
        "base_lo": ("min", "low", -(b(120) - 1), 0),
        "confirm_close_lo": ("min", "close", -b(6), -1),
    }


_NEEDED = {
    "breakout": ("hi60",),
    "retest": ("base_hi", "recent_close_hi"),
    "cup_handle": ("cup_left_hi", "cup_bowl_lo", "cup_right_hi", "handle_hi", "handle_lo"),
    "double_bottom": ("base_lo", "confirm_close_lo"),
    "head_shoulders": (),
}


def with_frame_extremes(bars: DataFrame, frames: dict[str, tuple[str, str, int, int]]) -> DataFrame:
    """Max/min over fixed frames by blocks of 8, 32, 128 ... bars; a frame that
    starts before the history uses the bars there are, as a plain frame would."""
    w = by_symbol()
    short = {k: f for k, f in frames.items() if f[3] - f[2] + 1 < 16}
    wide = {k: f for k, f in frames.items() if k not in short}
    out = bars
    steps: dict[int, set[tuple[str, str]]] = {}
    for kind, column, first, last in wide.values():
        size = 8
        while size <= (last - first + 1):
            steps.setdefault(size, set()).add((kind, column))
            size *= 4

    def extreme(kind: str, blocks: list[Column]) -> Column:
        if len(blocks) == 1:
            return blocks[0]
        return F.greatest(*blocks) if kind == "max" else F.least(*blocks)

    made: list[str] = []
    for size in sorted(steps):
        new = {}
        for kind, column in sorted(steps[size]):
            name = f"_{kind}_{column}_{size}"
            if size == 8:
                agg = F.max if kind == "max" else F.min
                new[name] = agg(column).over(frame(-7, 0))
            else:
                part = f"_{kind}_{column}_{size // 4}"
                new[name] = extreme(kind, [F.col(part), *[F.lag(part, k * size // 4).over(w) for k in (1, 2, 3)]])
            made.append(name)
        out = out.withColumns(new)
    final = {}
    for name, (kind, column, first, last) in wide.items():
        length = last - first + 1
        size = 8
        while size * 4 <= length:
            size *= 4
        source = f"_{kind}_{column}_{size}"
        # The blocks' last bars: from the frame's end backwards, the oldest block at the frame's start.
        ends = [*range(last, first + size - 1, -size), first + size - 1]
        final[name] = extreme(kind, [F.lag(source, -end).over(w) if end else F.col(source) for end in ends])
    for name, (kind, column, first, last) in short.items():
        agg = F.max if kind == "max" else F.min
        final[name] = agg(column).over(frame(first, last))
    return out.withColumns(final).drop(*made) if final else out


def with_pattern_features(
    bars: DataFrame,
    timeframe: str = "D",
    patterns: Sequence[Pattern] = STUDY_PATTERNS,
    study_window: int | None = None,
    keep_last: int | None = None,
) -> DataFrame:
    """Columns the detectors need, on every bar.

    ``study_window`` restarts the EMAs that many bars back, as a study that sees
    a bounded history does. ``keep_last`` keeps the newest bars after the
    full-history averages, for callers that only score the latest one.
    """
    timeframe = check_timeframe(timeframe)
    own = _own(patterns)
    w = by_symbol()
    out = with_ema(bars, [20, 50, 200])
    first = {"rn": F.row_number().over(w)}
    if keep_last:
        # 185 bars of context cover the widest frame of any detector. A bar is kept that has no
        # bar so far ahead; a symbol's count would be one more window over its whole history.
        first["_ahead"] = F.lead(F.lit(1), keep_last + 185).over(w)
        out = out.withColumns(first).filter("_ahead is null").drop("_ahead")
    else:
        out = out.withColumns(first)
    pivots = {}
    if "double_bottom" in patterns:
        pivots["is_low_pivot"] = _guarded_pivot(pivot_low, scaled_bars(5, timeframe), bool(keep_last))
    if "head_shoulders" in patterns:
        pivots["is_high_pivot"] = _guarded_pivot(pivot_high, scaled_bars(4, timeframe), bool(keep_last))
    out = out.withColumns(pivots) if pivots else out
    if "head_shoulders" in patterns:
        # Before the frame columns, while rows are narrow.
        out = _with_shoulders(out, timeframe)
    frames = {k: v for k, v in _frames(timeframe).items() if any(k in _NEEDED.get(p, ()) for p in patterns)}
    for detector in own:
        frames.update(detector.frames)
    out = with_frame_extremes(out, frames)
    volume_base = F.avg("volume").over(frame(-scaled_bars(20, timeframe), -1))
    extra = {
        "prev_close": F.lag("close", 1).over(w),
        "volume_base": volume_base,
        "close_29_back": F.lag("close", 29).over(w),
    }
    for detector in own:
        extra.update(detector.windows)
    if timeframe == "M":
        extra["volume_base20"] = F.avg("volume").over(frame(-20, -1))
    if study_window:
        for n in (20, 50, 200):
            extra[f"ema{n}"] = bounded_ema(f"ema{n}", n, study_window)
    out = out.withColumns(extra)
    ratio = F.coalesce(F.try_divide(F.col("volume"), F.col("volume_base")), F.lit(1.0))
    out = out.withColumn("vr", ratio)
    if timeframe == "M":
        out = out.withColumn(
            "vr20", F.coalesce(F.try_divide(F.col("volume"), F.col("volume_base20")), F.lit(1.0))
        ).drop("volume_base20")
    else:
        out = out.withColumn("vr20", F.col("vr"))
    slope = F.when(F.col("rn") > 30, pct_change(F.col("close"), F.col("close_29_back"))).otherwise(F.lit(0.0))
    out = out.withColumn("phase", market_phase(F.col("rn"), slope)).drop("close_29_back", "volume_base")
    return out


def _guarded_pivot(flag: Callable[[int], Column], radius: int, truncated: bool) -> Column:
    # On a truncated history the bar number column is the true one, so the guard
    # "index >= radius" must use it and not the position in what is left.
    guard = F.col("rn") > radius
    if truncated:
        w = by_symbol()
        name, column, agg = ("low", "low", F.min) if flag is pivot_low else ("high", "high", F.max)
        ahead = F.lead(name, radius).over(w)
        return guard & ahead.isNotNull() & (F.col(column) == agg(column).over(frame(-radius, radius)))
    return guard & flag(radius)


def _with_shoulders(df: DataFrame, timeframe: str) -> DataFrame:
    """Last qualifying triple of consecutive high pivots known at each bar.

    Triples are formed where the right shoulder sits, from the two pivots before
    it, then carried forward: a later triple always starts later, so the newest
    one decides alone whether it is still inside the lookback.
    """
    radius = scaled_bars(4, timeframe)
    gap = scaled_bars(10, timeframe)
    lookback = scaled_bars(125, timeframe)
    w = by_symbol()
    pivot = F.col("is_high_pivot")
    # Rows after the previous pivot up to and including the next one share a number.
    df = df.withColumn("_seg", F.coalesce(F.sum(pivot.cast("int")).over(frame(Window.unboundedPreceding, -1)), F.lit(0)))
    seg = Window.partitionBy("symbol").orderBy("_seg", "date")
    inside = Window.partitionBy("symbol", "_seg").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_low", F.when(pivot, F.min("low").over(inside)))
    # The two pivots before this one, one primitive column each.
    fields = {"rn": "rn", "high": "high", "low": "low", "_low": "_low"}
    for name, source in fields.items():
        df = df.withColumn(f"_v_{name}", F.when(pivot, F.col(source)))
    lagged = {}
    for back in (1, 2):
        for name in fields:
            lagged[f"_p{back}_{name}"] = F.expr(
                f"lag(_v_{name}, {back}) ignore nulls over (partition by symbol order by _seg, date)"
            )
    df = df.withColumns(lagged)
    left, head = "_p2_", "_p1_"

    def at(which: str, name: str) -> Column:
        return F.col(f"{which}{name}")

    valid = (
        pivot
        & (at(head, "rn") - at(left, "rn") >= gap)
        & (F.col("rn") - at(head, "rn") >= gap)
        & (at(head, "high") > at(left, "high") * 1.04)
        & (at(head, "high") > F.col("high") * 1.04)
        & (F.try_divide(F.abs(at(left, "high") - F.col("high")), F.greatest(at(left, "high"), F.col("high"))) <= 0.15)
    )
    df = df.withColumns(
        {
            "_t_left": F.when(valid, at(left, "rn")),
            "_t_head": F.when(valid, at(head, "high")),
            "_t_neck": F.when(valid, F.least(at(left, "low"), at(head, "_low"), F.col("_low"))),
        }
    )
    seen = seg.rowsBetween(Window.unboundedPreceding, -radius)
    df = df.withColumns({f"_s{c}": F.last(c, ignorenulls=True).over(seen) for c in ("_t_left", "_t_head", "_t_neck")})
    inside_lookback = F.col("_s_t_left") >= F.col("rn") - (lookback - 1)
    made = [c for c in df.columns if c.startswith(("_seg", "_low", "_v_", "_p1_", "_p2_", "_t_", "_s_t_"))]
    return df.withColumns(
        {
            "shoulder_neck": F.when(inside_lookback, F.col("_s_t_neck")),
            "shoulder_head": F.when(inside_lookback, F.col("_s_t_head")),
        }
    ).drop(*made)


def _hit(name: str, side: str, score: Column, confidence: Column, level: Column, *reasons: Column) -> Column:
    """Hit struct; ``reasons`` are short texts, null ones do not apply."""
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(side).alias("side"),
        score.alias("score"),
        confidence.alias("confidence"),
        level.alias("level"),
        F.lit(LABELS[name]).alias("label"),
        F.array_compact(F.array(*reasons)).alias("reasons"),
    )


def hit(name: str, side: str, score: Column, confidence: Column, level: Column, *reasons: Column, label: str | None = None) -> Column:
    """The hit of a caller's own detector; ``side`` is BUY or SELL."""
    if side not in ("BUY", "SELL"):
        raise ValueError("a hit's side is BUY or SELL")
    texts = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    parts = (F.lit(name), F.lit(side), score.cast("double"), confidence.cast("double"), level.cast("double"), F.lit(label or name), texts)
    return F.struct(*(p.alias(n) for p, n in zip(parts, HIT_FIELDS)))


def breakout(timeframe: str) -> Column:
    close, level, vr = F.col("close"), F.col("hi60"), F.col("vr")
    rise = pct_change(close, level)
    bonus = clamp((vr - 1.0) * 18, 0, 16)
    score = F.least(F.lit(95.0), F.lit(58.0) + rise * 1.6 + F.when(close > F.col("ema200"), 8.0).otherwise(2.0) + bonus)
    fires = (
        (F.col("rn") >= scaled_bars(90, timeframe))
        & (close > level * 1.006)
        & (close > F.col("ema50"))
        & (vr >= 1.15)
        & (rise <= 15.0)
    )
    reasons = (
        message("close above the earlier high %.2f", level),
        message("volume %.2f times its average", vr),
        F.lit("close above EMA50"),
        F.when(close > F.col("ema200"), "close above EMA200"),
    )
    return F.when(fires, _hit("breakout", "BUY", score, F.least(F.lit(96.0), F.lit(62.0) + rise + bonus), level, *reasons))


def retest(timeframe: str) -> Column:
    close, level, vr = F.col("close"), F.col("base_hi"), F.col("vr")
    quality = F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(close - level), F.greatest(level, F.lit(0.01))))
    fires = (
        (F.col("rn") >= scaled_bars(110, timeframe))
        & (F.col("recent_close_hi") > level * 1.008)
        & (F.col("low") <= level * 1.035)
        & (close >= level * 0.985)
        & (close > F.col("prev_close"))
        & (close > level)
    )
    score = F.least(F.lit(92.0), F.lit(60.0) + quality * 14 + F.least(F.lit(13.0), vr * 5))
    confidence = F.least(F.lit(93.0), F.lit(60.0) + quality * 20 + F.least(F.lit(10.0), vr * 4))
    reasons = (
        message("earlier resistance %.2f held as support", level),
        F.lit("close back above the level"),
        message("volume %.2f times its average", vr),
    )
    return F.when(fires, _hit("retest", "BUY", score, confidence, level, *reasons))


def cup_handle(timeframe: str) -> Column:
    left, bowl, right = F.col("cup_left_hi"), F.col("cup_bowl_lo"), F.col("cup_right_hi")
    handle_hi, handle_lo, vr = F.col("handle_hi"), F.col("handle_lo"), F.col("vr")
    zero = F.lit(0.0)
    depth = F.coalesce(F.try_divide(left - bowl, left), zero)
    recovery = F.coalesce(F.try_divide(right, left), zero)
    pullback = F.coalesce(F.try_divide(handle_hi - handle_lo, handle_hi), zero)
    fires = (
        (F.col("rn") >= scaled_bars(180, timeframe))
        & depth.between(0.12, 0.42)
        & recovery.between(0.86, 1.25)
        & pullback.between(0.025, 0.18)
        & (F.col("close") > handle_hi * 1.005)
    )
    score = F.least(F.lit(96.0), F.lit(64.0) + depth * 55 + F.least(F.lit(12.0), vr * 4))
    confidence = F.least(F.lit(95.0), F.lit(62.0) + depth * 50 + F.least(F.lit(10.0), vr * 3))
    reasons = (
        message("cup %.1f%% deep", depth * 100),
        message("handle gave back %.1f%%", pullback * 100),
        message("close above the handle's high %.2f", handle_hi),
    )
    return F.when(fires, _hit("cup_handle", "BUY", score, confidence, handle_hi, *reasons))


def head_shoulders(timeframe: str) -> Column:
    neckline = F.col("shoulder_neck")
    height = F.try_divide(F.col("shoulder_head") - neckline, F.greatest(neckline, F.lit(0.01)))
    fires = (F.col("rn") >= scaled_bars(130, timeframe)) & (F.col("close") < neckline * 0.99)
    return F.when(
        fires,
        _hit(
            "head_shoulders",
            "SELL",
            F.least(F.lit(91.0), F.lit(60.0) + height * 85),
            F.least(F.lit(91.0), F.lit(60.0) + height * 70),
            neckline,
            message("head at %.2f above both shoulders", F.col("shoulder_head")),
            message("close below the neckline %.2f", neckline),
            F.lit("bearish: lowers conviction in a long entry"),
        ),
    )


def double_bottom_candidate(timeframe: str) -> Column:
    """Cheap conditions that every double bottom meets; the pair search runs on these bars only."""
    return (
        (F.col("rn") >= scaled_bars(130, timeframe))
        & (F.col("vr") >= 1.0)
        & (F.col("close") > F.col("confirm_close_lo"))
    )


def _pairs_of(timeframe: str) -> str:
    """SQL: all usable foot pairs of a symbol, from ``_highs`` and ``_feet``.

    What does not depend on the evaluated bar is settled once per pair: the
    distance, the match of the lows, the neckline and the rise to it, the prior
    decline. Feet are at most a lookback apart, so a foot has few partners.
    Ordering by (right, -left) makes ``array_max`` pick the latest right foot
    and, on ties, the first left foot.
    """

    def b(n: int) -> int:
        return scaled_bars(n, timeframe)

    return f"""
      filter(
        transform(
          flatten(transform(_feet, (r, i) -> transform(
            filter(slice(_feet, greatest(1, i + 1 - {b(120)}), least(i, {b(120)})),
                   l -> r.rn - l.rn between {b(18)} and {b(120) - 1 - b(5)}
                        and try_divide(abs(l.low - r.low), greatest(l.low, r.low)) <= 0.05D),
            l -> struct(r.rn as right, -l.rn as neg_left, l.low as left_low, least(l.low, r.low) as foot)))),
          p -> struct(p.right as right, p.neg_left as neg_left, p.left_low as left_low, p.foot as foot,
                 array_max(slice(_highs, -p.neg_left - _base, p.right + p.neg_left + 1)) as neck,
                 array_max(slice(_highs, greatest(1, -p.neg_left - {b(60)} - _base),
                           -p.neg_left - _base - greatest(1, -p.neg_left - {b(60)} - _base) + 1)) as prior)),
        p -> (p.neck - p.foot) / nullif(p.foot, 0D) * 100 >= 8.0D)
    """


def _double_bottom_of(timeframe: str) -> str:
    """SQL lambda body: bar struct ``c`` -> hit struct or NULL, given ``_pairs``."""

    def b(n: int) -> int:
        return scaled_bars(n, timeframe)

    return f"""
      transform(
        array(array_max(filter(_pairs, p -> p.right <= c.rn - {b(5)} and -p.neg_left >= c.rn - {b(120) - 1}
                               and p.foot <= c.base_lo * 1.06D))),
        s -> if(s is not null
                and (s.prior - s.left_low) / nullif(s.left_low, 0D) * 100 >= 12.0D
                and c.close > s.neck * 1.005D
                and c.confirm_close_lo <= s.neck * 1.005D
                and (c.close - s.neck) / nullif(s.neck, 0D) * 100 <= 12.0D,
             named_struct('name', 'double_bottom', 'side', 'BUY',
               'score', least(94.0D, 61.0D + (s.neck - s.foot) / nullif(s.foot, 0D) * 70 + least(12.0D, c.vr * 4)),
               'confidence', least(94.0D, 60.0D + (s.neck - s.foot) / nullif(s.foot, 0D) * 65 + least(10.0D, c.vr * 3)),
               'level', s.neck, 'label', '{LABELS["double_bottom"]}',
               'reasons', array(format_string('two lows near %.2f after a fall of %.1f%%', round(s.foot, 2), round((s.prior - s.left_low) / nullif(s.prior, 0D) * 100, 1)),
                                format_string('close above the neckline %.2f', round(s.neck, 2)),
                                format_string('volume %.2f times its average', round(c.vr, 2)))), null)
      )[0]
    """


Detector = Callable[[str], Column]


@dataclass(frozen=True, eq=False)
class OwnDetector:
    """A detector that one call brings along, with the columns that it needs.

    ``rule(timeframe)`` gives a hit (see :func:`hit`) or NULL from the columns that
    every detector may read - bars, ``rn``, averages, ``prev_close``, ``vr``, ``phase``
    - and from its own: ``frames`` are range extremes (kind, column, first and last
    offset in bars), ``windows`` further columns over a symbol's bars. They are planned
    only for calls that bring the detector, in the exchange that is there anyway.
    """

    name: str
    rule: Detector
    frames: Mapping[str, tuple[str, str, int, int]] = field(default_factory=dict)
    windows: Mapping[str, Column] = field(default_factory=dict)


Pattern = str | OwnDetector


def _own(patterns: Sequence[Pattern]) -> list[OwnDetector]:
    """The detectors that a call brings; names that nobody knows and names given twice are errors."""
    names = [p if isinstance(p, str) else p.name for p in patterns]
    unknown = [p for p in patterns if isinstance(p, str) and p not in DETECTORS and p != "double_bottom"]
    if unknown:
        raise ValueError(f"unknown patterns: {', '.join(unknown)}")
    if len(set(names)) < len(names):
        raise ValueError("a pattern is given twice")
    return [p for p in patterns if isinstance(p, OwnDetector)]


DETECTORS: dict[str, Detector] = {
    "breakout": breakout,
    "retest": retest,
    "cup_handle": cup_handle,
    "head_shoulders": head_shoulders,
}


def register_detector(name: str, detector: Detector, label: str | None = None) -> None:
    """Add a detector: ``detector(timeframe)`` returns a hit struct column or NULL."""
    DETECTORS[name] = detector
    LABELS.setdefault(name, label or name)


def detect(
    features: DataFrame,
    timeframe: str = "D",
    patterns: Sequence[Pattern] = SCAN_PATTERNS,
    keep: list[str] | None = None,
    only: Column | None = None,
    also: Column | None = None,
) -> DataFrame:
    """Bars with at least one hit: ``symbol, date, rn, hits, <keep>``.

    ``hits`` holds the hit structs by score, highest first, ties in the order
    the patterns were asked for. ``only`` limits the evaluated bars. Bars where
    ``also`` holds come out as well, with an empty ``hits`` if nothing fired.
    """
    timeframe = check_timeframe(timeframe)
    keep = list(keep or [])
    detectors = {**DETECTORS, **{p.name: p.rule for p in _own(patterns)}}
    patterns = tuple(p if isinstance(p, str) else p.name for p in patterns)
    wanted = only if only is not None else F.lit(True)
    order = {p: i for i, p in enumerate(patterns)}
    plain = [p for p in patterns if p != "double_bottom"]
    also = F.coalesce(also, F.lit(False)) if also is not None else F.lit(False)

    def ranked(column: Column, name: str) -> Column:
        return F.when(
            column.isNotNull(), F.struct((-column["score"]).alias("k"), F.lit(order[name]).alias("o"), column.alias("h"))
        )

    direct = F.array_compact(F.array(*[ranked(detectors[p](timeframe), p) for p in plain])) if plain else None
    if "double_bottom" not in patterns:
        out = features.withColumn("_r", F.when(wanted, direct).otherwise(F.array_compact(F.array(F.when(F.lit(False), direct[0])))))
        out = out.filter((F.size("_r") > 0) | also)
        return out.select(
            "symbol", "date", "rn", F.transform(F.array_sort("_r"), lambda x: x["h"]).alias("hits"), *keep
        )

    # One row per symbol: the arrays are bounded by the number of bars, and the
    # grouping reuses the partitioning of the windows, so nothing moves.
    fields = list(dict.fromkeys(["rn", "date", "close", "vr", "base_lo", "confirm_close_lo", *keep]))
    candidate = F.coalesce(wanted & double_bottom_candidate(timeframe), F.lit(False))
    base = features.withColumn("_candidate", candidate)
    direct_fires = F.lit(False)
    if direct is not None:
        base = base.withColumn("_r", direct)
        direct_fires = F.col("_fires")
        base = base.withColumn("_fires", F.coalesce(wanted & (F.size("_r") > 0), F.lit(False)))
        fields += ["_r", "_fires"]
    base = base.withColumn("_also", also)
    fields.append("_also")
    bar = F.struct(*[F.col(c) for c in fields], F.col("_candidate"))
    grouped = base.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("rn", "high"))).alias("_h"),
        F.sort_array(F.collect_list(F.when(F.col("is_low_pivot"), F.struct("rn", "low")))).alias("_feet"),
        F.collect_list(F.when(direct_fires | F.col("_candidate") | F.col("_also"), bar)).alias("_bars"),
    )
    grouped = (
        grouped.filter(F.size("_bars") > 0)
        .select("symbol", F.col("_h")["high"].alias("_highs"), (F.col("_h")[0]["rn"] - 1).alias("_base"), "_feet", "_bars")
        .select("symbol", "_bars", F.inline(F.array(F.struct(F.expr(_pairs_of(timeframe)).alias("_pairs")))))
    )
    searched = F.expr(
        f"transform(_bars, c -> named_struct('c', c, 'db', if(c._candidate, {_double_bottom_of(timeframe)}, null)))"
    )
    if direct is None:
        searched = F.filter(searched, lambda x: x["db"].isNotNull() | x["c"]["_also"])
    rows = grouped.select("symbol", F.inline(searched))
    double = ranked(F.col("db"), "double_bottom")
    parts = [F.array_compact(F.array(double))]
    if direct is not None:
        parts.insert(0, F.when(F.col("c._fires"), F.col("c._r")).otherwise(F.slice("c._r", 1, 0)))
    rows = rows.withColumn("_all", F.concat(*parts)).filter((F.size("_all") > 0) | F.col("c._also"))
    return rows.select(
        "symbol",
        F.col("c.date").alias("date"),
        F.col("c.rn").alias("rn"),
        F.transform(F.array_sort("_all"), lambda x: x["h"]).alias("hits"),
        *[F.col(f"c.{k}").alias(k) for k in keep],
    )


def technical_score(hits: Column) -> Column:
    """Best hit plus trend, volume and phase points, less 14 for a bearish hit; 0..100."""
    close = F.col("close")
    best = F.coalesce(F.array_max(F.transform(hits, lambda h: h["score"])), F.lit(42.0))

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    total = (
        best
        + points(close > F.col("ema20"), 4.0)
        + points(close > F.col("ema50"), 6.0)
        + points(close > F.col("ema200"), 7.0)
        + points(F.col("vr20") >= 1.35, 6.0)
        + points(F.col("phase") == "RUN", 5.0)
        - points(F.exists(hits, lambda h: h["side"] == "SELL"), 14.0)
    )
    return clamp(total, 0, 100)


def technical_reasons(hits: Column) -> Column:
    """What added to or took from the technical score, as short texts."""
    close = F.col("close")
    return F.array_compact(
        F.array(
            *[F.when(close > F.col(f"ema{n}"), f"close above EMA{n}") for n in (20, 50, 200)],
            F.when(F.col("vr20") >= 1.35, "volume well above its average"),
            F.when(F.col("phase") == "RUN", "market phase RUN"),
            F.when(F.exists(hits, lambda h: h["side"] == "SELL"), "bearish pattern"),
        )
    )


def pattern_label(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), name)
