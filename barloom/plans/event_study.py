"""The event study as one plan: features, hits, cooldown, outcomes, statistics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.operators import study as ST
from barloom.operators.bars import check_timeframe, resample
from barloom.operators.filters import eligible
from barloom.operators.patterns import STUDY_PATTERNS, STUDY_WINDOW, Pattern, detect, with_pattern_features
from barloom.session import cut_lineage


@dataclass
class EventStudy:
    events: DataFrame
    stats: DataFrame
    baseline: DataFrame
    edges: DataFrame
    #: What the three tables above are read from: one row per group and horizon.
    summary: DataFrame

    def computed(self) -> EventStudy:
        """The same study with its summary written once, for callers that read several of its tables."""
        return _tables(self.events, cut_lineage(self.summary))


def _tables(events: DataFrame, summary: DataFrame) -> EventStudy:
    stats = ST.with_reliability(summary.filter("kind = 'signal'").drop("kind"))
    baseline = summary.filter("kind = 'baseline'").drop("kind", "pattern", "market")
    return EventStudy(events, stats, baseline, ST.edges_of(summary).drop("kind"), summary)


def study_bars(bars: DataFrame, listing: DataFrame | None, timeframe: str, as_of, longest: int) -> DataFrame:
    """Resampled bars of eligible symbols that are long enough to study."""
    start = 24 if timeframe == "M" else 90
    out = resample(bars, timeframe, as_of)
    if listing is not None:
        out = out.join(listing.select("symbol", "market"), "symbol")
    else:
        out = out.withColumn("market", F.lit(None).cast("string"))
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return out.withColumn("bar_count", n).filter(F.col("bar_count") >= start + longest + 1)


def event_study(
    bars: DataFrame,
    listing: DataFrame | None = None,
    *,
    timeframe: str = "D",
    patterns: Sequence[Pattern] = STUDY_PATTERNS,
    horizons: tuple[int, ...] = (5, 10, 20),
    cooldown: int = 20,
    cost_bps: float = 30.0,
    baseline_step: int = 10,
    market: str = "ALL",
    universe: str = "ALL",
    as_of: dt.date | str | None = None,
    max_symbols: int | None = None,
) -> EventStudy:
    """Forward returns after each pattern signal, net of a round-trip cost."""
    timeframe = check_timeframe(timeframe)
    horizons = tuple(sorted({int(h) for h in horizons if int(h) > 0}))
    longest = max(horizons)
    start = 24 if timeframe == "M" else 90
    if listing is not None:
        listing = eligible(listing, market, universe)
        if max_symbols is not None:
            listing = listing.orderBy("symbol").limit(max_symbols)
    prepared = study_bars(bars, listing, timeframe, as_of, longest)
    features = with_pattern_features(prepared, timeframe, patterns, STUDY_WINDOW)
    features = features.withColumns({**ST.forward_columns(horizons), "is_baseline": ST.is_baseline_bar(start, longest, baseline_step)})
    outcome_columns = [f"{n}_{h}" for h in horizons for n in ("exit", "low", "high")]
    index = F.col("rn") - 1
    in_range = (index >= start) & (index < F.col("bar_count") - longest)
    # Signals and the baseline's bars are rows of one pass over the features.
    hits = detect(
        features, timeframe, patterns, keep=["market", "close", "is_baseline", *outcome_columns], only=in_range, also=F.col("is_baseline")
    )
    hit = F.try_element_at("hits", F.lit(1))
    hits = hits.select(
        "symbol", "rn", "date", "market", hit["name"].alias("pattern"), hit["side"].alias("side"),
        F.when(hit["side"] == "SELL", -1).otherwise(1).alias("direction"), "close", "is_baseline", *outcome_columns,
    ).filter(F.col("close") != 0)
    kept = ST.apply_cooldown(hits, cooldown, counts=F.col("pattern").isNotNull(), also=F.col("is_baseline"))

    def outcomes(kind: str, direction: Column) -> list[Column]:
        return [
            F.struct(F.lit(kind).alias("kind"), F.lit(h).alias("horizon"), ST.outcome(h, direction, cost_bps).alias("o")) for h in horizons
        ]

    both = F.concat(
        F.when(F.col("is_signal"), F.array(*outcomes("signal", F.col("direction")))).otherwise(F.slice(F.array(*outcomes("signal", F.col("direction"))), 1, 0)),
        F.when(F.col("is_baseline"), F.array(*outcomes("baseline", F.lit(1)))).otherwise(F.slice(F.array(*outcomes("baseline", F.lit(1))), 1, 0)),
    )
    rows = kept.select(
        "symbol", "market", "pattern", "side", F.lit(timeframe).alias("timeframe"), F.col("date").alias("signal_date"), F.explode(both).alias("x")
    ).select("symbol", "market", "pattern", "side", "timeframe", "signal_date", "x.kind", "x.horizon", "x.o.*").filter("return_pct is not null")
    signal = F.col("kind") == "signal"
    named = rows.withColumns({c: F.when(signal, F.col(c)) for c in ("pattern", "market")})
    summary = ST.summarize(named, [["kind"], ["kind", "pattern"], ["kind", "market"]])
    # A grouping by pattern or market says nothing about the baseline.
    summary = summary.filter("kind = 'signal' or group_kind = 'kind'")
    kind = F.when(F.col("kind") == "baseline", "baseline").when(F.col("group_kind") == "kind", "overall").otherwise(
        F.regexp_replace("group_kind", r"^kind\+", "")
    )
    summary = summary.withColumn("group_kind", kind)
    return _tables(rows.filter(signal).drop("kind"), summary)
