"""Freshness and coverage of the price, statement and rate feeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.filters import eligible, expected_eod

READY_COVERAGE = 0.97
FX_STALE_DAYS = 7


def latest_dates(bars: DataFrame) -> DataFrame:
    """Newest bar per symbol; a map-side partial maximum, so hot symbols cost nothing."""
    return bars.groupBy("symbol").agg(F.max("date").alias("latest_date"))


def feed_stats(bars: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("symbol") if approximate else F.count_distinct("symbol")
    return bars.agg(F.max("date").alias("latest_date"), distinct.alias("symbols"))


def price_health(
    bars: DataFrame,
    universe: DataFrame,
    as_of: dt.date | str,
    *,
    market: str = "ALL",
    group: str = "ALL",
    failed: DataFrame | None = None,
    updating: bool = False,
) -> DataFrame:
    """One row: state (missing, updating, stale, degraded, ready) and its counts."""
    names = eligible(universe, market, group).select("symbol").distinct()
    expected = expected_eod(as_of)
    rows = names.join(latest_dates(bars), "symbol", "left")
    if failed is not None:
        rows = rows.join(failed.select("symbol", F.lit(1).alias("_failed")).distinct(), "symbol", "left")
    else:
        rows = rows.withColumn("_failed", F.lit(None).cast("int"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("symbols_requested"),
        F.count("latest_date").alias("symbols_succeeded"),
        F.count_if(F.col("latest_date") >= expected).alias("symbols_fresh"),
        F.max("latest_date").alias("latest_candle_date"),
        F.count("_failed").alias("failed_count"),
    )
    requested, got = F.col("symbols_requested"), F.col("symbols_succeeded")
    share = F.coalesce(F.try_divide(got, requested), F.lit(0.0))
    fresh = F.coalesce(F.col("latest_candle_date") >= expected, F.lit(False))
    degraded = (F.col("failed_count") > 0) | (share < READY_COVERAGE) | (F.col("symbols_fresh") < requested)
    state = (
        F.when(F.lit(updating), "updating")
        .when(requested == 0, "missing")
        .when(~fresh, "stale")
        .when(degraded, "degraded")
        .otherwise("ready")
    )
    return counts.select(
        state.alias("state"),
        (state == "ready").alias("can_publish"),
        "latest_candle_date",
        expected.alias("expected_eod_date"),
        "symbols_requested",
        "symbols_succeeded",
        "symbols_fresh",
        (requested - got).alias("missing_count"),
        "failed_count",
        F.round(share * 100, 1).alias("coverage"),
    )


def symbol_freshness(bars: DataFrame, as_of: dt.date | str) -> DataFrame:
    expected = expected_eod(as_of)
    fresh = F.count_if(F.col("latest_date") >= expected)
    n = F.count(F.lit(1))
    return latest_dates(bars).agg(
        n.alias("checked"),
        fresh.alias("fresh"),
        (n - fresh).alias("stale"),
        F.coalesce(F.round(F.try_divide(fresh * 100.0, n), 1), F.lit(0.0)).alias("coverage_pct"),
    )


def oldest_stale(bars: DataFrame, as_of: dt.date | str, limit: int = 12) -> DataFrame:
    stale = latest_dates(bars).filter(F.col("latest_date") < expected_eod(as_of))
    return stale.orderBy("latest_date", "symbol").limit(limit)


def stale_symbols(bars: DataFrame, universe: DataFrame, target: dt.date | str, market: str = "US") -> DataFrame:
    """Symbols of one market without a bar at the target date or later."""
    names = universe.filter(F.col("market") == market).select("symbol").distinct()
    fresh = bars.filter(F.col("date") >= F.lit(target).cast("date")).select("symbol").distinct()
    return names.join(fresh, "symbol", "left_anti")


def fill_gaps(bars: DataFrame, fallback: DataFrame, universe: DataFrame, target: dt.date | str, market: str = "US") -> DataFrame:
    """Bars plus the newest fallback bar, dated at the target or before, of each stale symbol.

    A fallback bar is added only when it is newer than what the symbol has.
    """
    stale = stale_symbols(bars, universe, target, market).join(latest_dates(bars), "symbol", "left")
    columns = [c for c in bars.columns if c in fallback.columns]
    newest = fallback.filter(F.col("date") <= F.lit(target).cast("date")).groupBy("symbol").agg(
        F.max_by(F.struct(*[c for c in columns if c != "symbol"]), "date").alias("_b")
    )
    added = (
        newest.join(stale, "symbol")
        .filter(F.col("latest_date").isNull() | (F.col("_b.date") > F.col("latest_date")))
        .select("symbol", "_b.*")
    )
    return bars.select(*columns).unionByName(added.select(*columns))


def retain_failed(new: DataFrame, old: DataFrame, failed: DataFrame) -> DataFrame:
    """New rows plus the stored history of symbols whose refresh failed."""
    kept = old.join(failed.select("symbol").distinct(), "symbol", "left_semi")
    return new.unionByName(kept.select(*new.columns))


def publish_ratio(requested: DataFrame, succeeded: DataFrame, minimum: float = 0.97) -> DataFrame:
    """Whether enough of the requested symbols arrived to replace the stored table."""
    flags = requested.select("symbol").distinct().join(
        succeeded.select("symbol", F.lit(1).alias("_ok")).distinct(), "symbol", "left"
    )
    share = F.coalesce(F.try_divide(F.count("_ok"), F.count(F.lit(1))), F.lit(0.0))
    return flags.agg(F.count(F.lit(1)).alias("requested"), F.count("_ok").alias("succeeded"), (share >= minimum).alias("publish"))


def statement_health(universe: DataFrame, coverage: DataFrame, fetched: DataFrame, as_of: dt.date | str) -> DataFrame:
    """One row: state and counts of the statement store over the registered symbols."""
    fresh_from = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 8 DAYS")
    rows = (
        universe.select("symbol").distinct()
        .join(coverage.select("symbol", "status", "annual_complete"), "symbol", "left")
        .join(fetched.select("symbol", "fetched_at"), "symbol", "left")
    )
    n = F.count(F.lit(1))
    cached = F.count_if(F.coalesce("status", F.lit("missing")) != "missing")
    complete = F.count_if(F.col("status") == "complete")
    out = rows.agg(
        n.alias("symbols_requested"),
        cached.alias("cached_symbols"),
        F.count_if(F.col("fetched_at") >= fresh_from).alias("fresh_symbols"),
        F.count_if(F.coalesce("annual_complete", F.lit(False))).alias("annual_5y_symbols"),
        complete.alias("complete_symbols"),
        (cached - complete).alias("partial_symbols"),
        (n - cached).alias("missing_symbols"),
        F.coalesce(F.round(F.try_divide(complete * 100.0, n), 1), F.lit(0.0)).alias("complete_coverage_pct"),
    )
    state = (
        F.when((F.col("symbols_requested") > 0) & (F.col("complete_symbols") == F.col("symbols_requested")), "ready")
        .when(F.col("cached_symbols") > 0, "partial")
        .otherwise("missing")
    )
    return out.withColumn("state", state)


def fx_health(fx: DataFrame, updated_at: Column, as_of: dt.date | str) -> DataFrame:
    """Rates, age in days and state; older than a week is stale."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(updated_at)) / 86400
    out = fx.agg(F.count(F.lit(1)).alias("rates"), F.max(age).alias("_age"))
    state = F.when(F.col("rates") == 0, "missing").when(F.coalesce("_age", F.lit(0.0)) > FX_STALE_DAYS, "stale").otherwise("ready")
    return out.select("rates", F.round("_age", 2).alias("age_days"), state.alias("state"))


def merge_rates(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rates, with the stored one where a currency is missing from the refresh."""
    return new.select("code", F.col("per_usd").alias("_n")).join(old.select("code", F.col("per_usd").alias("_o")), "code", "full_outer").select(
        "code", F.coalesce("_n", "_o").alias("per_usd")
    )


def feed_checks(universe: DataFrame, bars: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Data facts an operator looks at first: counts, newest date, older than five days or not."""
    listed = universe.agg(F.count_distinct("symbol")).scalar()
    age = F.datediff(F.lit(as_of).cast("date"), F.col("latest_date"))
    return feed_stats(bars).select(
        listed.alias("universe_symbols"), F.col("symbols").alias("priced_symbols"), "latest_date", age.alias("age_days"), (age > 5).alias("too_old")
    )
