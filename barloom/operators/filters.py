"""Predicates on listings and result rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_set(groups: Column) -> Column:
    """Pipe- or comma-separated text to an upper-case array without blanks."""
    parts = F.transform(F.split(F.coalesce(groups, F.lit("")), r"[|,]"), lambda g: F.upper(F.trim(g)))
    return F.filter(parts, lambda g: g != "")


def in_market(market: Column, wanted: str) -> Column:
    return F.lit(True) if wanted.upper() == "ALL" else F.upper(market) == wanted.upper()


def in_universe(groups: Column, wanted: str) -> Column:
    return F.lit(True) if wanted.upper() == "ALL" else F.array_contains(group_set(groups), wanted.upper())


def eligible(listing: DataFrame, market: str = "ALL", universe: str = "ALL") -> DataFrame:
    out = listing.filter(in_market(F.col("market"), market))
    return out.filter(in_universe(F.col("index_groups"), universe)) if universe.upper() != "ALL" else out


def any_group(groups: Column, wanted: list[str]) -> Column:
    """True when the symbol is in at least one wanted group."""
    return F.arrays_overlap(group_set(groups), F.array(*[F.lit(g.strip().upper()) for g in wanted]))


def select_targets(
    listing: DataFrame,
    markets: list[str] | None = None,
    groups: list[str] | None = None,
    symbols: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Symbols chosen by market, group and explicit list; ``limit`` keeps the first by symbol."""
    out = listing
    if markets:
        out = out.filter(F.upper("market").isin([m.upper() for m in markets]))
    if groups:
        out = out.filter(any_group(F.col("index_groups"), groups))
    if symbols:
        out = out.filter(F.upper("symbol").isin([s.upper() for s in symbols]))
    return out.orderBy("symbol").limit(limit) if limit is not None else out


def is_symbol(value: Column) -> Column:
    return value.rlike(r"^[A-Z0-9.\-]{1,12}$")


def expected_eod(as_of: dt.date | str | Column) -> Column:
    """Yesterday, stepped back over a weekend; exchange holidays are not known."""
    day = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("date")
    # weekday(): Monday is 0. Yesterday of a Monday is a Sunday, of a Sunday a Saturday.
    back = F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1)
    return F.date_sub(day, back)


def is_fresh(latest: Column, expected: Column) -> Column:
    return latest >= expected
