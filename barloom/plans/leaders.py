"""Long-run leaders: ranked ten-year contribution plans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.contribution import breaks_table, continuity_issues, evaluate_plans, rank_leaders
from barloom.operators.filters import eligible


def long_run_leaders(
    bars: DataFrame,
    listing: DataFrame,
    as_of: dt.date | str,
    *,
    min_return: float = 15.0,
    market: str = "ALL",
    universe: str = "ALL",
    breaks: DataFrame | None = None,
    years: int = 10,
    min_months: int = 120,
) -> DataFrame:
    """Listed symbols whose plan returned at least ``min_return`` percent a year, ranked."""
    names = eligible(listing, market, universe)
    day = F.lit(as_of).cast("date")
    breaks = breaks if breaks is not None else breaks_table(bars.sparkSession)
    broken = continuity_issues(names.select("symbol"), breaks, day, years).select("symbol")
    usable = bars.join(names.select("symbol"), "symbol", "left_semi").join(broken, "symbol", "left_anti")
    plans = evaluate_plans(usable, as_of, years=years, min_months=min_months)
    ranked = rank_leaders(plans, min_return)
    return ranked.join(names.select("symbol", "name", "market", "sector", "index_groups"), "symbol")


def leader_counts(plans: DataFrame, listing: DataFrame, broken: DataFrame, min_return: float) -> DataFrame:
    """Universe, evaluated, qualified and excluded counts in one row."""
    flags = (
        listing.select("symbol")
        .join(plans.select("symbol", "annualized_return_pct"), "symbol", "left")
        .join(broken.select("symbol", F.lit(True).alias("_broken")), "symbol", "left")
    )
    evaluated = F.count("annualized_return_pct")
    excluded = F.count("_broken")
    return flags.agg(
        F.count(F.lit(1)).alias("universe_count"),
        evaluated.alias("evaluated"),
        F.count_if(F.col("annualized_return_pct") >= min_return).alias("qualified"),
        excluded.alias("excluded_corporate_actions"),
        (F.count(F.lit(1)) - evaluated - excluded).alias("insufficient_history"),
    )


def podium(leaders: DataFrame, n: int = 3) -> DataFrame:
    return leaders.orderBy("rank").limit(n)


def search(leaders: DataFrame, term: str) -> DataFrame:
    """Leaders whose symbol or name contains the text, case-insensitive."""
    text = F.lower(F.concat_ws(" ", "symbol", "name"))
    return leaders.filter(text.contains(term.strip().lower()))
