"""One snapshot row per symbol: listing, statements, reviews, currency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.currency import trading_currency

# What a symbol without fundamentals is given.
PLACEHOLDER = {
    "roe": 0.0, "roa": 0.0, "debt_to_equity": 0.0, "revenue_growth": 0.0, "profit_growth": 0.0, "gross_margin": 0.0,
    "net_margin": 0.0, "eps": 0.0, "book_value_per_share": 0.0, "dividend_yield": 0.0, "liquidity_score": 80.0,
    "analyst_fair_value": 0.0, "moat": "not evaluated", "ai_trend": "not evaluated", "thesis": "",
    "research_status": "Watch", "fundamentals_verified": False, "financial_history_complete": False,
    "research_verified": False, "reporting_currency": "", "source": "Not loaded",
}


def symbols_of(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def overlay(base: DataFrame, update: DataFrame, on: str = "symbol", blank_keeps: bool = True) -> DataFrame:
    """Left join where the update's non-NULL values win over the base's."""
    shared = [c for c in update.columns if c != on and c in base.columns]
    extra = [c for c in update.columns if c != on and c not in base.columns]
    renamed = update.select(on, *[F.col(c).alias(f"_u_{c}") for c in shared], *extra)
    joined = base.join(renamed, on, "left")
    picked = {}
    for c in shared:
        new = F.col(f"_u_{c}")
        if blank_keeps and dict(update.dtypes)[c] == "string":
            new = F.nullif(new, F.lit(""))
        picked[c] = F.coalesce(new, F.col(c))
    return joined.withColumns(picked).drop(*[f"_u_{c}" for c in shared])


def assemble(
    symbols: DataFrame,
    listing: DataFrame,
    fundamentals: DataFrame | None = None,
    statements: DataFrame | None = None,
    reviews: DataFrame | None = None,
    currencies: DataFrame | None = None,
) -> DataFrame:
    """Fundamentals for every priced symbol, placeholders where none exist.

    Precedence: listing over fundamentals for market and groups, statements over
    fundamentals for figures, reviews for business quality.
    """
    # The listing's name and sector only fill what fundamentals leave open.
    meta = listing.select(
        "symbol", F.col("name").alias("_name"), F.col("market").alias("_market"), F.col("sector").alias("_sector"),
        F.col("index_groups").alias("_groups"),
    )
    out = symbols.select("symbol")
    if fundamentals is not None:
        out = out.join(fundamentals, "symbol", "left")
    out = out.join(meta, "symbol", "left")

    def have(name: str):
        return F.nullif(F.col(name), F.lit("")) if name in out.columns else F.lit(None).cast("string")

    known = F.col("name").isNotNull() if "name" in out.columns else F.lit(False)
    out = out.withColumns(
        {
            "name": F.coalesce(have("name"), F.nullif(F.col("_name"), F.lit("")), F.col("symbol")),
            "market": F.coalesce(F.nullif(F.col("_market"), F.lit("")), have("market"), F.lit("US")),
            "sector": F.coalesce(have("sector"), F.when(~known, F.nullif(F.col("_sector"), F.lit(""))), F.lit("Unknown")),
            "index_groups": F.coalesce(F.col("_groups"), have("index_groups"), F.lit("")),
        }
    ).drop("_name", "_market", "_sector", "_groups")
    out = out.withColumns(
        {k: F.coalesce(F.col(k), F.lit(v)) if k in out.columns else F.lit(v) for k, v in PLACEHOLDER.items()}
    )
    if statements is not None:
        out = overlay(out, statements)
    if reviews is not None:
        renamed = reviews.select(
            "symbol",
            *[F.col(a).alias(b) for a, b in (
                ("moat", "moat"), ("ai_trend", "ai_trend"), ("fair_value", "analyst_fair_value"), ("thesis", "thesis"),
                ("status", "research_status"), ("research_verified", "research_verified")) if a in reviews.columns],
        )
        out = overlay(out, renamed)
    if currencies is not None:
        out = overlay(out, currencies)
    if "trading_currency" not in out.columns:
        out = out.withColumn("trading_currency", trading_currency(F.col("symbol"), F.col("market")))
    return out
