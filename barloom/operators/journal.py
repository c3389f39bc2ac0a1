"""Paper trades and analyst reviews as tables with rule columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import computed_once

DEFAULT_COST_BPS = 30.0

# Allowed review values and the texts a full profile needs.
REVIEW_STATUSES = ("Watch", "Research", "Approved", "Owned", "Exit")
MOAT_VALUES = ("wide", "strong", "medium", "niche", "weak")
TREND_VALUES = ("leader", "beneficiary", "automation", "neutral", "laggard")
PROFILE_TEXTS = (
    "business_summary", "revenue_model", "revenue_segments", "key_customers", "competitors", "moat_evidence", "risks",
    "invalidation", "thesis",
)


def with_trade_rules(trades: DataFrame) -> DataFrame:
    """Normalized side and symbol, risk %, and the first broken rule in ``error``."""
    side = F.upper(F.coalesce("side", F.lit("BUY")))
    symbol = F.upper(F.trim(F.coalesce("symbol", F.lit(""))))
    entry, stop = F.coalesce("entry", F.lit(0.0)), F.coalesce("stop", F.lit(0.0))
    out = trades.withColumns(
        {"symbol": symbol, "side": F.when(side.isin("BUY", "SELL"), side).otherwise("BUY"), "entry": entry, "stop": stop}
    )
    error = (
        F.when(F.col("symbol") == "", "no_symbol")
        .when(F.col("entry") <= 0, "entry_not_positive")
        .when((F.col("side") == "BUY") & (F.col("stop") >= F.col("entry")), "stop_not_below_entry")
        .when((F.col("side") == "SELL") & (F.col("stop") > 0) & (F.col("stop") <= F.col("entry")), "stop_not_above_entry")
        .when(F.col("exit") <= 0, "exit_not_positive")
    )
    return out.withColumns(
        {
            "error": error,
            "risk_pct": F.coalesce(F.round(F.try_divide(F.abs(F.round(F.col("entry"), 4) - F.round(F.col("stop"), 4)), F.round(F.col("entry"), 4)) * 100, 2), F.lit(0.0)),
        }
    )


def close_trades(trades: DataFrame, cost_bps: float = DEFAULT_COST_BPS) -> DataFrame:
    """Return, net return and R multiple of valid trades that have an exit."""
    valid = with_trade_rules(trades).filter("error is null")
    direction = F.when(F.col("side") == "SELL", -1).otherwise(1)
    gross = (F.col("exit") / F.round(F.col("entry"), 4) - 1) * 100 * direction
    out = computed_once(valid, {"_gross": gross})
    return out.withColumns(
        {
            "state": F.when(F.col("exit").isNotNull(), "closed").otherwise("open"),
            "return_pct": F.round("_gross", 3),
            "return_pct_net": F.round(F.col("_gross") - cost_bps / 100, 3),
            "r_multiple": F.round(F.try_divide(F.col("_gross"), F.nullif("risk_pct", F.lit(0.0))), 2),
        }
    ).drop("_gross", "error")


def rejected_trades(trades: DataFrame) -> DataFrame:
    return with_trade_rules(trades).filter("error is not null")


def journal_summary(closed: DataFrame) -> DataFrame:
    n = F.count("return_pct_net")
    return closed.agg(
        F.count_if(F.col("state") == "open").alias("open_count"),
        F.count_if(F.col("state") == "closed").alias("closed_count"),
        F.round(F.try_divide(F.count_if(F.col("return_pct_net") > 0) * 100.0, n), 2).alias("hit_rate_pct"),
        F.round(F.avg("return_pct_net"), 3).alias("average_return_pct_net"),
        F.round(F.avg("r_multiple"), 2).alias("average_r"),
    )


def newest_first(trades: DataFrame) -> DataFrame:
    return trades.orderBy(F.col("opened_on").desc(), "symbol")


def has_source_url(value: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(value, F.lit("")), r"\r?\n"), lambda x: F.lower(F.trim(x)))
    return F.exists(lines, lambda x: x.startswith("https://") | x.startswith("http://"))


def with_review_verification(reviews: DataFrame) -> DataFrame:
    """Moat and trend make a review; nine texts and a web source make a full profile."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    reviewed = (F.coalesce("moat", F.lit("")) != "") & (F.coalesce("ai_trend", F.lit("")) != "")
    texts = F.lit(True)
    for name in PROFILE_TEXTS:
        texts = texts & filled(F.col(name))
    out = reviews.withColumn("research_verified", reviewed)
    return out.withColumn("company_profile_verified", F.col("research_verified") & texts & has_source_url(F.col("source_urls")))


def with_review_rules(reviews: DataFrame) -> DataFrame:
    """Verification plus the first broken rule of a submitted review in ``error``."""
    out = with_review_verification(reviews)
    moat, trend = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("moat", "ai_trend"))
    error = (
        F.when(F.trim(F.coalesce("symbol", F.lit(""))) == "", "no_symbol")
        .when(~F.col("status").isin(*REVIEW_STATUSES), "invalid_status")
        .when((moat != "") & ~moat.isin(*MOAT_VALUES), "invalid_moat")
        .when((trend != "") & ~trend.isin(*TREND_VALUES), "invalid_trend")
        .when(F.col("fair_value") < 0, "negative_fair_value")
        .when(F.col("status").isin("Approved", "Owned") & ~F.col("company_profile_verified"), "profile_incomplete")
    )
    return out.withColumn("error", error)


def with_default_reviews(symbols: DataFrame, reviews: DataFrame) -> DataFrame:
    """A review row for every symbol: stored fields over the blank record."""
    defaults = {"status": "Watch", "fair_value": 0.0, "research_verified": False, "company_profile_verified": False}
    out = symbols.select("symbol").join(reviews, "symbol", "left")
    for name, kind in reviews.dtypes:
        if name == "symbol":
            continue
        fallback = defaults.get(name, "" if kind == "string" else None)
        if fallback is not None:
            out = out.withColumn(name, F.coalesce(name, F.lit(fallback)))
    return out
