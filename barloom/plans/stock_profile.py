"""The company profile: business, quality, price, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import computed_once
from barloom.operators import profile as P
from barloom.operators.asof import asof_join


def stock_profiles(annual: DataFrame, bars: DataFrame, names: DataFrame, fx: DataFrame) -> DataFrame:
    """One row per symbol with at least two annual periods.

    ``annual``: the newest annual periods with ratios. ``names``: symbol, sector,
    trading_currency, reporting_currency, analyst_fair_value,
    company_profile_verified.
    """
    arrays = P.period_arrays(annual).filter(F.size("a") >= 2).join(names, "symbol")
    arrays = P.with_currency_rates(arrays, fx)
    ends = annual.select("symbol", F.col("period_end").alias("date"))
    closes = asof_join(ends, bars.select("symbol", "date", "close"), ["close"])
    latest = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("last_price"), F.max("date").alias("price_as_of"))
    out = P.with_pe_history(arrays, closes).join(latest, "symbol", "left")
    scaled_equity = F.coalesce(P.last_of("stockholders_equity"), F.lit(0.0))
    out = computed_once(
        out,
        {
            "price": P.in_reporting(F.col("last_price")),
            "book_per_share": F.nullif(F.try_divide(scaled_equity, P.last_of("shares")), F.lit(0.0)),
            "analyst_value": F.when(F.col("analyst_fair_value") != 0, P.in_reporting(F.col("analyst_fair_value"))),
            "revenue_cagr": P.end_cagr("total_revenue"),
            "profit_cagr": P.end_cagr("net_income"),
            "eps_cagr": P.end_cagr("basic_eps"),
            "profit_volatility": P.profit_volatility(),
            "turned_profitable": P.turned_profitable(),
        },
    )
    out = P.with_stages(out)
    out = computed_once(
        out,
        {
            "pbv": F.when((F.col("book_per_share") > 0) & (F.col("price") != 0), F.col("price") / F.col("book_per_share")),
            "methods": P.valuation_methods(),
        },
    )
    estimates = F.sort_array(
        F.transform(F.filter("methods", lambda m: m["counts"] & (m["fair_value"] != 0)), lambda m: m["fair_value"])
    )
    out = computed_once(out, {"estimates": estimates})
    low, high = F.array_min("estimates"), F.array_max("estimates")
    spread = F.when((F.size("estimates") > 1) & (low > 0), high / low).otherwise(1.0)
    out = computed_once(out, {"fair_value": P.median_of(F.col("estimates")), "spread": spread})
    margin = F.when(
        (F.col("fair_value") > 0) & (F.col("price") != 0), (F.col("fair_value") - F.col("price")) / F.col("fair_value") * 100
    )
    out = computed_once(
        out,
        {
            "margin_of_safety": margin,
            "estimates_agree": F.col("spread") <= P.VALUATION_SPREAD_LIMIT,
            "company_type": P.company_type(F.col("pbv")),
            "quality_ok": F.col("passed_stages") == len(P.STAGES),
            "business_ok": F.coalesce("company_profile_verified", F.lit(False)),
        },
    )
    price_ok = F.coalesce(F.col("margin_of_safety") >= P.MARGIN_OF_SAFETY_TARGET, F.lit(False)) & F.col("estimates_agree")
    out = computed_once(out, {"price_ok": price_ok, "value_ok": F.col("fair_value").isNotNull() & F.col("estimates_agree")})
    verdict = (
        F.when(~F.col("quality_ok"), "avoid")
        .when(~F.col("business_ok"), "research")
        .when(F.col("price_ok"), "buy")
        .otherwise("wait")
    )
    checks = [F.col(c) for c in ("quality_ok", "business_ok", "value_ok", "price_ok")]
    return out.select(
        "symbol",
        "sector",
        P.sector_trend(F.col("sector")).alias("sector_trend"),
        "price_as_of",
        F.round("last_price", 4).alias("last_price"),
        F.round("price", 4).alias("price_in_reporting"),
        "reporting_currency",
        (F.col("price").isNotNull() & (F.col("trading_currency") != F.col("reporting_currency"))).alias("fx_adjusted"),
        F.concat_ws("-", F.year(P.first_of("period_end")).cast("string"), F.year(P.last_of("period_end")).cast("string")).alias("statement_period"),
        "company_type",
        *P.STAGES,
        *[P.state(F.col(c)).alias(c) for parts in P.STAGES.values() for c in parts],
        "passed_stages",
        *[F.round(c, 4).alias(c) for c in ("revenue_cagr", "profit_cagr", "eps_cagr", "profit_volatility")],
        F.round(P.last_of("roic"), 4).alias("roic"),
        F.struct(
            P.growth_stat("total_revenue").alias("revenue"), P.growth_stat("net_income").alias("net_income"), P.growth_stat("basic_eps").alias("eps")
        ).alias("growth_snapshot"),
        P.series_summary().alias("series_summary"),
        "pe_history",
        "methods",
        F.round("fair_value", 4).alias("fair_value"),
        F.round(low, 4).alias("fair_value_low"),
        F.round(high, 4).alias("fair_value_high"),
        F.round("spread", 2).alias("spread"),
        "estimates_agree",
        F.round("pbv", 2).alias("pbv"),
        F.round("book_per_share", 4).alias("book_value_per_share"),
        F.round("margin_of_safety", 2).alias("margin_of_safety_pct"),
        verdict.alias("verdict"),
        F.array(*checks).alias("checklist"),
        sum((c.cast("int") for c in checks), F.lit(0)).alias("passed_checks"),
    )
