"""P/E, P/BV and upside from filed statements and the live price, in one currency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.currency import convert, price_scale, with_rate
from barloom.functions.numeric import computed_once


def derive_valuation(snapshots: DataFrame, fx: DataFrame, price: str = "last_price") -> DataFrame:
    """Add pe, pbv, upside_pct, fx_adjusted, fx_rate, valuation_verified, valuation_note.

    Needs symbol, trading_currency, reporting_currency, eps,
    book_value_per_share, analyst_fair_value, fundamentals_verified and the
    price. Multiples stay NULL unless both legs are in one currency.
    """
    out = snapshots.withColumns(
        {
            "_trading": F.upper(F.trim(F.coalesce("trading_currency", F.lit("")))),
            "_reporting": F.upper(F.trim(F.coalesce("reporting_currency", F.lit("")))),
        }
    )
    out = with_rate(out, fx, "_trading", "_from")
    out = with_rate(out, fx, "_reporting", "_to")
    last = F.col(price)
    quoted = last * price_scale(F.col("symbol"))
    same = F.col("_trading") == F.col("_reporting")
    aligned = F.when(same, quoted).otherwise(
        convert(quoted, F.col("_trading"), F.col("_reporting"), F.col("_from"), F.col("_to"))
    )
    fair = F.expr("nullif(analyst_fair_value, 0D)")
    reason = (
        F.when(~F.coalesce("fundamentals_verified", F.lit(False)), "statements_not_verified")
        .when(F.col("_reporting") == "", "no_reporting_currency")
        .when(last.isNull() | (last <= 0), "no_last_price")
        .when(F.col("_aligned").isNull(), "no_exchange_rate")
    )
    out = computed_once(out, {"_aligned": aligned})
    out = computed_once(out, {"_reason": reason})
    open_for = F.col("_reason").isNull()
    pe = F.when(open_for & (F.col("eps") > 0), F.round(F.col("_aligned") / F.col("eps"), 2))
    pbv = F.when(
        open_for & (F.col("book_value_per_share") > 0), F.round(F.col("_aligned") / F.col("book_value_per_share"), 2)
    )
    converted = open_for & ~F.col("_trading").eqNullSafe(F.col("_reporting"))
    out = computed_once(
        out,
        {
            "pe": pe,
            "pbv": pbv,
            "upside_pct": F.when(fair.isNotNull() & (last != 0), F.round((fair / last - 1) * 100, 2)),
            "fx_adjusted": F.coalesce(converted, F.lit(False)),
            "fx_rate": F.when(converted, F.round(F.try_divide(F.col("_aligned"), quoted), 6)),
        },
    )
    verified = F.col("_reason").isNull() & (F.col("pe").isNotNull() | F.col("pbv").isNotNull())
    note = (
        F.when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(~F.col("valuation_verified"), "no_eps_or_equity")
        .when(F.col("pe").isNull(), "book_value_only")
        .when(F.col("fx_adjusted"), "converted_to_reporting_currency")
        .otherwise("same_currency")
    )
    out = computed_once(out, {"valuation_verified": verified}).withColumn("valuation_note", note)
    return out.drop("_trading", "_reporting", "_from", "_to", "_aligned", "_reason")
