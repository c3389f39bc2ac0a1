"""Statements, reviews and rates derived from the order tables used for checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.currency import trading_currency
from barloom.sources.trade_ticks import listing, table

LINES = (
    "total_revenue", "cost_of_revenue", "gross_profit", "operating_income", "pretax_income", "tax_provision", "net_income",
    "basic_eps", "total_assets", "total_liabilities", "total_debt", "stockholders_equity", "operating_cash_flow",
    "capital_expenditure", "free_cash_flow",
)


def _sums() -> list[Column]:
    price = F.col("l_extendedprice")

    def total(value: Column, name: str) -> Column:
        return F.round(F.sum(value), 6).alias(name)

    return [
        total(price, "total_revenue"),
        total(price * 0.6 * (1 - F.col("l_discount")), "cost_of_revenue"),
        total(price * (F.col("l_discount") - 0.02), "operating_income"),
        total(price * (F.col("l_discount") - 0.03), "pretax_income"),
        total(price * 0.01, "tax_provision"),
        total(price * (F.col("l_discount") - 0.04), "net_income"),
        total(price * (F.col("l_tax") - 0.02), "operating_cash_flow"),
        total(F.col("l_quantity") * -20, "capital_expenditure"),
        total(F.col("l_quantity") * 100, "total_debt"),
    ]


def _derived(df: DataFrame) -> DataFrame:
    out = df.withColumns(
        {
            "gross_profit": F.round(F.col("total_revenue") - F.col("cost_of_revenue"), 6),
            "basic_eps": F.round(F.col("net_income") / 10, 6),
            "total_assets": F.round(F.col("total_revenue") * 0.5 + 100000, 6),
            "stockholders_equity": F.round(F.col("total_revenue") * 0.1 + F.col("s_acctbal") * 20, 6),
            "free_cash_flow": F.round(F.col("operating_cash_flow") + F.col("capital_expenditure"), 6),
        }
    )
    return out.withColumn("total_liabilities", F.round(F.col("total_assets") - F.col("stockholders_equity"), 6))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.year("l_shipdate").alias("fiscal_year"), F.quarter("l_shipdate").alias("q"),
    )


def _with_supplier(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return df.join(supplier, df.l_suppkey == supplier.s_suppkey).withColumn(
        "symbol", F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    )


def annual_statements(spark: SparkSession, d: str) -> DataFrame:
    sums = _lines(spark, d).groupBy("l_suppkey", "fiscal_year").agg(*_sums())
    return _derived(_with_supplier(sums, spark, d)).select(
        "symbol", "fiscal_year", F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("period_end"), *LINES
    )


def quarterly_statements(spark: SparkSession, d: str) -> DataFrame:
    """Every second supplier files no Q4, some skip Q2, some report less than their annual total."""
    key = F.col("l_suppkey")
    rows = _lines(spark, d).filter((key % 5 != 0) | (F.col("l_discount") < 0.09))
    sums = rows.filter(~((key % 2 == 1) & (F.col("q") == 4)) & ~((key % 7 == 3) & (F.col("q") == 2)))
    sums = sums.groupBy("l_suppkey", "fiscal_year", "q").agg(*_sums())
    end = F.last_day(F.make_date("fiscal_year", F.col("q") * 3, F.lit(1)))
    return _derived(_with_supplier(sums, spark, d)).select(
        "symbol", "fiscal_year", F.concat(F.lit("Q"), F.col("q").cast("string")).alias("quarter"), end.alias("period_end"), *LINES
    )


def currencies(spark: SparkSession, d: str) -> DataFrame:
    """symbol, trading_currency, reporting_currency (every fourth supplier reports in USD)."""
    rows = listing(spark, d)
    number = F.substring("symbol", 2, 20).cast("long")
    quoted = trading_currency(F.concat("symbol", "suffix"), F.col("market"))
    return rows.select(
        "symbol", quoted.alias("trading_currency"), F.when(number % 4 == 0, "USD").otherwise(quoted).alias("reporting_currency")
    )


# Rates used in checks; CNY is left out on purpose.
RATES = {"THB": 32.0, "HKD": 7.8, "GBP": 0.78}


def fx_rates(spark: SparkSession, d: str) -> DataFrame:
    """code, per_usd for the markets that have a rate, one row per region with one."""
    region = table(spark, d, "region")
    code = {1: "THB", 2: "HKD", 4: "GBP"}
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in code.items() for x in kv]), F.col("r_regionkey"))
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv]), F.col("code"))
    return region.filter(F.col("r_regionkey").isin(*code)).select(mapped.alias("code")).withColumn("per_usd", rate)


def reviews(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier")
    n = F.col("s_suppkey")
    moats = F.array(*[F.lit(m) for m in ("wide", "strong", "medium", "niche", "none")])
    trends = F.array(*[F.lit(m) for m in ("leader", "beneficiary", "neutral", "laggard")])
    return rows.select(
        F.concat(F.lit("S"), n.cast("string")).alias("symbol"),
        F.element_at(moats, (n % 5 + 1).cast("int")).alias("moat"),
        F.element_at(trends, (n % 4 + 1).cast("int")).alias("ai_trend"),
        F.when(n % 2 == 0, (n % 10) * 10000.0 + 20000.0).otherwise(0.0).alias("fair_value"),
        F.when(n % 3 == 0, "Approved").otherwise("Watch").alias("status"),
        (n % 3 == 0).alias("research_verified"),
    )
