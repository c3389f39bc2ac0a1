"""Ticks and reference tables derived from the order tables used for checks.

``lineitem`` plays the tick feed (supplier = symbol), ``supplier`` with
``nation`` and ``region`` the listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]

# Listing market and symbol suffix by region key.
REGION_MARKET = {0: "US", 1: "TH", 2: "HK", 3: "CN", 4: "UK"}
REGION_SUFFIX = {0: "", 1: ".BK", 2: ".HK", 3: ".SS", 4: ".L"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _symbol(key: str):
    return F.concat(F.lit("S"), F.col(key).cast("string"))


def unit_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Price per unit, size = quantity."""
    return table(spark, folder, "lineitem").select(
        _symbol("l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        *TICK_ORDER,
    )


def value_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Price = extended price; averages of it move slowly enough to form shapes."""
    return table(spark, folder, "lineitem").select(
        _symbol("l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("size"),
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """symbol, name, market, suffix, sector, index_groups for every supplier."""
    market = F.element_at(F.create_map(*[F.lit(x) for kv in REGION_MARKET.items() for x in kv]), F.col("n_regionkey"))
    suffix = F.element_at(F.create_map(*[F.lit(x) for kv in REGION_SUFFIX.items() for x in kv]), F.col("n_regionkey"))
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            _symbol("s_suppkey").alias("symbol"),
            F.col("s_name").alias("name"),
            market.alias("market"),
            suffix.alias("suffix"),
            F.col("n_name").alias("sector"),
            F.concat_ws("|", F.col("r_name"), F.concat(F.lit("G"), (F.col("s_suppkey") % 3).cast("string"))).alias(
                "index_groups"
            ),
            F.col("s_acctbal").alias("account_balance"),
        )
    )
