"""Ten-year contribution plans: a lump sum, then a fixed amount every month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.functions.numeric import computed_once
from barloom.functions.xirr import with_xirr
from barloom.session import cut_lineage

# Securities whose predecessor equity was cancelled.
HISTORY_BREAKS = [("CHRD", "2020-11-20", "predecessor shares cancelled in 2020; the later listing is not the same holding")]


def adjusted_close() -> Column:
    return F.coalesce("adjusted_close", "close", F.lit(0.0))


def purchase_price() -> Column:
    return F.coalesce(F.col("adjusted_open"), adjusted_close())


def plan_start(as_of: Column, years: int = 10) -> Column:
    """First of the month, ``years`` back."""
    return F.add_months(F.trunc(as_of, "MM"), -12 * years)


def breaks_table(spark) -> DataFrame:
    return spark.createDataFrame(HISTORY_BREAKS, "symbol string, valid_from string, reason string").withColumn(
        "valid_from", F.col("valid_from").cast("date")
    )


def continuity_issues(symbols: DataFrame, breaks: DataFrame, as_of: Column, years: int = 10) -> DataFrame:
    """Symbols whose history was broken inside the plan's window."""
    hit = breaks.select(F.upper("symbol").alias("_s"), "valid_from", "reason")
    return symbols.join(hit, F.upper("symbol") == F.col("_s")).filter(plan_start(as_of, years) < F.col("valid_from")).drop("_s")


def monthly_records(bars: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per (symbol, month): price paid at the first bar, close of the last.

    Bars without both adjusted prices, or with a non-positive one, are skipped.
    """
    usable = bars.filter("adjusted_close > 0 and adjusted_open > 0")
    if as_of is not None:
        usable = usable.filter(F.col("date") <= as_of)
    return (
        usable.groupBy("symbol", F.trunc("date", "MM").alias("contribution_date"))
        .agg(
            F.max("date").alias("latest_date"),
            F.min_by("adjusted_open", "date").alias("purchase_price"),
            F.max_by("adjusted_close", "date").alias("close"),
        )
    )


def evaluate_plans(
    bars: DataFrame,
    as_of: dt.date | str | Column,
    *,
    initial: float = 100_000.0,
    monthly: float = 5_000.0,
    years: int = 10,
    min_months: int = 120,
) -> DataFrame:
    """Value, gain and money-weighted return of the plan for every symbol with a full history.

    A history has at least ``min_months`` consecutive months, starts within 45
    days of the window's start and ends within 45 days of ``as_of``. Months are
    reduced first, so a symbol's array holds at most ``12 * years + 1`` rows.
    """
    day = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("date")
    start = plan_start(day, years)
    months = monthly_records(bars, day).filter(F.col("contribution_date") >= start)
    number = F.year("contribution_date") * 12 + F.month("contribution_date")
    grouped = months.groupBy("symbol").agg(
        F.count(F.lit(1)).cast("int").alias("months"),
        (F.max(number) - F.min(number) + 1).alias("_span"),
        F.min("contribution_date").alias("start_date"),
        F.max("latest_date").alias("end_date"),
        F.min_by("purchase_price", "contribution_date").alias("_first"),
        F.max_by("close", "contribution_date").alias("_last"),
        F.sum(1.0 / F.col("purchase_price")).alias("_per_unit"),
        F.sort_array(F.collect_list(F.struct(F.col("contribution_date").alias("d"), F.col("close").alias("c")))).alias("_m"),
    )
    kept = grouped.filter(
        (F.col("months") >= min_months)
        & (F.col("_span") == F.col("months"))
        & (F.datediff(F.col("start_date"), start) <= 45)
        & (F.datediff(day, F.col("end_date")) <= 45)
    )
    shares = F.lit(initial) / F.col("_first") + (F.col("_per_unit") - 1.0 / F.col("_first")) * monthly
    value = shares * F.col("_last")
    payments = F.transform(
        "_m", lambda m, i: F.struct(m["d"].alias("d"), F.when(i == 0, F.lit(-initial)).otherwise(F.lit(-monthly)).alias("a"))
    )
    flows = F.concat(payments, F.array(F.struct(F.col("end_date").alias("d"), F.col("ending_value").alias("a"))))
    out = computed_once(kept, {"ending_value": value})
    out = with_xirr(out, flows, "annualized").filter("annualized is not null")
    invested = F.lit(initial) + F.lit(monthly) * (F.col("months") - 1)
    span = F.greatest(F.datediff("end_date", "start_date") / 365.2425, F.lit(0.01))
    fall = F.aggregate(
        "_m",
        F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst")),
        lambda s, m: F.struct(
            F.greatest(s["peak"], m["c"]).alias("peak"),
            F.least(s["worst"], m["c"] / F.greatest(s["peak"], m["c"]) - 1).alias("worst"),
        ),
        lambda s: -s["worst"] * 100,
    )
    return out.select(
        "symbol",
        "start_date",
        "end_date",
        "months",
        (F.col("months") - 1).alias("dca_payments"),
        F.round(span, 2).alias("years"),
        F.round(invested, 2).alias("total_invested"),
        F.round("ending_value", 2).alias("ending_value"),
        F.round(F.col("ending_value") - invested, 2).alias("profit"),
        F.round(F.try_divide(F.col("ending_value") - invested, invested) * 100, 2).alias("total_gain_pct"),
        F.round(F.try_divide(F.col("ending_value"), invested), 2).alias("wealth_multiple"),
        (F.col("annualized") * 100).alias("annualized_return_pct"),
        F.round((F.pow(F.col("_last") / F.col("_first"), 1 / span) - 1) * 100, 2).alias("price_cagr_pct"),
        F.round(fall, 2).alias("max_monthly_drawdown_pct"),
    )


def rank_leaders(plans: DataFrame, min_return: float = 15.0) -> DataFrame:
    """1-based rank by return, value, symbol among plans that reach ``min_return``.

    Ranks come from a range-partitioned sort with per-partition counts, so no
    single task sees all rows.
    """
    kept = plans.filter(F.col("annualized_return_pct") >= min_return)
    return global_rank(kept, [F.col("annualized_return_pct").desc(), F.col("ending_value").desc(), F.col("symbol").asc()])


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Row numbers over the whole table without one global window partition.

    Rows are range-partitioned by the order, numbered inside their partition and
    shifted by the size of the partitions before it. Range bounds are drawn from a
    sample each time an exchange runs, so the dealt rows are written once, with
    their partition's number, and both the counts and the rows read that.
    ``partitions`` defaults to the session's shuffle partitions.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The sample for the bounds reads the table once more: it is written, not computed twice.
    df = cut_lineage(df)
    ranged = cut_lineage(df.repartitionByRange(count, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a table of fixed size.
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return (
        numbered.join(F.broadcast(before), "_p")
        .withColumn(name, (F.col("_i") + F.col("_before")).cast("int"))
        .drop("_p", "_i", "_before")
    )
