"""Financial statements: ratios, quarter derivation, growth summary, coverage.

A wide period table has ``symbol, fiscal_year (int), period_end (date)`` and one
DOUBLE column per metric; quarters add ``quarter``. Long tables carry
``metric, value`` instead, which is what Q4 derivation and merging work on.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barloom.functions.currency import currency_label, currency_name, trading_currency
from barloom.functions.numeric import compound_growth, ratio, snapshot_growth, statement_growth
from barloom.session import cut_lineage

# Statement lines and how they behave.
METRICS = (
    "total_revenue", "cost_of_revenue", "gross_profit", "operating_income", "pretax_income", "tax_provision",
    "net_income", "basic_eps", "total_assets", "current_assets", "total_liabilities", "current_liabilities",
    "total_debt", "stockholders_equity", "cash_and_equivalents", "operating_cash_flow", "capital_expenditure",
    "free_cash_flow",
)
FLOW_METRICS = (
    "total_revenue", "cost_of_revenue", "gross_profit", "operating_income", "pretax_income", "tax_provision",
    "net_income", "operating_cash_flow", "capital_expenditure", "free_cash_flow",
)
PER_SHARE_METRICS = ("basic_eps",)
CORE_METRICS = ("total_revenue", "net_income", "total_assets", "total_liabilities", "stockholders_equity")
RATIOS = ("roe", "roa", "net_margin", "gross_margin", "debt_to_equity", "fcf_margin")
QUARTERS = ("Q1", "Q2", "Q3", "Q4")
MINIMUM_EQUITY_TO_ASSETS = 0.01


def by_period(order: str = "period_end"):
    return Window.partitionBy("symbol").orderBy(order)


def with_all_metrics(periods: DataFrame) -> DataFrame:
    """Add the metric columns a source does not have as NULL."""
    missing = {m: F.lit(None).cast("double") for m in METRICS if m not in periods.columns}
    return periods.withColumns(missing) if missing else periods


def to_long(periods: DataFrame) -> DataFrame:
    """Wide periods to one row per known metric."""
    present = [m for m in METRICS if m in periods.columns]
    keys = [c for c in periods.columns if c not in METRICS]
    return periods.unpivot(keys, present, "metric", "value").filter("value is not null")


def to_wide(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; the metric list is fixed, so no pass is needed to find it."""
    return facts.groupBy(*keys).pivot("metric", list(METRICS)).agg(F.max("value"))


def last_periods(periods: DataFrame, n: int = 5) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.col("period_end").desc())
    return periods.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")


def merge_period_metrics(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Per (symbol, period_end, metric): the newer value where there is one, else the older.

    Long tables ``symbol, period_end, metric, value``.
    """
    both = older.withColumn("_v", F.lit(0)).unionByName(newer.withColumn("_v", F.lit(1)))
    return (
        both.filter("value is not null")
        .groupBy("symbol", "period_end", "metric")
        .agg(F.max_by("value", "_v").alias("value"))
    )


def equity_is_usable(equity: Column, assets: Column) -> Column:
    """Positive equity that is at least 1% of assets; unknown assets do not disqualify."""
    thin = F.coalesce(F.try_divide(equity, F.nullif(assets, F.lit(0.0))) < MINIMUM_EQUITY_TO_ASSETS, F.lit(False))
    return F.coalesce(equity > 0, F.lit(False)) & ~thin


def add_ratios(periods: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Return and margin ratios in percent; balance items averaged with the period before."""
    w = Window.partitionBy(*keys).orderBy("period_end")

    def averaged(name: str) -> Column:
        before = F.lag(name, 1).over(w)
        return F.coalesce((F.col(name) + before) / 2, F.col(name))

    out = with_all_metrics(periods).withColumns(
        {"_equity": averaged("stockholders_equity"), "_assets": averaged("total_assets")}
    )
    equity, assets = F.col("stockholders_equity"), F.col("total_assets")
    roe_ok = equity_is_usable(F.col("_equity"), F.col("_assets"))
    de_ok = equity_is_usable(equity, assets)
    net, revenue = F.col("net_income"), F.col("total_revenue")
    return out.withColumns(
        {
            "roe": F.when(roe_ok, ratio(net, F.col("_equity"))),
            "roa": ratio(net, F.col("_assets")),
            "net_margin": ratio(net, revenue),
            "gross_margin": ratio(F.col("gross_profit"), revenue),
            "debt_to_equity": F.when(de_ok, ratio(F.col("total_debt"), equity, 1.0)),
            "fcf_margin": ratio(F.col("free_cash_flow"), revenue),
            "roe_withheld": ~roe_ok & F.col("_equity").isNotNull(),
            "debt_to_equity_withheld": ~de_ok & equity.isNotNull(),
            "negative_equity": F.coalesce(equity <= 0, F.lit(False)),
        }
    ).drop("_equity", "_assets")


def quarter_name(period_end: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Q"), F.quarter(period_end).cast("string")), F.lit("Q?"))


def align_quarters(quarters: DataFrame, annual: DataFrame) -> DataFrame:
    """Fiscal year and quarter from the distance to the annual period that encloses it.

    The enclosing year ends 0..330 days after the quarter; where there is none,
    a quarter 45..310 days after the last annual period belongs to the next
    year and others are dropped. Both sides are joined on the symbol; an annual
    list holds a handful of periods, so the range condition adds no blow-up.
    """
    years = annual.select("symbol", F.col("period_end").alias("_end"), F.col("fiscal_year").alias("_fy"))
    last = years.groupBy("symbol").agg(F.max("_end").alias("_last"), F.max_by("_fy", "_end").alias("_last_fy"))
    # Only the nearest enclosing year counts: collect the few candidates per symbol.
    ends = years.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("_end", "_fy"))).alias("_years"))
    out = quarters.join(ends, "symbol", "left").join(last, "symbol", "left")
    enclosing = F.filter(
        "_years",
        lambda y: (F.datediff(y["_end"], F.col("period_end")) >= 0) & (F.datediff(y["_end"], F.col("period_end")) <= 330),
    )
    out = out.withColumn("_y", F.try_element_at(enclosing, F.lit(1)))
    remaining = F.datediff(F.col("_y._end"), F.col("period_end"))
    elapsed = F.datediff(F.col("period_end"), F.col("_last"))
    inside = F.greatest(F.lit(1), F.least(F.lit(4), F.lit(4) - F.bround(remaining / 91.31).cast("int")))
    after = F.greatest(F.lit(1), F.least(F.lit(3), F.bround(elapsed / 91.31).cast("int")))
    return (
        out.filter(F.col("_years").isNull() | F.col("_y").isNotNull() | elapsed.between(45, 310))
        .withColumns(
            {
                "fiscal_year": F.when(F.col("_y").isNotNull(), F.col("_y._fy"))
                .when(F.col("_last").isNotNull(), F.col("_last_fy") + 1)
                .otherwise(F.year("period_end")),
                "quarter": F.when(F.col("_y").isNotNull(), F.concat(F.lit("Q"), inside.cast("string")))
                .when(F.col("_last").isNotNull(), F.concat(F.lit("Q"), after.cast("string")))
                .otherwise(quarter_name(F.col("period_end"))),
            }
        )
        .drop("_years", "_y", "_last", "_last_fy")
    )


def derive_q4(quarters: DataFrame, annual: DataFrame) -> DataFrame:
    """Fourth-quarter facts the filings leave out.

    Long tables: quarters ``symbol, fiscal_year, quarter, period_end, metric,
    value``; annual the same without quarter, with optional ``period_start``.
    Flows are annual less Q1..Q3 when all three exist and their dates fit; stock
    items are the closing balance; per-share values are never derived. Returns
    only the added rows, with ``kind``.
    """
    year = ["symbol", "fiscal_year"]
    if "period_start" not in annual.columns:
        annual = annual.withColumn("period_start", F.lit(None).cast("date"))
    newest = F.max("period_end").over(Window.partitionBy(*year, "quarter"))
    q = quarters.withColumn("_m", newest).filter(F.col("period_end") == F.col("_m"))

    def at(name: str, column: str) -> Column:
        return F.max(F.when(F.col("quarter") == name, F.col(column)))

    dates = q.groupBy(*year).agg(*[at(n, "period_end").alias(f"_e{n}") for n in QUARTERS])
    values = q.groupBy(*year, "metric").agg(*[at(n, "value").alias(f"_v{n}") for n in QUARTERS])
    out = annual.filter("value is not null").join(dates, year, "left").join(values, [*year, "metric"], "left")
    end = F.col("period_end")
    fits = (
        (F.col("_eQ1") < F.col("_eQ2"))
        & (F.col("_eQ2") < F.col("_eQ3"))
        & (F.col("_eQ3") < end)
        & (F.datediff(end, F.col("_eQ1")) <= 330)
        & (F.col("period_start").isNull() | (F.col("_eQ1") >= F.col("period_start")))
    )
    prior = F.col("_vQ1") + F.col("_vQ2") + F.col("_vQ3")
    flow = F.col("metric").isin(*FLOW_METRICS)
    derived = F.when(flow, F.when(fits, F.col("value") - prior)).otherwise(F.col("value"))
    return (
        out.filter(F.col("_eQ4").isNull() | (F.col("_eQ4") == end))
        .filter(F.col("_vQ4").isNull() & ~F.col("metric").isin(*PER_SHARE_METRICS))
        .select(
            *year,
            F.lit("Q4").alias("quarter"),
            "period_end",
            "metric",
            derived.alias("value"),
            F.when(flow, "derived_annual_less_q1_q3").otherwise("annual_closing_balance").alias("kind"),
        )
        .filter("value is not null")
    )


def yearly_growth(annual: DataFrame) -> DataFrame:
    """Revenue and profit growth, only between consecutive fiscal years."""
    w = by_period()
    consecutive = F.col("fiscal_year") - F.lag("fiscal_year", 1).over(w) == 1

    def growth(name: str) -> Column:
        return statement_growth(F.col(name), F.when(consecutive, F.lag(name, 1).over(w)))

    return annual.withColumns({"revenue_growth": growth("total_revenue"), "profit_growth": growth("net_income")})


def growth_summary(annual: DataFrame) -> DataFrame:
    """First-to-last growth and change of the six checked lines, one row per symbol.

    ``annual`` carries ratios. Values are taken at the first and last period; a
    change of a ratio needs at least one elapsed fiscal year.
    """
    flows = {"revenue": "total_revenue", "net_income": "net_income", "free_cash_flow": "free_cash_flow"}
    ratios = ("net_margin", "roe", "debt_to_equity")
    columns = sorted({*flows.values(), *ratios, "roa"})
    picked = F.struct("fiscal_year", *columns)
    # One row at each end: structs keep NULLs in place, which min_by alone would not.
    ends = annual.groupBy("symbol").agg(
        F.min_by(picked, "period_end").alias("a"), F.max_by(picked, "period_end").alias("z")
    )
    years = F.col("z.fiscal_year") - F.col("a.fiscal_year")
    out = [
        F.col("symbol"),
        F.concat_ws("-", F.col("a.fiscal_year").cast("string"), F.col("z.fiscal_year").cast("string")).alias("period"),
        years.alias("elapsed_years"),
    ]
    for name, column in flows.items():
        out.append(F.col(f"z.{column}").alias(name))
        out.append(compound_growth(F.col(f"z.{column}"), F.col(f"a.{column}"), years).alias(f"{name}_cagr"))
    for name in ratios:
        out.append(F.col(f"z.{name}").alias(name))
        out.append(F.when(years > 0, F.col(f"z.{name}") - F.col(f"a.{name}")).alias(f"{name}_change"))
    out.append(F.col("z.roa").alias("roa"))
    return ends.select(*out)


def reconciliation_issues(annual: DataFrame, quarters: DataFrame) -> DataFrame:
    """Years whose four quarters do not add up to the annual value (beyond 0.5%, at least 1)."""
    year = ["symbol", "fiscal_year"]
    lines = ("total_revenue", "net_income", "operating_cash_flow")
    per_quarter = quarters.filter(F.col("quarter").isin(*QUARTERS)).groupBy(*year, "quarter").agg(
        *[F.max_by(m, "period_end").alias(m) for m in lines]
    )
    sums = per_quarter.groupBy(*year).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.when(F.count(m) == 4, F.sum(m)).alias(f"_{m}") for m in lines],
    ).filter("_n = 4")
    joined = annual.select(*year, *lines).join(sums, year)
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("annual_value"), F.col(f"_{m}").alias("quarter_sum"))
            for m in lines
        ]
    )
    out = joined.select(*year, F.explode(rows).alias("x")).select(*year, "x.*")
    tolerance = F.greatest(F.lit(1.0), F.abs("annual_value") * 0.005)
    difference = F.col("quarter_sum") - F.col("annual_value")
    return out.withColumn("difference", difference).filter(F.abs("difference") > tolerance)


def core_count() -> Column:
    """How many of the five core metrics a period has."""
    return functools.reduce(operator.add, [F.col(m).isNotNull().cast("int") for m in CORE_METRICS])


def coverage(
    annual: DataFrame,
    quarters: DataFrame,
    universe: DataFrame | None = None,
    excluded: DataFrame | None = None,
) -> DataFrame:
    """Statement coverage per symbol: years, quarters, gaps and a status.

    ``universe`` adds symbols without any statement; ``excluded`` lists
    transition periods (symbol, period_end, source_form). Both statement tables
    are read several times, so they are written once first.
    """
    annual, quarters = cut_lineage(annual), cut_lineage(quarters)
    core = len(CORE_METRICS)
    five = last_periods(annual, 5).withColumn("_core", core_count())
    a = five.groupBy("symbol").agg(
        F.count(F.lit(1)).cast("int").alias("annual_periods"),
        F.sort_array(F.collect_set("fiscal_year")).alias("annual_years"),
        F.sum("_core").alias("_values"),
        F.min("_core").alias("_poorest"),
        F.max("period_end").alias("latest_period"),
    )
    q = quarters.filter(F.col("quarter").isin(*QUARTERS)).withColumn("_core", core_count())
    years = q.groupBy("symbol", "fiscal_year").agg(
        F.collect_set("quarter").alias("_have"),
        F.count(F.lit(1)).alias("_rows"),
        F.sum("_core").alias("_values"),
        F.min("_core").alias("_poorest"),
        F.max("period_end").alias("_latest"),
    )
    bad = reconciliation_issues(annual, quarters)
    bad_years = bad.groupBy("symbol", "fiscal_year").agg(F.count(F.lit(1)).alias("_issues"))
    years = years.join(bad_years, ["symbol", "fiscal_year"], "left")
    full = (
        (F.size("_have") == 4)
        & (F.col("_values") / (F.col("_rows") * core) * 100 >= 80.0)
        & (F.col("_poorest") >= core - 1)
        & F.col("_issues").isNull()
    )
    qs = years.groupBy("symbol").agg(
        F.sum(F.size("_have")).cast("int").alias("quarter_periods"),
        F.round(F.sum("_values") / (F.sum("_rows") * core) * 100, 1).alias("quarter_core_metric_coverage_pct"),
        F.sort_array(F.collect_list(F.when(full, F.col("fiscal_year")))).alias("full_quarter_years"),
        F.max("_latest").alias("latest_quarter_period"),
        F.coalesce(F.sum("_issues"), F.lit(0)).cast("int").alias("reconciliation_issues"),
    )
    out = a.join(qs, "symbol", "full_outer")
    if universe is not None:
        out = universe.select("symbol").join(out, "symbol", "left")
    if excluded is not None:
        newer = excluded.join(a.select("symbol", "latest_period"), "symbol").filter("period_end > latest_period")
        out = out.join(newer.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("excluded_periods")), "symbol", "left")
    else:
        out = out.withColumn("excluded_periods", F.lit(None).cast("int"))
    none = F.array().cast("array<int>")
    out = out.withColumns(
        {
            "annual_periods": F.coalesce("annual_periods", F.lit(0)),
            "annual_years": F.coalesce("annual_years", none),
            "full_quarter_years": F.coalesce("full_quarter_years", none),
            "quarter_periods": F.coalesce("quarter_periods", F.lit(0)),
            "quarter_core_metric_coverage_pct": F.coalesce("quarter_core_metric_coverage_pct", F.lit(0.0)),
            "reconciliation_issues": F.coalesce("reconciliation_issues", F.lit(0)),
            "excluded_periods": F.coalesce("excluded_periods", F.lit(0)),
            "_share": F.coalesce(F.try_divide(F.col("_values") * 100.0, F.col("annual_periods") * core), F.lit(0.0)),
        }
    )
    consecutive = (F.size("annual_years") == 5) & (F.array_max("annual_years") - F.array_min("annual_years") == 4)
    out = out.withColumn("consecutive_annual_years", F.coalesce(consecutive, F.lit(False)))
    clean = (F.col("excluded_periods") == 0) & F.col("consecutive_annual_years")
    annual_ok = clean & (F.col("_share") >= 80.0) & (F.coalesce("_poorest", F.lit(0)) >= 4)
    quarterly_ok = clean & (F.size(F.array_intersect("annual_years", "full_quarter_years")) >= 5)
    out = out.withColumns({"annual_complete": annual_ok, "quarterly_complete": quarterly_ok})
    status = (
        F.when(F.col("annual_complete") & F.col("quarterly_complete"), "complete")
        .when(F.col("annual_complete"), "annual_complete")
        .when(F.col("annual_periods") > 0, "partial")
        .otherwise("missing")
    )
    return out.withColumns({"status": status, "core_metric_coverage_pct": F.round("_share", 1)}).drop(
        "_values", "_poorest", "_share"
    )


def missing_quarters(quarters: DataFrame) -> DataFrame:
    """Per symbol and year: absent quarters, and the core metrics each present one lacks."""
    lacking = F.filter(
        F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in CORE_METRICS]), lambda m: m.isNotNull()
    )
    rows = quarters.filter(F.col("quarter").isin(*QUARTERS)).withColumn("_l", lacking)
    wanted = F.array(*[F.lit(q) for q in QUARTERS])
    return rows.groupBy("symbol", "fiscal_year").agg(
        F.array_except(wanted, F.collect_set("quarter")).alias("missing_quarters"),
        F.sort_array(F.collect_list(F.when(F.size("_l") > 0, F.struct("quarter", F.col("_l").alias("metrics"))))).alias(
            "missing_metrics"
        ),
    )


def audit(coverage_rows: DataFrame, universe: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Counts and percentages by market, by source and in total, in one pass over grouping sets."""
    rows = universe.select("symbol", "market").join(coverage_rows, "symbol", "left")
    if sources is not None:
        rows = rows.join(sources.select("symbol", "source"), "symbol", "left")
    else:
        rows = rows.withColumn("source", F.lit(None).cast("string"))
    source = (
        F.when(F.col("source").startswith("SEC EDGAR"), "SEC EDGAR")
        .when(F.col("source").startswith("Yahoo Finance"), "Yahoo Finance")
        .otherwise(F.coalesce("source", F.lit("missing")))
    )
    status = F.coalesce("status", F.lit("missing"))
    kinds = F.array(
        F.struct(F.lit("market").alias("group_kind"), F.coalesce("market", F.lit("Unknown")).alias("group")),
        F.struct(F.lit("source").alias("group_kind"), source.alias("group")),
        F.struct(F.lit("total").alias("group_kind"), F.lit("all").alias("group")),
    )
    flat = rows.select(
        F.explode(kinds).alias("g"), status.alias("status"), F.coalesce("annual_complete", F.lit(False)).alias("annual_complete")
    )
    n = F.count(F.lit(1))

    def share(c: Column) -> Column:
        return F.round(F.try_divide(c * 100.0, n), 1)

    cached = F.count_if(F.col("status") != "missing")
    five = F.count_if(F.col("annual_complete"))
    complete = F.count_if(F.col("status") == "complete")
    return flat.groupBy("g.group_kind", "g.group").agg(
        n.alias("symbols"),
        cached.alias("cached"),
        five.alias("annual_5y"),
        complete.alias("complete"),
        F.count_if(F.col("status").isin("annual_complete", "partial")).alias("partial"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        share(cached).alias("cached_coverage_pct"),
        share(five).alias("annual_5y_coverage_pct"),
        share(complete).alias("complete_coverage_pct"),
    )


def shares_outstanding(net_income: Column, eps: Column) -> Column:
    """Net income over basic EPS; NULL unless positive."""
    shares = F.try_divide(net_income, eps)
    return F.when(shares > 0, shares)


def snapshot_fields(annual: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Snapshot columns from the newest two annual periods (with ratios) of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("period_end").desc())
    # Previous = the next row in newest-first order, whatever year it is.
    rows = annual.withColumns(
        {
            "_r": F.row_number().over(w),
            "_revenue": F.lead("total_revenue", 1).over(w),
            "_profit": F.lead("net_income", 1).over(w),
        }
    ).filter("_r = 1")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    shares = shares_outstanding(F.nullif(F.col("net_income"), F.lit(0.0)), F.nullif(F.col("basic_eps"), F.lit(0.0)))
    out = rows.select(
        "symbol",
        *[zero(r).alias(r) for r in ("roe", "roa", "debt_to_equity", "gross_margin", "net_margin")],
        snapshot_growth(zero("total_revenue"), F.col("_revenue")).alias("revenue_growth"),
        snapshot_growth(zero("net_income"), F.col("_profit")).alias("profit_growth"),
        zero("basic_eps").alias("eps"),
        F.coalesce(F.try_divide(F.nullif(F.col("stockholders_equity"), F.lit(0.0)), shares), F.lit(0.0)).alias(
            "book_value_per_share"
        ),
        *([F.upper("currency").alias("reporting_currency")] if "currency" in annual.columns else []),
        F.lit(True).alias("fundamentals_verified"),
        F.col("period_end").alias("as_of"),
    )
    if status is not None:
        out = out.join(status.select("symbol", F.col("status").alias("financial_history_status")), "symbol", "left")
        out = out.withColumn(
            "financial_history_complete", F.coalesce(F.col("financial_history_status") == "complete", F.lit(False))
        )
    return out


def history_status(annual: DataFrame, quarters: DataFrame) -> DataFrame:
    """Fallback status without a quality record: 5 calendar years that also have all quarters."""
    a = last_periods(annual, 5).groupBy("symbol").agg(F.collect_set(F.year("period_end")).alias("_a"))
    q = (
        quarters.groupBy("symbol", "fiscal_year")
        .agg(F.count_distinct(F.when(F.col("quarter").isin(*QUARTERS), F.col("quarter"))).alias("n"))
        .filter("n = 4")
        .groupBy("symbol")
        .agg(F.collect_set("fiscal_year").alias("_q"))
    )
    both = F.size(F.array_intersect("_a", F.coalesce("_q", F.array().cast("array<int>"))))
    return a.join(q, "symbol", "left").select(
        "symbol",
        F.when((F.size("_a") >= 5) & (both >= 5), "complete").when(F.size("_a") > 0, "partial").otherwise("missing").alias(
            "status"
        ),
    )


def fresh_store(store: DataFrame, as_of, days: int = 8) -> DataFrame:
    """Statements fetched in the last ``days``; the predicate is pushed to the scan."""
    return store.filter(F.col("fetched_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def backfill_plan(annual: DataFrame) -> DataFrame:
    """Symbols whose last five annual periods are thin, and the window to fetch for them."""
    five = last_periods(annual, 5).withColumn("_core", core_count())
    state = five.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("_core").alias("poorest"), F.max(F.year("period_end")).alias("last_year")
    )
    return state.select(
        "symbol",
        (~((F.col("n") == 5) & (F.col("poorest") >= 4))).alias("needed"),
        F.make_date(F.col("last_year") - 5, F.lit(1), F.lit(1)).alias("from_date"),
        F.make_date(F.col("last_year") - 2, F.lit(1), F.lit(1)).alias("to_date"),
    )


def backfill(annual: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge older periods in, only where both sides report one and the same currency.

    Long tables with ``currency``. Returns the merged facts and the added years.
    """
    mine = annual.groupBy("symbol").agg(F.max("currency").alias("_c"))
    usable = history.join(mine, "symbol").filter(F.col("currency") == F.col("_c")).drop("_c", "currency")
    merged = merge_period_metrics(usable, annual.drop("currency"))
    added = (
        usable.select("symbol", "period_end").distinct().join(annual.select("symbol", "period_end").distinct(), ["symbol", "period_end"], "left_anti")
    )
    return merged, added


def with_currency_presentation(periods: DataFrame) -> DataFrame:
    """Unit labels; a missing currency falls back to the exchange's."""
    given = F.upper(F.trim(F.coalesce("currency", F.lit(""))))
    code = F.when(given != "", given).otherwise(trading_currency(F.col("symbol"), F.col("market")))
    out = periods.withColumn("currency_source", F.when(given != "", "provider").otherwise("exchange_default"))
    return out.withColumn("currency", code).withColumns(
        {
            "currency_name": currency_name(F.col("currency")),
            "currency_label": currency_label(F.col("currency")),
            "unit_scale": F.lit(1_000_000),
            "per_share_unit": F.concat(F.col("currency"), F.lit(" per share")),
        }
    )


def without_derived_per_share(periods: DataFrame, metrics: tuple[str, ...] = PER_SHARE_METRICS) -> DataFrame:
    """Periods that came from the year as a whole keep a per-share value only where it was reported itself.

    ``periods``: wide, with ``derived_from_annual``, ``derived_metrics`` (names) and
    ``metric_sources`` (name to a struct with ``kind``).
    """

    def kept(metric: str) -> Column:
        own = ~F.array_contains(F.coalesce("derived_metrics", F.array().cast("array<string>")), metric)
        reported = F.coalesce(F.try_element_at("metric_sources", F.lit(metric))["kind"] == "reported", F.lit(False))
        return F.when(~F.coalesce("derived_from_annual", F.lit(False)) | (own & reported), F.col(metric))

    return periods.withColumns({m: kept(m) for m in metrics})


def thesis_progress(actual: Column, target: Column, inverse: bool = False) -> Column:
    """Share of a target reached, 0..100; inverse for debt, where less is better."""
    if inverse:
        raw = F.when(actual == 0, 100.0).when(actual < 0, 0.0).otherwise(F.try_divide(target, actual) * 100)
    else:
        raw = F.try_divide(actual, target) * 100
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    return F.when(actual.isNotNull() & (target > 0), bounded)


def thesis_score(summary: DataFrame, revenue: float, profit: float, roe: float, debt: float) -> DataFrame:
    """Progress against four targets; the mean only when all four are known."""
    parts = {
        "revenue_progress": thesis_progress(F.col("revenue_cagr"), F.lit(revenue)),
        "profit_progress": thesis_progress(F.col("net_income_cagr"), F.lit(profit)),
        "roe_progress": thesis_progress(F.col("roe"), F.lit(roe)),
        "debt_progress": thesis_progress(F.col("debt_to_equity"), F.lit(debt), inverse=True),
    }
    out = summary.withColumns(parts)
    total = functools.reduce(operator.add, [F.col(c) for c in parts])
    return out.withColumn("thesis_score", F.round(total / 4))


# Lines read as profit, and the direction that is good news.
PROFIT_LINES = ("gross_profit", "operating_income", "pretax_income", "net_income", "basic_eps", "operating_cash_flow", "free_cash_flow")


def change_kind(current: Column, previous: Column, key: Column, is_ratio: Column) -> Column:
    """How a value moved against the year before: turns and losses in words, else points or percent."""
    profit = key.isin(*PROFIT_LINES)
    known = current.isNotNull() & previous.isNotNull()
    return (
        F.when(~known, F.lit(None).cast("string"))
        .when(profit & (previous <= 0) & (current == previous), "unchanged")
        .when(profit & (previous < 0) & (current > 0), "turned_to_profit")
        .when(profit & (previous <= 0) & (current == 0), "break_even")
        .when(profit & (previous == 0) & (current > 0), "became_positive")
        .when(profit & (previous < 0) & (current > previous), "smaller_loss")
        .when(profit & (previous < 0), "larger_loss")
        .when(profit & (previous >= 0) & (current < 0), "turned_to_loss")
        .when(is_ratio, "points")
        .when((previous <= 0) | (current < 0), F.lit(None).cast("string"))
        .otherwise("percent")
    )


def change_value(current: Column, previous: Column, kind: Column) -> Column:
    return F.when(kind == "points", current - previous).when(
        kind == "percent", (F.try_divide(current, previous) - 1) * 100
    )
