"""Company quality, type and valuation from a handful of annual periods.

Each symbol's last annual periods (five by default) are gathered into one
array ``a`` of structs, oldest first; everything below is expressions on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.currency import convert, price_scale, with_rate
from barloom.functions.numeric import computed_once, compound_growth

ROE_TARGET = 15.0
ROIC_TARGET = 10.0
DEBT_TO_EQUITY_TARGET = 1.5
MARGIN_OF_SAFETY_TARGET = 20.0
DILUTION_TOLERANCE_PCT = 5.0
GROWTH_YEARS_REQUIRED = 3
PEG_MINIMUM_GROWTH = 10.0
PEG_GROWTH_CAP = 40.0
VALUATION_SPREAD_LIMIT = 1.8

PERIOD_FIELDS = (
    "period_end", "fiscal_year", "total_revenue", "net_income", "basic_eps", "operating_income", "pretax_income", "tax_provision",
    "total_debt", "stockholders_equity", "operating_cash_flow", "free_cash_flow", "roe", "gross_margin", "net_margin",
    "debt_to_equity", "negative_equity", "roic", "shares", "operating_margin",
)


def with_roic(annual: DataFrame) -> DataFrame:
    """After-tax operating profit over debt and equity; tax rate 20% when unknown, at most 45%."""
    invested = F.coalesce("total_debt", F.lit(0.0)) + F.coalesce("stockholders_equity", F.lit(0.0))
    rate = F.when((F.col("pretax_income") > 0) & F.col("tax_provision").isNotNull(), F.try_divide("tax_provision", "pretax_income")).otherwise(0.20)
    rate = F.least(F.greatest(rate, F.lit(0.0)), F.lit(0.45))
    shares = F.try_divide("net_income", "basic_eps")
    return annual.withColumns(
        {
            "roic": F.try_divide(F.col("operating_income") * (1 - rate), invested) * 100,
            "shares": F.when(shares > 0, shares),
            "operating_margin": F.try_divide("operating_income", "total_revenue") * 100,
        }
    )


def period_arrays(annual: DataFrame) -> DataFrame:
    """symbol, a: the periods as one array, oldest first. ``annual`` holds the few newest periods."""
    rows = with_roic(annual)
    return rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(*PERIOD_FIELDS))).alias("a"))


def first_of(name: str) -> Column:
    return F.element_at("a", 1)[name]


def last_of(name: str) -> Column:
    return F.element_at("a", -1)[name]


def known(name: str) -> Column:
    """Structs (y, v) of the periods where the value is known."""
    rows = F.transform("a", lambda p: F.struct(p["fiscal_year"].alias("y"), p[name].alias("v")))
    return F.filter(rows, lambda r: r["v"].isNotNull())


def span_years() -> Column:
    return F.greatest(F.lit(1), last_of("fiscal_year") - first_of("fiscal_year"))


def end_cagr(name: str) -> Column:
    """CAGR between the first and last period over the fiscal span, at least one year."""
    return compound_growth(last_of(name), first_of(name), span_years())


def growth_stat(name: str) -> Column:
    """CAGR and total change between the first and last known value, over their own years."""
    rows = known(name)
    return F.transform(
        F.array(rows),
        lambda k: F.struct(
            F.when(F.size(k) >= 2, F.element_at(k, -1)["y"] - k[0]["y"]).otherwise(0).alias("years"),
            F.when(
                (F.size(k) >= 2) & (F.try_element_at(k, F.lit(1))["v"] > 0) & (F.try_element_at(k, F.lit(-1))["v"] > 0)
                & (F.try_element_at(k, F.lit(-1))["y"] > F.try_element_at(k, F.lit(1))["y"]),
                F.struct(
                    F.round(compound_growth(F.element_at(k, -1)["v"], k[0]["v"], F.element_at(k, -1)["y"] - k[0]["y"]), 2).alias("cagr_pct"),
                    F.round((F.element_at(k, -1)["v"] / k[0]["v"] - 1) * 100, 2).alias("total_change_pct"),
                ),
            ).alias("growth"),
        ),
    )[0]


def growth_years(name: str) -> Column:
    """Latest run of consecutive fiscal years in which the value rose."""
    steps = F.transform(
        "a",
        lambda p, i: F.when(i == 0, F.lit(False)).otherwise(
            F.coalesce(
                (p["fiscal_year"] - F.col("a")[F.greatest(i - 1, F.lit(0))]["fiscal_year"] == 1)
                & (p[name] > F.col("a")[F.greatest(i - 1, F.lit(0))][name]),
                F.lit(False),
            )
        ),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(
        F.reverse(steps),
        start,
        lambda s, rose: F.struct(F.when(s["on"] & rose, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & rose).alias("on")),
        lambda s: s["n"],
    )


def halves_hold(name: str, tolerance: float = 1.0) -> Column:
    """Late-half mean at least the early-half mean less a point; NULL below two values."""
    rows = known(name)

    def mean(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda t, r: t + r["v"]) / F.size(part)

    def judge(k: Column) -> Column:
        half = F.greatest(F.lit(1), F.floor(F.size(k) / 2).cast("int"))
        return F.when(F.size(k) >= 2, mean(F.slice(k, F.size(k) - half + 1, half)) >= mean(F.slice(k, 1, half)) - tolerance)

    return F.transform(F.array(rows), judge)[0]


def passes(*criteria: Column) -> Column:
    """All criteria hold; an unknown one fails the stage."""
    out = F.lit(True)
    for c in criteria:
        out = out & F.coalesce(c, F.lit(False))
    return out


def state(passed: Column) -> Column:
    return F.when(passed.isNull(), "unknown").when(passed, "pass").otherwise("fail")


def stages() -> dict[str, Column]:
    """The four quality stages and their criteria as columns."""
    cash = known("operating_cash_flow")
    negative = F.coalesce(last_of("negative_equity"), F.lit(False))
    criteria = {
        "growth_revenue": growth_years("total_revenue") >= GROWTH_YEARS_REQUIRED,
        "growth_eps": growth_years("basic_eps") >= GROWTH_YEARS_REQUIRED,
        "growth_profit": growth_years("net_income") >= GROWTH_YEARS_REQUIRED,
        "quality_roe": F.when(negative, F.lit(False)).otherwise(last_of("roe") >= ROE_TARGET),
        "quality_roic": last_of("roic") >= ROIC_TARGET,
        "quality_cash": F.when(F.size(cash) > 0, F.forall(cash, lambda r: r["v"] > 0)),
        "quality_debt": F.when(negative, F.lit(False)).otherwise(last_of("debt_to_equity") <= DEBT_TO_EQUITY_TARGET),
        "efficiency_gross": halves_hold("gross_margin"),
        "efficiency_operating": halves_hold("operating_margin"),
        "efficiency_net": halves_hold("net_margin"),
        "management_dilution": dilution_cagr() <= DILUTION_TOLERANCE_PCT,
    }
    return criteria


def dilution_cagr() -> Column:
    rows = known("shares")
    return F.transform(
        F.array(rows),
        lambda k: F.when(
            F.size(k) >= 2,
            compound_growth(F.try_element_at(k, F.lit(-1))["v"], F.try_element_at(k, F.lit(1))["v"], span_years()),
        ),
    )[0]


STAGES = {
    "stage_growth": ("growth_revenue", "growth_eps", "growth_profit"),
    "stage_quality": ("quality_roe", "quality_roic", "quality_cash", "quality_debt"),
    "stage_efficiency": ("efficiency_gross", "efficiency_operating", "efficiency_net"),
    "stage_management": ("management_dilution",),
}


def with_stages(arrays: DataFrame) -> DataFrame:
    out = computed_once(arrays, stages())
    # Only known criteria count for management; there is one, so unknown fails it too.
    return out.withColumns({name: passes(*[F.col(c) for c in parts]) for name, parts in STAGES.items()}).withColumn(
        "passed_stages", sum((F.col(name).cast("int") for name in STAGES), F.lit(0))
    )


def profit_volatility() -> Column:
    """Population deviation of yearly profit growth from positive bases; NULL below two."""
    growths = F.filter(
        F.transform(
            "a",
            lambda p, i: F.when(
                (i > 0) & (F.col("a")[F.greatest(i - 1, F.lit(0))]["net_income"] > 0),
                (p["net_income"] / F.col("a")[F.greatest(i - 1, F.lit(0))]["net_income"] - 1) * 100,
            ),
        ),
        lambda g: g.isNotNull(),
    )

    def deviation(g: Column) -> Column:
        mean = F.aggregate(g, F.lit(0.0), lambda t, x: t + x) / F.size(g)
        return F.transform(
            F.array(mean), lambda m: F.sqrt(F.aggregate(g, F.lit(0.0), lambda t, x: t + (x - m) * (x - m)) / F.size(g))
        )[0]

    return F.transform(F.array(growths), lambda g: F.when(F.size(g) >= 2, deviation(g)))[0]


def turned_profitable() -> Column:
    earlier = F.slice("a", 1, F.greatest(F.size("a") - 1, F.lit(0)))
    return F.exists(earlier, lambda p: F.coalesce(p["net_income"] < 0, F.lit(False))) & (F.coalesce(last_of("net_income"), F.lit(0.0)) > 0)


def company_type(pbv: Column) -> Column:
    """Six types: turnaround, asset play, cyclical, fast grower, stalwart, slow grower."""
    growth = F.coalesce(F.col("revenue_cagr"), F.col("profit_cagr"))
    roe = last_of("roe")
    return (
        F.when(F.col("turned_profitable"), "turnaround")
        .when((pbv < 1.0) & (roe.isNull() | (roe < 8)), "asset_play")
        .when(F.col("profit_volatility") > 45, "cyclical")
        .when(growth >= 20, "fast_grower")
        .when(growth >= 8, "stalwart")
        .otherwise("slow_grower")
    )


# Sector text -> long-term trend, first match in this order.
SECTOR_TRENDS = {
    "semiconductors": "Semiconductor และ AI",
    "software": "AI และ Cloud",
    "technology": "AI และ Cloud",
    "information technology": "AI และ Cloud",
    "health care": "Healthcare และ Aging Society",
    "healthcare": "Healthcare และ Aging Society",
    "pharmaceuticals": "Healthcare",
    "utilities": "Clean Energy",
    "energy": "การเปลี่ยนผ่านพลังงาน",
    "automobiles": "EV และ Future Mobility",
    "digital infrastructure": "Cloud และ Big Data",
    "financials": "Digital Finance",
    "banking": "Digital Finance",
}


def sector_trend(sector: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(sector, F.lit(""))))
    out = None
    for needle, label in SECTOR_TRENDS.items():
        out = (F.when if out is None else out.when)(text.contains(needle), label)
    return out


def with_pe_history(arrays: DataFrame, closes: DataFrame) -> DataFrame:
    """Add ``pe_history``: P/E at each period end with positive EPS.

    ``closes``: symbol, date (= period end), close, already as-of joined. Needs
    trading_currency, reporting_currency and their rates ``_from``, ``_to``.
    """
    per_symbol = closes.filter("close is not null").groupBy("symbol").agg(
        F.map_from_entries(F.collect_list(F.struct("date", "close"))).alias("_closes")
    )
    out = arrays.join(per_symbol, "symbol", "left")

    def entry(p: Column) -> Column:
        price = F.try_element_at("_closes", p["period_end"])
        return F.struct(
            p["fiscal_year"].alias("year"),
            F.round(price, 4).alias("price"),
            F.round(p["basic_eps"], 4).alias("eps"),
            F.round(in_reporting(price) / p["basic_eps"], 2).alias("pe"),
        )

    rows = F.transform(F.filter("a", lambda p: p["basic_eps"] > 0), entry)
    history = F.filter(rows, lambda r: r["pe"].isNotNull())
    return computed_once(out, {"pe_history": F.coalesce(history, F.array().cast(_HISTORY))}).drop("_closes")


_HISTORY = "array<struct<year:int,price:double,eps:double,pe:double>>"


def in_reporting(price: Column) -> Column:
    """A quoted price in the reporting currency; NULL without a rate."""
    return convert(
        price * price_scale(F.col("symbol")), F.col("trading_currency"), F.col("reporting_currency"), F.col("_from"), F.col("_to")
    )


def valuation_methods() -> Column:
    """The estimates that apply, each with its key and value."""
    eps, cagr = last_of("basic_eps"), F.col("eps_cagr")
    pes = F.transform("pe_history", lambda r: r["pe"])
    mean_pe = F.aggregate(pes, F.lit(0.0), lambda t, x: t + x) / F.size(pes)

    def method(key: str, value: Column, counts: bool) -> Column:
        return F.struct(F.lit(key).alias("key"), F.round(value, 4).alias("fair_value"), F.lit(counts).alias("counts"))

    methods = F.array(
        F.when((F.size(pes) > 0) & (eps > 0), method("historical_pe", mean_pe * eps, True)),
        F.when((eps > 0) & (cagr >= PEG_MINIMUM_GROWTH), method("peg", F.least(cagr, F.lit(PEG_GROWTH_CAP)) * eps, True)),
        F.when(F.col("book_per_share").isNotNull(), method("book_value", F.col("book_per_share"), False)),
        F.when(F.col("analyst_value") != 0, method("analyst", F.col("analyst_value"), True)),
    )
    return F.filter(methods, lambda m: m.isNotNull())


def median_of(values: Column) -> Column:
    """Median of a sorted array; NULL when it is empty."""
    n = F.size(values)
    low = F.greatest(F.lit(1), F.floor((n + 1) / 2).cast("int"))
    high = F.greatest(F.lit(1), F.floor((n + 2) / 2).cast("int"))
    return (F.try_element_at(values, low) + F.try_element_at(values, high)) / 2


def trend_cagr(name: str) -> Column:
    """Direction of a money line: cagr, turn (changed sign) or none, with a tone."""
    def judge(k: Column) -> Column:
        first, last = F.try_element_at(k, F.lit(1)), F.try_element_at(k, F.lit(-1))
        years = F.coalesce(last["y"] - first["y"], F.lit(0))
        rate = compound_growth(last["v"], first["v"], years)
        short = (F.size(k) < 2) | (years <= 0)
        turn_up, turn_down = (first["v"] <= 0) & (last["v"] > 0), (first["v"] > 0) & (last["v"] <= 0)
        return F.struct(
            F.when(short, "none").when(turn_up | turn_down, "turn").when(rate.isNull(), "none").otherwise("cagr").alias("kind"),
            F.when(~short, F.round(rate, 2)).alias("value"),
            F.when(short, "unknown").when(turn_up, "ok").when(rate.isNull(), "bad").when(rate >= 0.5, "ok").when(rate <= -0.5, "bad")
            .otherwise("warn").alias("tone"),
            F.when(short, 0).otherwise(years).alias("years"),
        )

    return F.transform(F.array(known(name)), judge)[0]


def trend_change(name: str, higher_is_better: bool = True, threshold: float = 0.5) -> Column:
    """Change of a ratio between its first and last known value, in points or times."""
    def judge(k: Column) -> Column:
        first, last = F.try_element_at(k, F.lit(1)), F.try_element_at(k, F.lit(-1))
        years = F.coalesce(last["y"] - first["y"], F.lit(0))
        change = last["v"] - first["v"]
        short = (F.size(k) < 2) | (years <= 0)
        better = change > 0 if higher_is_better else change < 0
        return F.struct(
            F.when(short, "none").when(F.abs(change) < threshold, "flat").otherwise("change").alias("kind"),
            F.when(~short, F.round(change, 2)).alias("value"),
            F.when(short, "unknown").when(F.abs(change) < threshold, "warn").when(better, "ok").otherwise("bad").alias("tone"),
            F.when(short, 0).otherwise(years).alias("years"),
        )

    return F.transform(F.array(known(name)), judge)[0]


def series_summary() -> Column:
    """Key lines with their values and trend, as an array of structs."""
    rows = [(k, trend_cagr(m), m) for k, m in (
        ("revenue", "total_revenue"), ("net_income", "net_income"), ("eps", "basic_eps"), ("operating_cash_flow", "operating_cash_flow"))]
    rows += [(k, trend_change(k), k) for k in ("roe", "gross_margin", "net_margin")]
    rows.append(("debt_to_equity", trend_change("debt_to_equity", higher_is_better=False, threshold=0.05), "debt_to_equity"))

    def values(name: str) -> Column:
        return F.transform("a", lambda p: p[name])

    return F.array(*[F.struct(F.lit(k).alias("key"), values(m).alias("values"), t.alias("trend")) for k, t, m in rows])


def price_return(bars: DataFrame) -> DataFrame:
    """Total and annualized return and worst fall; adjusted closes only when every bar has one."""
    from pyspark.sql import Window

    # A window flag, so the bars are shuffled once and sorted once by symbol.
    everywhere = F.min(F.coalesce(F.col("adjusted_close") > 0, F.lit(False))).over(Window.partitionBy("symbol"))
    price = F.when(F.col("_all_adjusted"), F.col("adjusted_close")).otherwise(F.col("close"))
    rows = bars.withColumn("_all_adjusted", everywhere).withColumn("_p", price).filter("_p > 0")
    peak = F.max("_p").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_fall", F.col("_p") / peak - 1)
    out = rows.groupBy("symbol").agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.min_by("_p", "date").alias("_first"),
        F.max_by("_p", "date").alias("_last"),
        F.min("_fall").alias("_worst"),
        F.first("_all_adjusted").alias("_adj"),
    )
    years = F.datediff("end_date", "start_date") / 365.2425
    return out.filter("end_date > start_date").select(
        "symbol",
        "start_date",
        "end_date",
        F.round(years, 2).alias("years"),
        F.round((F.col("_last") / F.col("_first") - 1) * 100, 2).alias("total_return_pct"),
        F.round((F.pow(F.col("_last") / F.col("_first"), 1 / years) - 1) * 100, 2).alias("annualized_return_pct"),
        F.round(F.abs("_worst") * 100, 2).alias("max_drawdown_pct"),
        F.when(F.col("_adj"), "adjusted_close").otherwise("close").alias("basis"),
    )


def with_currency_rates(df: DataFrame, fx: DataFrame) -> DataFrame:
    return with_rate(with_rate(df, fx, "trading_currency", "_from"), fx, "reporting_currency", "_to")
