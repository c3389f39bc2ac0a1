"""Literal statement, filing-fact, XIRR and profile cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.xirr import with_xirr
from barloom.operators import company_facts as CF
from barloom.operators import contribution as C
from barloom.operators import profile as P
from barloom.operators import statements as ST
from barloom.plans.stock_profile import stock_profiles
from barloom.sources import landed_json as LJ


def xirr_of(spark, flows):
    rows = [([(dt.date.fromisoformat(d), float(a)) for d, a in flows],)]
    df = spark.createDataFrame(rows, "f array<struct<d:date,a:double>>")
    return with_xirr(df, F.col("f")).first()["xirr"]


def test_xirr_published_example(spark):
    flows = [("2008-01-01", -10000), ("2008-03-01", 2750), ("2008-10-30", 4250), ("2009-02-15", 3250), ("2009-04-01", 2750)]
    assert xirr_of(spark, flows) == pytest.approx(0.373362535, abs=1e-7)


def test_xirr_one_year(spark):
    assert xirr_of(spark, [("2025-01-01", -100), ("2026-01-01", 120)]) == pytest.approx(0.20, abs=1e-9)


def test_xirr_needs_both_signs(spark):
    assert xirr_of(spark, [("2025-01-01", 100), ("2026-01-01", 120)]) is None


def growing_months(n):
    rows, price = [], 100.0
    for i in range(n):
        d = dt.date(2016 + (7 + i) // 12, (7 + i) % 12 + 1, 1)
        rows.append(("G", d, price, price, price, price, 1.0, price, price))
        price *= 1.2 ** (1 / 12)
    return rows


MONTHLY = "symbol string, date date, open double, high double, low double, close double, volume double, adjusted_close double, adjusted_open double"


def test_contribution_plan(spark):
    bars = spark.createDataFrame(growing_months(121), MONTHLY)
    r = C.evaluate_plans(bars, "2026-08-01").first()
    assert (r["months"], r["total_invested"]) == (121, 700_000.0)
    assert r["annualized_return_pct"] == pytest.approx(20.0, abs=0.2)
    assert C.evaluate_plans(spark.createDataFrame(growing_months(60), MONTHLY), "2021-07-01").count() == 0


def test_continuity_break(spark):
    symbols = spark.createDataFrame([("CHRD",), ("AAA",)], "symbol string")
    issues = C.continuity_issues(symbols, C.breaks_table(spark), F.lit("2026-08-01").cast("date"))
    assert [r["symbol"] for r in issues.collect()] == ["CHRD"]


# --- filing facts ------------------------------------------------------------


def fact(end, val, start=None, fy=None, form="10-K", filed=None, accn=None, fp="FY"):
    item = {"end": end, "val": val, "fy": fy or int(end[:4]), "fp": fp, "form": form, "filed": filed or f"{end[:4]}-12-31", "accn": accn or f"{form}-{end}"}
    if start:
        item["start"] = start
    return item


def facts_of(spark, concepts, symbol="X"):
    body = {"entityName": symbol, "facts": {"us-gaap": {}}}
    for concept, units in concepts.items():
        body["facts"]["us-gaap"][concept] = {"units": units}
    raw = spark.createDataFrame([(symbol, json.dumps(body))], "symbol string, body string")
    return LJ.company_facts(raw)


def year_facts(years, unit="USD", value=100.0):
    rows = [fact(f"{y}-12-31", value + y, f"{y}-01-01", filed=f"{y + 1}-02-15") for y in years]
    return {
        "Revenues": {unit: rows},
        "NetIncomeLoss": {unit: rows},
        "Assets": {unit: [{k: v for k, v in r.items() if k != "start"} for r in rows]},
    }


def test_year_to_date_cash_becomes_quarters(spark):
    concepts = year_facts([2024])
    q = [("2024-03-31", 10), ("2024-06-30", 25), ("2024-09-30", 45)]
    starts = ["2024-01-01", "2024-04-01", "2024-07-01"]
    concepts["NetCashProvidedByUsedInOperatingActivities"] = {
        "USD": [fact(e, v, "2024-01-01", form="10-Q", filed="2024-11-01", accn=f"q{i}") for i, (e, v) in enumerate(q)]
    }
    concepts["Revenues"]["USD"] += [fact(e, 5, s, form="10-Q", filed="2024-11-01", accn=f"q{i}") for i, ((e, _), s) in enumerate(zip(q, starts))]
    _, quarters, _ = CF.normalize(facts_of(spark, concepts))
    got = {r["quarter"]: r["operating_cash_flow"] for r in quarters.collect()}
    assert got == {"Q1": 10.0, "Q2": 15.0, "Q3": 20.0}


def test_missing_quarter_gives_no_third_quarter_cash(spark):
    concepts = year_facts([2024])
    cash = [("2024-03-31", 10, "q0"), ("2024-09-30", 45, "q2")]
    concepts["NetCashProvidedByUsedInOperatingActivities"] = {"USD": [fact(e, v, "2024-01-01", form="10-Q", filed="2024-11-01", accn=a) for e, v, a in cash]}
    for name in ("Revenues", "NetIncomeLoss"):
        concepts[name] = {"USD": list(concepts[name]["USD"]) + [
            fact("2024-03-31", 5, "2024-01-01", form="10-Q", filed="2024-05-01", accn="q0"),
            fact("2024-09-30", 6, "2024-07-01", form="10-Q", filed="2024-11-01", accn="q2"),
        ]}
    _, quarters, _ = CF.normalize(facts_of(spark, concepts))
    got = {r["quarter"]: r["operating_cash_flow"] for r in quarters.collect()}
    assert got == {"Q1": 10.0, "Q3": None}


def test_newest_reporting_currency_wins(spark):
    old = [fact(f"2020-{m:02d}-28", 1.0, f"2019-{m:02d}-28", filed="2021-01-01", accn=f"r{m}") for m in range(1, 13)]
    concepts = {"Revenues": {"RUB": old, "USD": [fact("2025-12-31", 9.0, "2025-01-01", filed="2026-02-01")]}}
    mapped = CF.mapped_facts(facts_of(spark, concepts))
    assert CF.reporting_currency(mapped).first()["currency"] == "USD"


def test_transition_period_is_left_out(spark):
    concepts = {}
    for name in ("Revenues", "NetIncomeLoss", "NetCashProvidedByUsedInOperatingActivities"):
        concepts[name] = {"USD": [
            fact("2024-10-31", 100, "2023-11-01", filed="2024-12-20", accn="k"),
            fact("2025-09-30", 90, "2024-11-01", form="10-KT", filed="2025-11-20", accn="kt"),
        ]}
    facts = facts_of(spark, concepts)
    annual, _, _ = CF.normalize(facts)
    assert [r["period_end"].isoformat() for r in annual.collect()] == ["2024-10-31"]
    out = CF.excluded_periods(facts, annual).collect()
    assert [(r["period_end"].isoformat(), r["source_form"]) for r in out] == [("2025-09-30", "10-KT")]


def test_fiscal_label_of_start_year(spark):
    concepts = {}
    for name in ("Revenues", "NetIncomeLoss", "NetCashProvidedByUsedInOperatingActivities"):
        concepts[name] = {"USD": [
            fact(f"{y}-02-28", 100, f"{y - 1}-03-01", fy=y - 1, filed=f"{y}-04-20", accn=f"k{y}") for y in (2022, 2023, 2024, 2025)
        ]}
    annual, _, _ = CF.normalize(facts_of(spark, concepts))
    assert sorted(r["fiscal_year"] for r in annual.collect()) == [2021, 2022, 2023, 2024]


def test_near_duplicate_years_keep_latest_filed(spark):
    rows = [fact("2024-12-28", 1, "2023-12-31", filed="2025-02-01", accn="a"), fact("2024-12-31", 2, "2024-01-01", filed="2026-02-01", accn="b")]
    concepts = {n: {"USD": rows} for n in ("Revenues", "NetIncomeLoss", "NetCashProvidedByUsedInOperatingActivities")}
    annual, _, _ = CF.normalize(facts_of(spark, concepts))
    assert [(r["period_end"].isoformat(), r["total_revenue"]) for r in annual.collect()] == [("2024-12-31", 2.0)]


def test_better_entity_prefers_live_filer(spark):
    df = spark.createDataFrame(
        [("X", "old", 12, dt.date(2023, 12, 31)), ("X", "new", 2, dt.date(2026, 6, 30))], "symbol string, entity string, years int, latest date"
    )
    assert CF.better_filing_entity(df, "2026-08-20").first()["entity"] == "new"


# --- ratios and profile ----------------------------------------------------------------


def annual_rows(spark, **over):
    rows = []
    data = [(1000.0, 1.0), (1250.0, 1.3), (1560.0, 1.7), (1950.0, 2.2)]
    for i, (revenue, eps) in enumerate(data):
        y = 2022 + i
        row = {
            "symbol": "GROW", "fiscal_year": y, "period_end": dt.date(y, 12, 31), "total_revenue": revenue, "gross_profit": revenue * 0.5,
            "operating_income": revenue * 0.25, "pretax_income": revenue * 0.24, "tax_provision": revenue * 0.05, "net_income": eps * 100,
            "basic_eps": eps, "stockholders_equity": 500.0 + 100 * i, "total_assets": 900.0 + 100 * i, "total_debt": 200.0,
            "operating_cash_flow": eps * 120, "capital_expenditure": -10.0, "free_cash_flow": eps * 120 - 10,
        }
        row.update(over)
        rows.append(row)
    return spark.createDataFrame(rows)


def profile_of(spark, annual):
    bars = spark.createDataFrame([("GROW", dt.date(2022 + i // 12, i % 12 + 1, 28), 10.0 + i) for i in range(48)], "symbol string, date date, close double")
    names = spark.createDataFrame(
        [("GROW", "Software", "USD", "USD", 0.0, False)],
        "symbol string, sector string, trading_currency string, reporting_currency string, analyst_fair_value double, company_profile_verified boolean",
    )
    fx = spark.createDataFrame([("THB", 32.0)], "code string, per_usd double")
    return stock_profiles(ST.add_ratios(ST.with_all_metrics(annual)), bars, names, fx).first()


def test_growing_company_passes_all_stages(spark):
    r = profile_of(spark, annual_rows(spark))
    assert r["passed_stages"] == 4 and r["verdict"] == "research"
    assert r["company_type"] == "fast_grower" and r["sector_trend"] == "AI และ Cloud"
    assert [m["key"] for m in r["methods"]] == ["historical_pe", "peg", "book_value"]


def test_negative_equity_fails_quality(spark):
    r = profile_of(spark, annual_rows(spark, stockholders_equity=-50.0))
    assert not r["stage_quality"] and r["quality_roe"] == "fail" and r["quality_debt"] == "fail"


def test_q4_never_derives_per_share(spark):
    q = spark.createDataFrame(
        [("A", 2024, f"Q{i}", dt.date(2024, i * 3, 30), m, v) for i in (1, 2, 3) for m, v in (("total_revenue", 10.0), ("basic_eps", 1.0))],
        "symbol string, fiscal_year int, quarter string, period_end date, metric string, value double",
    )
    a = spark.createDataFrame(
        [("A", 2024, dt.date(2024, 12, 31), m, v) for m, v in (("total_revenue", 50.0), ("basic_eps", 5.0), ("total_assets", 9.0))],
        "symbol string, fiscal_year int, period_end date, metric string, value double",
    )
    got = {r["metric"]: (r["value"], r["kind"]) for r in ST.derive_q4(q, a).collect()}
    assert got == {"total_revenue": (20.0, "derived_annual_less_q1_q3"), "total_assets": (9.0, "annual_closing_balance")}


def test_growth_streak_breaks_on_year_gap(spark):
    rows = [("A", y, dt.date(y, 12, 31), float(v)) for y, v in ((2020, 1), (2022, 2), (2023, 3), (2024, 4))]
    df = spark.createDataFrame(rows, "symbol string, fiscal_year int, period_end date, total_revenue double")
    arrays = P.period_arrays(ST.add_ratios(ST.with_all_metrics(df)))
    assert arrays.select(P.growth_years("total_revenue").alias("n")).first()["n"] == 2


def test_provider_timeseries(spark):
    body = {"timeseries": {"result": [
        {"annualTotalRevenue": [
            {"asOfDate": "2024-12-31", "periodType": "12M", "currencyCode": "THB", "reportedValue": {"raw": 5}},
            {"asOfDate": "2024-12-31", "periodType": "12M", "currencyCode": "THB", "reportedValue": {"raw": 7}},
            {"asOfDate": "2023-12-31", "periodType": "3M", "reportedValue": {"raw": 1}},
            {"asOfDate": "", "periodType": "12M", "reportedValue": {"raw": 1}},
        ]},
        {"annualNetIncome": [{"asOfDate": "2024-12-31", "reportedValue": {"raw": 2}}, None]},
    ]}}
    raw = spark.createDataFrame([("A", json.dumps(body))], "symbol string, body string")
    out = {(r["metric"], r["period_end"].year): r["value"] for r in LJ.provider_timeseries(raw, "annual").collect()}
    assert out == {("total_revenue", 2024): 7.0, ("net_income", 2024): 2.0}


def test_chart_json(spark):
    body = {"chart": {"result": [{"timestamp": [1767225600, 1767312000], "indicators": {
        "quote": [{"open": [10, None], "high": [12, 1], "low": [9, 1], "close": [11, 1], "volume": [None, 5]}], "adjclose": [{"adjclose": [5.5, 1]}]}}]}}
    raw = spark.createDataFrame([("A", json.dumps(body))], "symbol string, body string")
    (r,) = LJ.chart_bars(raw).collect()
    assert (r["adjusted_open"], r["adjusted_close"], r["volume"]) == (5.0, 5.5, 0.0)


def test_exchange_history(spark):
    rows = [
        {"date": "08/18/2026", "open": "$1,210.5", "high": "$1,220", "low": "$1,200", "close": "$1,215", "volume": "1,000"},
        {"date": "08/19/2026", "open": "N/A", "high": "2", "low": "1", "close": "1", "volume": "5"},
        {"date": "bad", "open": "1", "high": "2", "low": "1", "close": "1", "volume": "5"},
    ]
    raw = spark.createDataFrame([("A", json.dumps({"data": {"tradesTable": {"rows": rows}}}))], "symbol string, body string")
    r = LJ.latest_exchange_bar(raw).first()
    assert (r["date"].isoformat(), r["open"], r["volume"]) == ("2026-08-18", 1210.5, 1000.0)
    got = spark.range(1).select(LJ.market_number(F.lit("(1,234.5)")).alias("a"), LJ.market_number(F.lit("--")).alias("b")).first()
    assert (got["a"], got["b"]) == (-1234.5, None)


def test_global_rank_of_many_rows_with_payload(spark):
    """More rows than the range sample, few distinct keys, columns that only one side needs."""
    from barloom.operators.contribution import global_rank

    rows = spark.range(500_000).select("id", (F.hash("id") % 5000).alias("k"), F.repeat(F.lit("x"), 20).alias("payload"), (F.col("id") * 2).alias("other"))
    order = [F.col("k").desc(), F.col("id").asc()]
    out = global_rank(rows, order).drop("other")
    w = Window.orderBy("rank")
    checked = out.withColumns({"pk": F.lag("k").over(w), "pid": F.lag("id").over(w)})
    got = checked.agg(
        F.count_distinct("rank").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
        F.count_if((F.col("pk") < F.col("k")) | ((F.col("pk") == F.col("k")) & (F.col("pid") > F.col("id")))).alias("breaks"),
    ).first()
    assert tuple(got) == (500_000, 1, 500_000, 0)
