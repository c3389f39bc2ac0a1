"""The scan on demo bars, its overview, and the registry contract."""

import pytest
from pyspark.sql import functions as F

from barloom import registry
from barloom.operators import health as H
from barloom.operators import snapshots as SN
from barloom.plans import scan as SC
from barloom.sources import synthetic as SY


@pytest.fixture(scope="module")
def results(spark):
    bars = SY.demo_bars(spark).cache()
    listing = bars.select("symbol").distinct().select(
        "symbol", F.col("symbol").alias("name"), F.lit("US").alias("market"), F.lit("Software").alias("sector"), F.lit("SP500|MINE").alias("index_groups")
    )
    snaps = SN.assemble(bars.select("symbol").distinct(), listing)
    fx = spark.createDataFrame([("THB", 32.0)], "code string, per_usd double")
    from barloom.operators.patterns import STUDY_PATTERNS

    def scan(**options):
        defaults = dict(as_of="2026-08-20", patterns=STUDY_PATTERNS, min_score=0.0, min_liquidity=0.0)
        return SC.scan_market(bars, snaps, fx, **{**defaults, **options})

    return scan


def test_unverified_books_cap_the_score(results):
    rows = results().collect()
    assert rows and all(r["final_score"] <= 72.0 and r["grade"].startswith("T-") for r in rows)
    assert {r["verification_level"] for r in rows} == {"technical"}
    assert all(r["decision"] in ("รอตรวจงบการเงิน", "Reject long / watch breakdown") for r in rows)
    assert [r["final_score"] for r in rows] == sorted((r["final_score"] for r in rows), reverse=True)
    sells = [r for r in rows if any(h["side"] == "SELL" for h in r["patterns"])]
    assert all(r["final_score"] <= 62 and r["risk_plan"]["stop"] > r["risk_plan"]["entry"] for r in sells)
    assert all("business quality not reviewed" in r["warnings"] for r in rows)


def test_filters_and_freshness(results):
    assert results(universe="NOPE", detail=False).count() == 0
    assert results(min_score=101.0, detail=False).count() == 0
    late = results(as_of="2026-09-10", detail=False).collect()
    assert late and all(r["decision"] == "ข้อมูลราคาไม่สด" and not r["price_is_fresh"] for r in late)


def test_overview_and_levels(results):
    out = results(detail=False).cache()
    n = out.count()
    o = SC.scan_overview(out).first()
    assert (o["results"], o["top_grades"], o["busiest_market"]) == (n, 0, "US")
    levels = {r["level"]: r["results"] for r in SC.verification_counts(out).collect()}
    assert levels == {"full": 0, "valuation": 0, "financial": 0, "financial_partial": 0, "technical": n}


def test_gap_fill_only_adds_newer_bars(spark):
    schema = "symbol string, date string, close double"
    day = F.col("date").cast("date")
    bars = spark.createDataFrame([("A", "2026-08-18", 1.0), ("B", "2026-08-19", 1.0), ("C", "2026-08-18", 1.0)], schema).withColumn("date", day)
    other = spark.createDataFrame([("A", "2026-08-19", 2.0), ("B", "2026-08-19", 2.0), ("C", "2026-08-17", 2.0)], schema).withColumn("date", day)
    universe = spark.createDataFrame([("A", "US"), ("B", "US"), ("C", "US"), ("D", "TH")], "symbol string, market string")
    out = {(r["symbol"], r["date"].isoformat(), r["close"]) for r in H.fill_gaps(bars, other, universe, "2026-08-19").collect()}
    assert out == {("A", "2026-08-18", 1.0), ("A", "2026-08-19", 2.0), ("B", "2026-08-19", 1.0), ("C", "2026-08-18", 1.0)}


def test_registry_names_match():
    queries, sql = registry.load()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_a_number_that_rounds_to_zero_has_no_sign(spark):
    from barloom.functions.numeric import message

    rows = spark.createDataFrame([("a", -0.04, -0.06, 2), ("b", 1.25, -0.005, 3)], "name string, x double, y double, n int")
    told = {r[0] for r in rows.select(message("%s %.1f%%, %.2f of %d", "name", "x", F.col("y"), "n")).collect()}
    assert told == {"a 0.0%, -0.06 of 2", "b 1.3%, -0.01 of 3"}
    detail = SC.decision_summary  # the scan's texts go through the same function
    plan = F.expr("named_struct('stop', 1D, 'risk_pct', 1D, 'entry', 1D, 'targets', array(1D), 'reward_risk', 1D)")
    facts = {"bearish": F.lit(False), "patterns": F.expr("array(named_struct('name', 'x'))"), "fundamentals_verified": F.lit(True), "financial_history_complete": F.lit(True)}
    texts = {k: F.lit("x") for k in ("valuation_note", "currency", "evidence_verdict", "research_status", "thesis")}
    numbers = {"roe": F.lit(-0.04), "debt_to_equity": F.lit(-0.004), "revenue_growth": F.lit(-0.01), "valuation_score": F.lit(1.0)}
    rest = {"valuation_verified": F.lit(True), "risk_plan": plan, "tradeable": F.lit(True), "evidence": F.expr("named_struct('pattern', 'x')")}
    row = spark.range(1).withColumns({**facts, **texts, **numbers, **rest}).select(detail().alias("d")).first()
    assert row.d.financials.detail == "ROE 0.0%, D/E 0.00, growth 0.0%"


def test_exchange_symbols_keep_every_digit(spark, tmp_path):
    spark.createDataFrame([(k, f"n{k}", 2 if k < 10**6 else 3, 1.0) for k in (7, 12345, 12346, 123456, 1234567)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(2, "HKG", 2), (3, "CHN", 3)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(2, "HK"), (3, "CN")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    shown = {r["code"]: r["shown"] for r in registry.load()[0]["exchange_symbols_markets"](spark, str(tmp_path)).collect()}
    assert shown == {
        "00007.HK": "HKEX:7", "12345.HK": "HKEX:12345", "12346.HK": "HKEX:12346", "123456.HK": "HKEX:123456", "1234567.SZ": "SZSE:1234567",
    }
