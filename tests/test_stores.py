"""Streams over restarts, files with differing headers, stores by key, published versions, stored evidence."""

import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from barloom.operators import patterns as P
from barloom.operators import statements as ST
from barloom.operators import universe as U
from barloom.registry import scan as RS
from barloom.registry import stores
from barloom.sources import csv_tables as CSV
from barloom.sources import evidence_store as EV
from barloom.sources import sinks
from barloom.streaming import sealed_bars as SB

FOLDER = "/root/testdata/sf0.001"
TICKS = "symbol string, ts timestamp, price double, size double"


def ticks(spark, rows):
    stamped = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h), float(p), 1.0) for s, d, h, p in rows]
    return spark.createDataFrame(stamped, TICKS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- streams -----------------------------------------------------------------------


def test_stream_goes_on_after_a_restart_and_drops_late_ticks(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def step():
        SB.drain(SB.sealed_bars(SB.tick_stream(spark, landing, TICKS), "D", "1 day"), out, checkpoint)

    ticks(spark, [("A", 0, 9, 1), ("A", 1, 9, 2), ("A", 3, 9, 3)]).write.parquet(f"{landing}/a")
    step()
    assert [r.period.day for r in spark.read.parquet(out).orderBy("period").collect()] == [1, 2]
    # Day 1 is sealed, so its tick is too late; the one of day 3 is late but its day is open.
    ticks(spark, [("A", 0, 10, 99), ("A", 2, 9, 7), ("A", 6, 9, 4)]).write.parquet(f"{landing}/b")
    step()
    step()
    rows = {r.period.day: (r.open, r.close, r.volume) for r in spark.read.parquet(out).collect()}
    assert rows == {1: (1.0, 1.0, 1.0), 2: (2.0, 2.0, 1.0), 3: (7.0, 7.0, 1.0), 4: (3.0, 3.0, 1.0)}
    assert spark.read.parquet(out).count() == 4


def days(spark, rows):
    return spark.createDataFrame([(s, dt.date(2024, m, d), o, h, lo, c, 1.0) for s, m, d, o, h, lo, c in rows], "symbol string, date date, open double, high double, low double, close double, volume double")


def test_running_months_are_replaced_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "months")
    batches = [
        days(spark, [("A", 1, 2, 1.0, 5.0, 1.0, 2.0), ("B", 1, 3, 4.0, 4.0, 4.0, 4.0)]),
        days(spark, [("A", 1, 9, 2.0, 3.0, 0.5, 3.0), ("A", 2, 1, 7.0, 7.0, 7.0, 7.0)]),
        days(spark, []),
    ]
    for n, batch in enumerate(batches):
        SB.merge_months(batch, n, path)
    want = {("A", "2024-01"): (1.0, 5.0, 0.5, 3.0, 2.0), ("B", "2024-01"): (4.0, 4.0, 4.0, 4.0, 1.0), ("A", "2024-02"): (7.0, 7.0, 7.0, 7.0, 1.0)}

    def rows():
        got = SB.read_months(spark, path).collect()
        assert len(got) == len(want)
        return {(r.symbol, r.month): (r.open, r.high, r.low, r.close, r.volume) for r in got}

    assert rows() == want
    for n in (1, 0, 1):
        SB.merge_months(batches[n], n, path)
        assert rows() == want


def test_streamed_query_equals_itself_on_a_new_run(spark):
    first, again = (sorted(map(tuple, stores.QUERIES["streamed_weekly_bars"](spark, FOLDER).collect())) for _ in range(2))
    assert first == again and first


# --- files ---------------------------------------------------------------------------


def test_price_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "prices_AA_BK.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\nshort,1\n")
    (tmp_path / "prices_B.csv").write_text("﻿volume, Adj Close,CLOSE,low,high,open,timestamp,Ticker\n7,1.4,1.5,1,2,1,2024/01/03,BB\n8,,2.5,1,3,1,2024/01/04,\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text('time,close,open,high,low\n1704240000,"3",1,4,1\n')
    (tmp_path / "empty.csv").write_text("")
    got = {(r.symbol, r.date.day): (r.open, r.high, r.low, r.close, r.volume, r.adjusted_close) for r in CSV.read_price_files(spark, str(tmp_path)).collect()}
    assert got == {
        ("AA.BK", 2): (1.0, 2.0, 0.5, 1.5, 10.0, None),
        ("BB", 3): (1.0, 2.0, 1.0, 1.5, 7.0, 1.4),
        ("B", 4): (1.0, 3.0, 1.0, 2.5, 8.0, None),
        ("C", 3): (1.0, 4.0, 1.0, 3.0, 0.0, None),
    }
    (tmp_path / "bad.csv").write_text("date,open,high,low\n2024-01-02,1,2,3\n")
    with pytest.raises(ValueError, match=r"bad\.csv is missing columns: close"):
        CSV.read_price_files(spark, str(tmp_path))
    assert CSV.read_price_files(spark, str(tmp_path), skip_bad=True).count() == 4


# --- stores ------------------------------------------------------------------------------


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_refresh_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(200).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("symbol"), F.lit(1).alias("v"))
    assert len(sinks.refresh_store(rows.unionByName(rows), path)) > 40
    before = files_of(path)
    new = spark.createDataFrame([("S5", 2), ("S6", 3), ("S6", 4)], "symbol string, v int")
    touched = sinks.refresh_store(new, path)
    kept = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    after = files_of(path)
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not any(f in after for f in set(before) - kept)
    store = sinks.read_store(spark, path)
    assert store.count() == 400 - 4 + 3 and sorted(r.v for r in store.where("symbol IN ('S5', 'S6')").collect()) == [2, 3, 4]
    few = sinks.read_store(spark, path, ["S5", "S9"])
    assert sorted(r.symbol for r in few.collect()) == ["S5", "S9", "S9"]
    assert "PartitionFilters: [" in plan_of(few) and "bucket" in plan_of(few).split("PartitionFilters: [")[1].split("]")[0]
    assert sinks.refresh_store(rows.limit(0), path) == []


def test_writers_at_the_same_time_take_different_numbers(spark, tmp_path):
    folder = str(tmp_path / "v")
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(sinks.publish_version, spark.range(n + 1), folder, f"run{n}") for n in range(4)]
        targets = [j.result() for j in jobs]
    numbers = sorted(r.number for r in spark.read.parquet(f"{folder}/_versions").collect())
    assert len(set(numbers)) == 4 and len(set(targets)) == 4
    newest = spark.read.parquet(f"{folder}/_versions").orderBy(F.desc("number")).first().version
    assert sinks.read_current(spark, folder).count() == int(newest[3:]) + 1
    # A number that was claimed by a writer that failed is passed over.
    assert sinks._create_new(spark, f"{folder}/_claims/{numbers[-1] + 1:08d}") and not sinks._create_new(spark, f"{folder}/_claims/{numbers[-1] + 1:08d}")
    sinks.publish_version(spark.range(9), folder, "last")
    assert sinks.read_current(spark, folder).count() == 9


def test_profiles_of_another_version_are_not_read(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_profiles(spark.createDataFrame([("A", 1), ("B", 1)], "symbol string, schema_version int"), path)
    sinks.write_profiles(spark.createDataFrame([("B", 2)], "symbol string, schema_version int"), path)
    read = sinks.read_profiles(spark, path, 2)
    assert [r.symbol for r in read.collect()] == ["B"] and "PushedFilters: [IsNotNull(schema_version), EqualTo(schema_version,2)]" in plan_of(read)


def test_freshness_reaches_the_scan_of_the_store(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([("A", "2024-03-01"), ("B", "2024-01-01")], "symbol string, day string").select("symbol", F.col("day").cast("timestamp").alias("fetched_at"))
    sinks.refresh_store(rows, path)
    fresh = ST.fresh_store(sinks.read_store(spark, path, ["A", "B"]), "2024-03-05")
    assert [r.symbol for r in fresh.collect()] == ["A"]
    assert "GreaterThanOrEqual(fetched_at" in plan_of(fresh) and "bucket" in plan_of(fresh).split("PartitionFilters: [")[1].split("]")[0]


def test_reported_per_share_values_stay(spark):
    schema = "k int, derived_from_annual boolean, basic_eps double, derived_metrics array<string>, metric_sources map<string,struct<kind:string>>"
    rows = [(1, False, 1.0, ["basic_eps"], None), (2, True, 1.0, None, {"basic_eps": ("reported",)}), (3, True, 1.0, ["basic_eps"], {"basic_eps": ("reported",)}), (4, True, 1.0, [], {"basic_eps": ("derived",)}), (5, True, 1.0, [], None)]
    got = {r.k: r.basic_eps for r in ST.without_derived_per_share(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: None, 5: None}


# --- evidence and scans -------------------------------------------------------------------


def test_evidence_ages_and_versions(spark, tmp_path):
    folder = str(tmp_path / "evidence")
    assert EV.read_evidence(spark, folder, "W", "2024-03-01").count() == 0
    row = ("breakout", "W", True, "edge", True, 300, 20, 1.0, 55.0, -3.0, 0.2, 50.0, 0.8, 5.0)
    schema = EV.EVIDENCE.rsplit(", ", 1)[0]
    EV.write_evidence(spark.createDataFrame([row], schema), folder, "W", "2024-01-01")
    EV.write_evidence(spark.createDataFrame([row[:3] + ("no_edge", False) + row[5:]], schema), folder, "W", "2024-02-01")
    verdicts = lambda day, **kw: [r.verdict for r in EV.read_evidence(spark, folder, "W", day, **kw).collect()]
    assert verdicts("2024-02-20") == ["no_edge"]
    assert verdicts("2024-06-01") == [] and verdicts("2024-06-01", max_age_days=365) == ["no_edge"]
    assert verdicts("2024-01-20") == []  # measured after that day


def test_scan_reads_stored_evidence_and_plans_no_study(spark):
    scan = RS.market_scan(spark, FOLDER)
    text = plan_of(scan)
    # Bars twice (all bars by week, daily tails), the snapshot three times, the rates for three currencies, the evidence.
    assert text.count("Exchange ") <= 12 and text.count("partitioning(") <= 4 and text.count("FileScan") <= 9
    assert "exit_" not in text  # forward returns are columns of the study
    old = RS._scan(spark, FOLDER, measured="2003-01-01").select("evidence.verdict", "evidence.tradeable", "decision").distinct().collect()
    assert {(r.verdict, r.tradeable) for r in old} <= {("unmeasured", False)}
    assert all(r.decision != "Candidate" for r in old)


def test_symbol_detail_reads_the_bars_that_the_scan_reads(spark, tmp_path, monkeypatch):
    folder, start = str(tmp_path), dt.datetime(2000, 1, 3)
    lines = [(k, float(100 + 10 * k + i % 7), 2.0, start + dt.timedelta(days=i)) for k, days in ((1, 700), (2, 40), (3, 300)) for i in range(days)]
    lines += [(None, 5.0, 1.0, start), (1, None, 1.0, start), (1, 9.0, 1.0, None)]
    spark.createDataFrame(lines, "l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, f"n{k}", 0, 1.0) for k in (1, 3)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    calls, whole = [], RS.smooth
    monkeypatch.setattr(RS, "smooth", lambda *a: calls.append(a) or whole(*a))
    # A symbol without bars, one without a listing, a null; "S3" is no result.
    results = spark.createDataFrame([("S1", 1.5), ("S2", 2.5), ("S9", 3.5), (None, 4.5)], "symbol string, final_score double")
    monkeypatch.setattr(RS, "published_scan", lambda spark, d: (RS._evidence_folder(spark, d), results)[-1])
    found = RS.symbol_detail(spark, folder)
    assert len(calls) == 1  # the study and the details (and the scan) share one table of bars
    plan = plan_of(found)
    assert "LeftSemi" in plan and plan.index("Window [") < plan.index("LeftSemi")  # only results' bars are sorted and numbered
    got = sorted(tuple(r) for r in found.collect())
    last = dt.date.fromisoformat(RS.AS_OF)
    bars = {k: sorted((r.date, r.close) for r in whole(spark, folder).where(F.col("symbol") == k).collect() if r.date and r.date < last) for k in ("S1", "S2")}
    expected = [(k, d, pytest.approx(c, abs=1e-6), score, name) for k, score, name in (("S1", 1.5, "n1"), ("S2", 2.5, None)) for d, c in bars[k][-180:]]
    assert len(got) == 180 + 40 and got == expected


# --- detectors and the universe --------------------------------------------------------------


def test_own_detectors_share_the_exchange(spark):
    bars = RS.smooth(spark, FOLDER)
    own = stores.pullback_detector()
    counts = []
    for patterns in (P.STUDY_PATTERNS, (*P.STUDY_PATTERNS, own)):
        features = P.with_pattern_features(bars, "D", patterns)
        assert ("pull_high" in features.columns) == (own in patterns)
        counts.append(plan_of(P.detect(features, "D", patterns)).count("Exchange "))
    assert counts[0] == counts[1]
    assert "pullback" not in P.DETECTORS
    with pytest.raises(ValueError, match="unknown patterns: sideways"):
        P.detect(P.with_pattern_features(bars), "D", ("breakout", "sideways"))
    with pytest.raises(ValueError, match="given twice"):
        P.with_pattern_features(bars, "D", (own, own))


def test_universe_update_takes_no_unmanaged_group(spark):
    existing = spark.createDataFrame([("A", "a", "US", "X", "MINE")], "symbol string, name string, market string, sector string, index_groups string")
    members = spark.createDataFrame([("MINE", dt.date(2026, 8, 18), "B", "b", "US", "Y")], "group string, as_of date, symbol string, name string, market string, sector string")
    merged, report = U.update_memberships(existing, members, "2026-08-20")
    assert [(r.error, r.accepted) for r in report.collect()] == [("not_managed", False)]
    assert [tuple(r) for r in merged.select("symbol", "index_groups").collect()] == [("A", "MINE")]


def test_price_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("/x/prices_A.csv", "2020-01-02,A,1,2,0.5,1.5,7"), ("/x/prices_B.csv", None)], "file string, line string")
    rows = CSV.price_rows(CSV.split_lines(lines, "date,symbol,open,high,low,close,volume"), F.col("file"))
    assert [(r.symbol, r.close, r.volume) for r in rows.collect()] == [("A", 1.5, 7.0)]
    heads = spark.createDataFrame([("/x/prices_A.csv", "date,open,high,low,close", 0), ("/x/prices_A.csv", "2020-01-02,1,2,0.5,1.5", 1)], "file string, line string, place long")
    bars, _ = CSV.price_files(heads)
    assert [(r.symbol, r.close) for r in bars.collect()] == [("A", 1.5)]
    for df in (rows, bars):
        assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("csv(") == 1


def test_ranks_compute_their_table_once(spark):
    from barloom.operators.contribution import global_rank

    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(k):
        calls.add(1)
        return k * 7 % 101

    ranked = global_rank(spark.range(100).select("id", seen("id").alias("v")), [F.col("v").desc(), F.col("id")])
    assert [r["rank"] for r in ranked.orderBy(F.desc("v"), "id").collect()] == list(range(1, 101))
    assert calls.value == 100


def test_a_scan_and_a_study_run_once(spark, tmp_path, monkeypatch):
    from barloom.plans import event_study as ES
    from barloom.plans import scan as SC
    from barloom.registry import patterns as RP
    from barloom.registry import rules as RU
    from barloom.sources import trade_ticks as T

    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        calls.add(1)
        return x

    whole = SC.scan_market

    plans = []

    def counted(*tables, **options):
        out = whole(*tables, **options)
        plans.append(plan_of(out))
        return out.withColumn("final_score", seen("final_score"))

    monkeypatch.setattr(SC, "scan_market", counted)
    found = RU._wide_scan(spark, FOLDER)
    rows = found.collect()
    assert rows and calls.value == len(rows)
    # What is written before it is ranked is as small a plan as the test above asks of the whole.
    assert len(plans) == 1 and plans[0].count("Exchange ") <= 12 and plans[0].count("partitioning(") <= 4 and plans[0].count("FileScan") <= 9 and "exit_" not in plans[0]
    assert [r["symbol"] for r in rows] == [r["symbol"] for r in sorted(rows, key=lambda r: (-r["final_score"], r["symbol"]))]

    bars = RS.smooth(spark, FOLDER)
    n, before = bars.count(), calls.value
    sinks.write_study(ES.event_study(bars.withColumn("close", seen("close")), T.listing(spark, FOLDER), as_of=RS.AS_OF, **RP.WEEKLY), str(tmp_path / "study"))
    assert 0 < calls.value - before <= n
    assert spark.read.parquet(str(tmp_path / "study/edges")).columns and spark.read.parquet(str(tmp_path / "study/stats")).count() >= 0
