"""Universe, health, journal, research, text, CSV, sinks and streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barloom.operators import filings as FI
from barloom.operators import health as H
from barloom.operators import journal as J
from barloom.operators import research as RE
from barloom.operators import screener as SC
from barloom.operators import shapes as SH
from barloom.operators import universe as U
from barloom.sources import csv_tables as CSV
from barloom.sources import sinks
from barloom.sources import synthetic as SY
from barloom.streaming.sealed_bars import sealed_bars


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_feed_health_states(spark):
    universe = spark.createDataFrame([("A", "US", "SP500")], "symbol string, market string, index_groups string")
    for latest, state in (("2026-07-13", "stale"), ("2026-08-19", "ready")):
        bars = spark.createDataFrame([("A", dt.date.fromisoformat(latest))], "symbol string, date date")
        r = H.price_health(bars, universe, "2026-08-20").first()
        assert (r["state"], r["can_publish"]) == (state, state == "ready")


def test_rates_carry_over(spark):
    a = spark.createDataFrame([("THB", 33.0)], "code string, per_usd double")
    b = spark.createDataFrame([("THB", 32.0), ("HKD", 7.8)], "code string, per_usd double")
    assert {tuple(r) for r in H.merge_rates(a, b).collect()} == {("THB", 33.0), ("HKD", 7.8)}


def test_holdings_dates_and_symbols(spark):
    texts = ["As of 05-Sep-2026", "Sept 5, 2026", "20260905.0", "2026-09-05", "junk"]
    got = one(spark, *[U.parse_holdings_date(F.lit(t)).alias(f"d{i}") for i, t in enumerate(texts)])
    assert got == (dt.date(2026, 9, 5),) * 4 + (None,)
    cases = [("700", "HK", "0700.HK"), ("0", "HK", None), ("brk.b", "US", "BRK-B"), ("TOO-LONG-X", "US", None), ("80700", "HK", "80700.HK")]
    got = one(spark, *[U.normalize_symbol(F.lit(v), F.lit(m)).alias(f"s{i}") for i, (v, m, _) in enumerate(cases)])
    assert got == tuple(w for _, _, w in cases)


def test_membership_merge_keeps_custom_groups(spark):
    schema = "symbol string, name string, market string, sector string, index_groups string"
    existing = spark.createDataFrame([("A", "A", "US", "Tech", "SP500|MINE"), ("B", "B", "US", "Unknown", "SP500"), ("C", "C", "US", "X", "WATCHLIST")], schema)
    snap = spark.createDataFrame([("SP500", "C", "C", "US", "Y"), ("SP500", "D", "D", "US", "Z")], "group string, symbol string, name string, market string, sector string")
    got = {r["symbol"]: r["index_groups"] for r in U.merge_memberships(existing, snap, ("SP500",)).collect()}
    assert got == {"A": "MINE", "B": "WATCHLIST", "C": "SP500", "D": "SP500"}


def test_universe_update_refuses_a_bad_group(spark):
    day = dt.date(2026, 8, 18)
    rows = [("HSTECH", day, f"{i:04d}.HK", "n", "HK", "Tech") for i in range(31)]
    rows += [("HSI", day, "0001.HK", "n", "HK", "Tech")]
    members = spark.createDataFrame(rows, "group string, as_of date, symbol string, name string, market string, sector string")
    existing = spark.createDataFrame(
        [("0001.HK", "n", "HK", "Tech", "HSI|MINE"), ("9999.HK", "n", "HK", "X", "HSI"), ("0002.HK", "n", "HK", "X", "HSTECH")],
        "symbol string, name string, market string, sector string, index_groups string",
    )
    merged, report = U.update_memberships(existing, members, "2026-08-20")
    assert {r["group"]: (r["error"], r["accepted"]) for r in report.collect()} == {"HSTECH": (None, True), "HSI": ("count_out_of_bounds", False)}
    got = {r["symbol"]: r["index_groups"] for r in merged.collect()}
    assert got["0001.HK"] == "HSI|HSTECH|MINE" and got["9999.HK"] == "HSI" and got["0030.HK"] == "HSTECH" and len(got) == 32


def test_member_validation(spark):
    rows = [("HSTECH", dt.date(2026, 8, 1), f"{i:04d}.HK", "n", "HK") for i in range(31)]
    rows += [("HSI", dt.date(2026, 8, 18), "0001.HK", "n", "HK")]
    df = spark.createDataFrame(rows, "group string, as_of date, symbol string, name string, market string")
    got = {r["group"]: r["error"] for r in U.validate_members(df, "2026-08-20").collect()}
    assert got == {"HSTECH": "stale_or_future", "HSI": "count_out_of_bounds"}


def test_holdings_tables(spark):
    sheet = spark.createDataFrame(
        [("Apple", "AAPL", "037833100", "5", "USD", "-"), ("US DOLLAR", "USD", "999999999", "5", "USD", ""), ("Bad", "BAD", "12", "5", "USD", "x")],
        "Name string, Ticker string, Identifier string, `Shares Held` string, `Local Currency` string, Sector string",
    )
    got = {r["symbol"]: (r["sector"], r["error"]) for r in U.sheet_members(sheet).collect()}
    assert got == {"AAPL": ("Unknown", None), "BAD": ("x", "invalid_identifier")}
    index = spark.createDataFrame([("20260818", "300.0", "1.0", "Ping An", "Shenzhen Stock Exchange"), ("20260818", "905", "600000", "X", "Shanghai Stock Exchange")],
                                  "date string, index_code string, code string, name string, exchange string")
    got = {r["symbol"]: r["error"] for r in U.index_members(index).collect()}
    assert got == {"000001.SZ": None, "600000.SS": "wrong_index"}


def test_paper_trade(spark):
    schema = "symbol string, side string, entry double, stop double, exit double"
    df = spark.createDataFrame([("a", "BUY", 100.0, 90.0, 110.0), ("b", "BUY", 100.0, 101.0, None)], schema)
    r = J.close_trades(df).first()
    assert (r["risk_pct"], r["return_pct"], r["return_pct_net"], r["r_multiple"]) == (10.0, 10.0, 9.7, 1.0)
    assert [x["error"] for x in J.rejected_trades(df).collect()] == ["stop_not_below_entry"]


def test_default_reviews(spark):
    reviews = spark.createDataFrame([("A", "Owned", 5.0)], "symbol string, status string, fair_value double")
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    got = {r["symbol"]: (r["status"], r["fair_value"]) for r in J.with_default_reviews(symbols, reviews).collect()}
    assert got == {"A": ("Owned", 5.0), "B": ("Watch", 0.0)}


def catalog_entry(**over):
    cited = {"source_ids": ["s1"]}
    entry = {
        "name": "N", "period": "FY", "summary": "s", "revenue_model": "r", "key_customers": "k", "moat_summary": "m", "reviewed_at": "2026-01-01",
        "aliases": ["ALT"], "sources": [{"id": "s1", "url": "https://example.com/a", "title": "t"}], **cited,
        "revenue_breakdown": {**cited, "basis": "b", "currency": "USD", "unit": "m", "total": 100.0, "segments": [{"name": "x", "amount": 60.0}, {"name": "y", "amount": 40.0}]},
        "peers": [{**cited, "name": "p", "overlap": "o", "compare": "c"}], "evidence": [{**cited, "kind": "reported", "title": "t", "detail": "d"}],
    }
    entry.update(over)
    return entry


def test_catalog_rules(spark):
    broken = catalog_entry()
    broken["revenue_breakdown"] = {**broken["revenue_breakdown"], "total": 120.0}
    body = json.dumps({"schema_version": 1, "profiles": {
        "GOOD": catalog_entry(), "SUM": broken, "SRC": catalog_entry(source_ids=["zz"]), "TXT": catalog_entry(summary=" "),
        "URL": catalog_entry(sources=[{"id": "s1", "url": "ftp://x", "title": "t"}]),
    }})
    checked = RE.validate(RE.parse_catalog(spark.createDataFrame([(body,)], "body string")))
    got = {r["symbol"]: r["error"] for r in checked.collect()}
    assert got == {"GOOD": None, "SUM": "segments_do_not_reconcile", "SRC": "missing_source_reference", "TXT": "missing_text", "URL": "invalid_source"}
    good = checked.filter("error is null")
    r = RE.with_segment_shares(good, "2026-08-20").first()
    assert [s["share_pct"] for s in r["segments"]] == [60.0, 40.0] and r["needs_review"]
    assert {tuple(x) for x in RE.aliases(good).collect()} == {("GOOD", "GOOD"), ("ALT", "GOOD")}


def test_field_precedence(spark):
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = RE.business_fields(
        s([("A",), ("B",), ("C",)], "symbol string"),
        s([("A", "mine")], "symbol string, note string"),
        s([("A", "ref"), ("B", "ref")], "symbol string, summary string"),
        s([("C", "filed")], "symbol string, business_summary string"),
        {"summary": ("note", "summary", "business_summary")},
    )
    assert {tuple(r) for r in out.collect()} == {("A", "mine", "journal"), ("B", "ref", "reference"), ("C", "filed", "filing")}


def test_industry_order(spark):
    cases = {"Retail-Drug Stores": "healthcare", "Retail-Eating Places": "consumer", "Semiconductors & Related Devices": "semiconductor", "": "other"}
    got = one(spark, *[SC.classify_industry(F.lit(k)).alias(f"c{i}") for i, k in enumerate(cases)])
    assert got == tuple(cases.values())


def test_page_to_text_and_sections(spark):
    html = "<style>p{}</style><div>Item 1. Business</div><p>A &amp; B</p>" + "<p>" + "word " * 120 + "</p><div>Item 1A. Risk Factors</div><script>x</script>"
    text, body = one(spark, FI.plain_text(F.lit(html)).alias("t"), FI.section_body(FI.plain_text(F.lit(html))).alias("b"))
    assert text.startswith("Item 1. Business") and "A & B" in text and "<" not in text
    assert body.startswith("A & B") and "Risk" not in body


def test_competition_excerpt(spark):
    body = "Intro line\nCompetition\n" + "We compete with many firms. " * 10 + "\nEmployees\nmore\n"
    (got,) = one(spark, FI.section_excerpt(F.lit(body)).alias("x"))
    assert got.startswith("Competition — We compete") and "Employees" not in got


def test_customer_sentences_keep_long_sentences_whole(spark):
    text = "Sales grew. No customer accounted for more. " + "x " * 300 + "one customer is big. No customer accounted for more."
    (got,) = one(spark, FI.customer_concentration(F.lit(text)).alias("x"))
    assert got.startswith("No customer accounted for more.") and got.count("No customer") == 1 and "one customer is big." in got


def test_topic_windows_merge(spark):
    body = "a" * 5000 + " competition " + "b" * 9000 + " our customers " + "c" * 500
    (got,) = one(spark, FI.topic_text(F.lit(body)).alias("x"))
    assert got.count("[...]") == 2 and "competition" in got and "our customers" in got
    assert len(one(spark, FI.topic_text(F.lit(body), limit=900).alias("x"))[0]) <= 900
    assert one(spark, FI.topic_text(F.lit("short")).alias("x")) == ("short",)


def test_topic_windows_count_characters_beyond_the_first_plane(spark):
    body = "\U0001F600" * 5000 + " Competition " + "b" * 9000
    (got,) = one(spark, FI.topic_text(F.lit(body)).alias("x"))
    window = got.split("\n[...]\n")[1]
    assert len(window) == FI.WINDOW_CHARS and window.index("Competition") == FI.BEFORE_CHARS


def test_long_sections_and_late_headings_are_kept(spark):
    long = "Item 1. Business\nItem 1A. Risk\nItem 1. Business\n" + "word " * 40_000 + "\nItem 1A. Risk Factors\n"
    body, short = one(spark, FI.section_body(F.lit(long)).alias("b"), FI.section_body(F.lit("Item 1. Business\nshop\nItem 1A. Risk")).alias("c"))
    assert len(body) == 199_999 and short == "shop"
    text = "We sell. Item 4. Information on the Company\nA mill.\nItem 5. Results"
    assert one(spark, FI.section_body(F.lit(text)).alias("b")) == ("A mill.",)
    assert one(spark, FI.section_body(F.lit(long), 10**6).alias("b")) == ("",)


def test_excerpt_of_any_length(spark):
    body = "Competition\n" + "We compete.\nLow line\n" + "many firms sell the same goods at other prices in this market, " * 100 + "\nEmployees\nx"
    (whole, part) = one(spark, FI.section_excerpt(F.lit(body)).alias("x"), FI.section_excerpt(F.lit(body), min_chars=200).alias("y"))
    assert whole == "" or whole.startswith("Competition")
    assert part.startswith("Competition — We compete. Low line many firms") and "Employees" not in part and len(part) > 6000


def test_a_seventh_report_can_reconcile(spark):
    def table(total):
        cells = "".join(f"<tr><td>Part {n}</td></tr><tr><td>Revenues</td><td>{v}</td></tr>" for n, v in (("A", 40), ("B", 60)))
        return f"<table><tr><th>Revenue (Details) - USD ($) $ in Millions</th></tr><tr><td>All</td></tr><tr><td>Revenues</td><td>{total}</td></tr>{cells}</table>"

    rows = [("S", i, "Revenue by part (Details)", table(100 if i == 7 else 999)) for i in range(1, 8)]
    reports = spark.createDataFrame(rows, "symbol string, report int, title string, html string")
    found = FI.first_reconciled(FI.reconciled_segments(FI.segment_pairs(FI.candidate_reports(reports, "(?i)revenue by"))))
    assert found.first()["report"] == 7
    assert FI.candidate_reports(reports, "(?i)revenue by", most=6).count() == 6


def test_segments_need_distinct_names(spark):
    def table(*rows):
        head = "<tr><th>Revenue (Details) - USD ($) $ in Millions</th></tr>"
        return head + "".join(f"<tr><td>{n}</td></tr><tr><td>Revenues</td><td>{v}</td></tr>" for n, v in rows)

    rows = [("A", 1, table(("Total", "100"), ("X", "60"), ("Y", "(5)"), ("Z", "40"))), ("B", 1, table(("Total", "100"), ("X", "60"), ("X", "40"))), ("C", 1, table(("Total", "100"), ("X", "60"), ("Y", "20")))]
    df = spark.createDataFrame(rows, "symbol string, report int, html string")
    out = FI.reconciled_segments(FI.segment_pairs(df)).collect()
    assert [(r["symbol"], r["total"], [tuple(s) for s in r["segments"]]) for r in out] == [("A", 100.0, [("X", 60.0), ("Z", 40.0)])]


def test_shape_of_itself_scores_100(spark):
    df = SH.with_shape(spark.createDataFrame([([1.0, 5.0, 2.0, 8.0],)], "v array<double>"), "v")
    (got,) = df.select(SH.shape_score(SH.correlation(F.col("shape"), F.col("shape")))).first()
    assert got == pytest.approx(100.0)


def test_price_csv(spark, tmp_path):
    (tmp_path / "prices_PTT_BK.csv").write_text("﻿Date,Open,High,Low,Close,Volume\n2026/08-03,1,2,0.5,1.5,\n1786060800,1,2,0.5,1.5,7\n2026-08-05,1,2\n", encoding="utf-8")
    rows = {r["date"].isoformat(): r for r in CSV.read_price_csv(spark, str(tmp_path / "prices_PTT_BK.csv")).collect()}
    assert set(rows) == {"2026-08-03", "2026-08-07"}
    assert {r["symbol"] for r in rows.values()} == {"PTT.BK"}
    assert rows["2026-08-03"]["volume"] == 0.0 and rows["2026-08-03"]["adjusted_close"] is None
    (tmp_path / "bad.csv").write_text("date,open\n2026-01-01,1\n")
    with pytest.raises(ValueError, match="close, high, low"):
        CSV.read_price_csv(spark, str(tmp_path / "bad.csv"))


def test_universe_and_fundamentals_csv(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,name,group\nA,,SP500\n,x,y\n")
    assert [tuple(r) for r in CSV.read_universe_csv(spark, str(tmp_path / "u.csv")).select("symbol", "name", "market", "index_groups").collect()] == [("A", "A", "US", "SP500")]
    (tmp_path / "f.csv").write_text("symbol,roe,pe\nA,,12.5\n")
    r = CSV.read_fundamentals_csv(spark, str(tmp_path / "f.csv")).first()
    assert (r["roe"], r["pe"], r["moat"]) == (0.0, 12.5, "medium")
    twice = spark.createDataFrame([("A",), ("A",)], "symbol string")
    with pytest.raises(Exception, match="duplicate symbol"):
        CSV.assert_unique_symbols(twice).collect()


def test_publish_and_store_versions(spark, tmp_path):
    df = spark.createDataFrame([("A", 1)], "symbol string, schema_version int")
    sinks.write_profiles(df, str(tmp_path / "p"))
    assert sinks.read_profiles(spark, str(tmp_path / "p"), 1).count() == 1 and sinks.read_profiles(spark, str(tmp_path / "p"), 2).count() == 0
    folder = str(tmp_path / "v")
    sinks.publish_version(df, folder, "1")
    sinks.publish_version(df.union(df), folder, "2")
    assert sinks.read_current(spark, folder).count() == 2
    assert spark.read.parquet(f"{folder}/version=1").count() == 1
    with pytest.raises(Exception):
        sinks.publish_version(df, folder, "2")  # exists already: nothing changes
    assert sinks.read_current(spark, folder).count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, str(tmp_path / "none"))


def test_export_refused_unless_ready(spark, tmp_path):
    health = spark.createDataFrame([("stale", False)], "state string, can_publish boolean")
    with pytest.raises(sinks.NotReady, match="stale"):
        sinks.write_scan_export(health, health, str(tmp_path / "x"))


def test_demo_bars_are_deterministic(spark):
    a = SY.demo_bars(spark).agg(F.sum("close"), F.count("*"), F.count_distinct("symbol")).first()
    assert tuple(a) == tuple(SY.demo_bars(spark).agg(F.sum("close"), F.count("*"), F.count_distinct("symbol")).first())
    assert a[1] == 240 * 9 and a[2] == 9
    assert SY.demo_bars(spark).filter("low > least(open, close) or high < greatest(open, close)").count() == 0


def test_sealed_bars_withhold_the_open_week(spark, tmp_path):
    source = tmp_path / "in"
    base = dt.datetime(2024, 1, 1)
    rows = [("A", base + dt.timedelta(days=d, hours=h), float(d + h), 1.0) for d in range(30) for h in (1, 9)]
    schema = "symbol string, ts timestamp, price double, size double"
    for i, part in enumerate((rows[:30], rows[30:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    query = sealed_bars(stream, "W").writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["period"].isoformat(): (r["open"], r["close"], r["volume"]) for r in spark.table("weeks").collect()}
    # 30 January lies in the fifth week, which is still open.
    assert sorted(got) == ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"]
    assert got["2024-01-08"] == (8.0, 22.0, 14.0)
