"""Literal bars, property checks and a slow plain-Python detector as cross-check."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import liquidity as L
from barloom.operators import patterns as P
from barloom.operators import risk as R
from barloom.operators import study as ST
from barloom.operators.filters import expected_eod

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


def day(text):
    return dt.date.fromisoformat(text)


def make(spark, rows):
    return spark.createDataFrame(rows, BARS)


def series(closes, symbol="A", volumes=None, high=1.01, low=0.99, start=dt.date(2020, 1, 1)):
    out = []
    for i, c in enumerate(closes):
        v = volumes[i] if volumes else 1000.0
        out.append((symbol, start + dt.timedelta(days=i), c, c * high, c * low, float(c), float(v)))
    return out


def test_weekly_bar(spark):
    rows = [
        ("A", day("2026-08-03"), 10.0, 12.0, 9.0, 11.0, 100.0),
        ("A", day("2026-08-04"), 11.0, 14.0, 10.0, 13.0, 200.0),
        ("A", day("2026-08-10"), 13.0, 15.0, 12.0, 14.0, 300.0),
    ]
    out = B.resample(make(spark, rows), "W", "2026-08-20").orderBy("date").collect()
    assert len(out) == 2
    assert tuple(out[0])[2:] == (10.0, 14.0, 9.0, 13.0, 300.0)


@pytest.mark.parametrize("days, count", [(("08-10", "08-14", "08-17", "08-19"), 1), (("08-10", "08-14"), 1)])
def test_unfinished_week_is_dropped(spark, days, count):
    rows = [("A", day(f"2026-{d}"), 10.0, 14.0, 9.0, 12.0, 150.0) for d in days]
    out = B.resample(make(spark, rows), "W", "2026-08-20").collect()
    assert len(out) == count and out[0]["date"] == day("2026-08-14") and out[0]["volume"] == 300.0


def test_resample_keeps_volume_and_range(spark):
    rnd = random.Random(3)
    rows = series([rnd.uniform(10, 20) for _ in range(400)], volumes=[rnd.randint(1, 9) for _ in range(400)])
    bars = make(spark, rows)
    for tf in ("W", "M"):
        out = B.resample(bars, tf, drop_incomplete=False)
        got = out.agg(F.sum("volume"), F.max("high"), F.min("low")).first()
        want = bars.agg(F.sum("volume"), F.max("high"), F.min("low")).first()
        assert tuple(got) == pytest.approx(tuple(want))
        assert out.filter("low > least(open, close) or high < greatest(open, close)").count() == 0


def test_unknown_timeframe():
    with pytest.raises(ValueError):
        B.check_timeframe("H")


def test_ema_over_several_blocks(spark):
    rnd = random.Random(5)
    closes = [rnd.uniform(50, 150) for _ in range(900)]
    bars = make(spark, series(closes))
    # Short spans make blocks of 20 * 21 = 420 bars, so three blocks are crossed.
    got = [(r["ema5"], r["ema20"]) for r in I.with_ema(bars, [5, 20]).orderBy("date").collect()]
    for n, at in ((5, 0), (20, 1)):
        e = closes[0]
        for i, c in enumerate(closes):
            e = e if i == 0 else (c - e) * 2 / (n + 1) + e
            assert got[i][at] == pytest.approx(e, rel=1e-10)


def _double_bottom():
    closes = [100 - 0.5 * i for i in range(70)]
    closes += [closes[-1] + 0.7 * i for i in range(1, 21)]
    closes += [closes[-1] - 0.68 * i for i in range(1, 21)]
    closes += [closes[-1] + 0.66 * i for i in range(1, 21)]
    top = max(closes[70:])
    closes += [top * (1.01 + 0.01 * i) for i in range(1, 5)]
    return closes


def test_double_bottom_detected_then_stale(spark):
    closes = _double_bottom()
    volumes = [1000] * (len(closes) - 4) + [2000] * 4

    def names(values, vols):
        bars = make(spark, series(values, volumes=vols))
        f = P.with_pattern_features(bars, "D", ("double_bottom",), keep_last=1)
        out = P.detect(f, "D", ("double_bottom",), only=F.col("rn") == len(values)).collect()
        return [h["name"] for r in out for h in r["hits"]]

    assert names(closes, volumes) == ["double_bottom"]
    drift = closes + [closes[-1] * (1 + 0.001 * i) for i in range(1, 41)]
    assert names(drift, volumes + [1000] * 40) == []


# --- slow evaluator, written from the rules, bar by bar -------------------------


def slow_hits(rows):
    out = {}
    for t in range(len(rows)):
        bars = rows[max(0, t - 419) : t + 1]
        highs, lows, closes = ([r[i] for r in bars] for i in (3, 4, 5))
        vols = [r[6] for r in bars]
        n = len(bars)
        base = vols[max(0, n - 21) : n - 1]
        vr = vols[-1] / (sum(base) / len(base)) if base and sum(base) else 1.0
        ema = {}
        for span in (50, 200):
            e = closes[0]
            for c in closes[1:]:
                e += (c - e) * 2 / (span + 1)
            ema[span] = e
        hits = []
        if n >= 90:
            level = max(highs[-61:-1])
            rise = (closes[-1] - level) / level * 100
            if closes[-1] > level * 1.006 and closes[-1] > ema[50] and vr >= 1.15 and rise <= 15:
                hits.append("breakout")
        if n >= 110:
            level = max(highs[-90:-24])
            if (
                any(c > level * 1.008 for c in closes[-24:-1])
                and lows[-1] <= level * 1.035
                and closes[-1] >= level * 0.985
                and closes[-1] > closes[-2]
                and closes[-1] > level
            ):
                hits.append("retest")
        if n >= 130:
            feet = [i for i in range(max(5, n - 120), n - 5) if lows[i] == min(lows[i - 5 : i + 6])]
            low = min(lows[-120:])
            best = None
            for a, i in enumerate(feet):
                for j in feet[a + 1 :]:
                    foot = min(lows[i], lows[j])
                    if j - i < 18 or abs(lows[i] - lows[j]) / max(lows[i], lows[j]) > 0.05 or foot > low * 1.06:
                        continue
                    neck = max(highs[i : j + 1])
                    if (neck - foot) / foot * 100 >= 8 and (best is None or j > best[1]):
                        best = (i, j, neck)
            if best:
                i, j, neck = best
                prior = max(highs[max(0, i - 60) : i + 1])
                if (
                    (prior - lows[i]) / lows[i] * 100 >= 12
                    and closes[-1] > neck * 1.005
                    and not all(c > neck * 1.005 for c in closes[-7:-1])
                    and vr >= 1
                    and (closes[-1] - neck) / neck * 100 <= 12
                ):
                    hits.append("double_bottom")
            peaks = [i for i in range(max(4, n - 125), n - 4) if highs[i] == max(highs[i - 4 : i + 5])]
            chosen = None
            for a in range(len(peaks) - 2):
                l, h, r = peaks[a : a + 3]
                if (
                    h - l >= 10 and r - h >= 10 and highs[h] > highs[l] * 1.04 and highs[h] > highs[r] * 1.04
                    and abs(highs[l] - highs[r]) / max(highs[l], highs[r]) <= 0.15
                ):
                    chosen = (l, r)
            if chosen and closes[-1] < min(lows[chosen[0] : chosen[1] + 1]) * 0.99:
                hits.append("head_shoulders")
        if hits:
            out[t + 1] = sorted(hits)
    return out


def walk(seed, n=560):
    rnd = random.Random(seed)
    price, out = 100.0, []
    for i in range(n):
        price = max(5.0, price * (1 + rnd.gauss(0, 0.022) + 0.012 * ((i // 35) % 2 * 2 - 1)))
        out.append(round(price, 4))
    return out, [rnd.randint(500, 1500) for _ in range(n)]


def test_detectors_match_slow_evaluator(spark):
    rows, want = [], {}
    for seed in range(6):
        closes, vols = walk(seed)
        mine = series(closes, symbol=f"W{seed}", volumes=vols)
        rows += mine
        want[f"W{seed}"] = slow_hits(mine)
    names = ("breakout", "retest", "double_bottom", "head_shoulders")
    features = P.with_pattern_features(make(spark, rows), "D", names, P.STUDY_WINDOW)
    got = {}
    for r in P.detect(features, "D", names).collect():
        got.setdefault(r["symbol"], {})[r["rn"]] = sorted(h["name"] for h in r["hits"])
    assert sum(len(v) for v in want.values()) > 50
    assert {n for v in want.values() for hs in v.values() for n in hs} == set(names)
    assert got == {k: v for k, v in want.items() if v}


def test_latest_bar_mode_equals_full_mode(spark):
    rows = []
    for seed in range(40):
        closes, vols = walk(seed + 100, 300 + seed)
        rows += series(closes, symbol=f"W{seed}", volumes=vols)
    bars = make(spark, rows)
    n = F.count(F.lit(1)).over(B.Window.partitionBy("symbol"))
    bars = bars.withColumn("bar_count", n)
    last = F.col("rn") == F.col("bar_count")
    full = P.detect(P.with_pattern_features(bars, "D"), "D", P.STUDY_PATTERNS, only=last)
    tail = P.detect(P.with_pattern_features(bars, "D", keep_last=1), "D", P.STUDY_PATTERNS, only=last)
    as_set = lambda df: {(r["symbol"], tuple((h["name"], round(h["score"], 8)) for h in r["hits"])) for r in df.collect()}
    assert as_set(full) == as_set(tail) and as_set(full)


def test_registered_detector_is_used(spark):
    def gap_up(timeframe):
        rise = F.col("close") / F.col("prev_close") - 1
        return F.when(
            rise > 0.1, P._hit("gap_up", "BUY", F.lit(99.0), F.lit(50.0), F.col("prev_close"))
        )

    P.register_detector("gap_up", gap_up, "Gap up")
    try:
        bars = make(spark, series([10.0] * 30 + [12.0] + [12.0] * 5))
        out = P.detect(P.with_pattern_features(bars, "D", ("gap_up",)), "D", ("gap_up",)).collect()
        assert [r["rn"] for r in out] == [31]
    finally:
        P.DETECTORS.pop("gap_up")
        P.LABELS.pop("gap_up")


def test_cooldown_gaps(spark):
    rnd = random.Random(1)
    rows = [(f"S{i % 7}", n) for i in range(7) for n in sorted(rnd.sample(range(500), 120))]
    df = spark.createDataFrame(rows, "symbol string, rn int").dropDuplicates()
    got = {}
    for r in ST.apply_cooldown(df, 20).collect():
        got.setdefault(r["symbol"], []).append(r["rn"])
    for symbol, kept in got.items():
        want, last = [], -(10**9)
        for n in sorted(n for s, n in set(rows) if s == symbol):
            if n - last >= 20:
                want.append(n)
                last = n
        assert sorted(kept) == want


def test_liquidity_in_usd(spark):
    rows = [("A.BK", dt.date(2026, 1, 1) + dt.timedelta(days=i), 100.0, 100.0, 100.0, 100.0, 1_000_000.0) for i in range(60)]
    rows += [("USA", *r[1:]) for r in rows]
    fx = spark.createDataFrame([("THB", 32.0)], "code string, per_usd double")
    m = L.tail_metrics(make(spark, rows)).withColumn("market", F.lit(""))
    out = {r["symbol"]: r for r in L.with_liquidity(m, fx).collect()}
    assert out["A.BK"]["turnover_usd"] == pytest.approx(3_125_000)
    assert out["USA"]["liquidity_score"] > out["A.BK"]["liquidity_score"]


def test_zero_volume_has_no_turnover(spark):
    out = L.tail_metrics(make(spark, series([10.0] * 30, volumes=[0] * 30))).first()
    assert out["turnover"] == 0.0


def test_stop_stays_inside_three_atr(spark):
    closes = [40.0] * 20 + [40.0 + 1.2 * i for i in range(1, 41)]
    m = L.tail_metrics(make(spark, series(closes)))
    p = m.select("atr", "last_price", R.risk_plan(F.col("last_price"), F.col("atr"), F.col("support"), F.col("resistance"), F.lit(False)).alias("p")).first()
    assert p["last_price"] - 3 * p["atr"] - 1e-9 <= p["p"]["stop"] < p["p"]["entry"]


def test_expected_eod_steps_over_weekends(spark):
    days = ["2026-08-17", "2026-08-16", "2026-08-15", "2026-08-19"]
    df = spark.createDataFrame([(day(d),) for d in days], "d date")
    got = [r[0].isoformat() for r in df.select(expected_eod(F.col("d"))).collect()]
    assert got == ["2026-08-14", "2026-08-14", "2026-08-14", "2026-08-18"]


def test_detection_needs_one_exchange(spark, tmp_path):
    make(spark, series(walk(1)[0])).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    for timeframe in ("D", "W"):
        found = P.detect(P.with_pattern_features(bars, timeframe, P.STUDY_PATTERNS, P.STUDY_WINDOW), timeframe, P.STUDY_PATTERNS)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Python" not in plan
    recent = B.completed(bars, "2020-06-01").select("symbol", "close")
    scan = recent._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(date," in scan and "volume" not in scan.split("ReadSchema")[1]


def test_cooldown_lets_flagged_rows_through(spark):
    rows = [("A", i, i in (1, 3, 9), i % 4 == 0) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, rn int, fires boolean, base boolean")
    got = ST.apply_cooldown(df, 5, counts=F.col("fires"), also=F.col("base")).collect()
    assert sorted((r["rn"], r["is_signal"]) for r in got) == [(0, False), (1, True), (4, False), (8, False), (9, True)]


def test_hits_carry_label_and_reasons(spark):
    closes = _double_bottom()
    bars = make(spark, series(closes, volumes=[1000] * (len(closes) - 4) + [2000] * 4))
    hits = P.detect(P.with_pattern_features(bars, "D", P.STUDY_PATTERNS), "D", P.STUDY_PATTERNS)
    hit = hits.selectExpr("explode(hits) h").filter("h.name = 'double_bottom'").first()["h"]
    assert hit["label"] == "Double Bottom" and len(hit["reasons"]) == 3 and hit["reasons"][1].startswith("close above the neckline")


def test_tasks_of_symbol_windows_grow_with_the_rows(spark):
    ticks = spark.range(4000).selectExpr("concat('S', id % 40) AS symbol", "timestamp_seconds(1.5e9 + id * 40000) AS ts", "100 + id % 7 AS price", "1 AS size")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few, many = B.smooth_bars(ticks, rows=4000), B.smooth_bars(ticks, rows=9 * usual * B.ROWS_PER_TASK)
    weekly = B.resample(many, "W", "2030-01-01")
    assert weekly.rdd.getNumPartitions() == 9 * usual
    assert sorted(few.collect()) == sorted(many.collect()) and few.rdd.getNumPartitions() <= usual


def test_symbol_windows_are_dealt_below_the_shuffle_partitions_too(spark):
    ticks = spark.range(4000).selectExpr("concat('S', id % 40) AS symbol", "timestamp_seconds(1.5e9 + id * 40000) AS ts", "100 + id % 7 AS price", "1 AS size")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "100")
        bars = B.resample(B.smooth_bars(ticks, rows=60 * B.ROWS_PER_TASK), "W", "2030-01-01")
        assert bars.rdd.getNumPartitions() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_wide_frames_in_three_windows_are_plain_frames(spark):
    rows = [r for symbol in "AB" for r in series(walk(ord(symbol))[0], symbol)]
    rows = [r if i % 17 else (*r[:3], None, None, *r[5:]) for i, r in enumerate(rows)]
    frames = {**P._frames("D"), "exact_hi": ("max", "high", -31, 0), "four_lo": ("min", "low", -130, -3), "ahead_hi": ("max", "high", 2, 40)}
    bars = make(spark, rows).repartition(2, "symbol").cache()
    out = P.with_frame_extremes(bars, frames)
    assert out._jdf.queryExecution().executedPlan().toString().count("Window [") == 4  # the longest is 128 bars: 8, 32, 128, frames
    short = P.with_frame_extremes(bars, P._frames("D"))
    assert short._jdf.queryExecution().executedPlan().toString().count("Window [") == 3
    plain = {f"_{n}": (F.max if kind == "max" else F.min)(c).over(I.frame(a, b)) for n, (kind, c, a, b) in frames.items()}
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in frames if n != "ahead_hi"]
    checked = out.withColumns(plain).select(*[F.min(x) for x in same], F.count(F.when(F.col("base_lo").isNotNull(), 1))).first()
    assert all(checked[:-1]) and checked[-1] > 0
    inner = out.withColumns(plain).withColumn("_left", F.lead("close", 40).over(I.by_symbol())).where("_left is not null")
    assert inner.count() and inner.where("not ahead_hi <=> _ahead_hi").count() == 0


def test_newest_bars_of_the_scan_in_twelve_windows(spark):
    rows = [r for symbol in "AB" for r in series(walk(ord(symbol))[0][: 150 if symbol == "B" else None], symbol)]
    bars = make(spark, rows).repartition(2, "symbol").cache()
    newest = P.with_pattern_features(bars, "D", P.STUDY_PATTERNS, keep_last=1)
    assert newest._jdf.queryExecution().executedPlan().toString().count("Window [") == 12
    n = bars.groupBy("symbol").count().collect()
    kept = {r[0]: (r[1], r[2], r[3]) for r in newest.groupBy("symbol").agg(F.count("*"), F.min("rn"), F.max("rn")).collect()}
    assert kept == {r[0]: (min(r[1], 186), max(1, r[1] - 185), r[1]) for r in n}
    whole = P.with_pattern_features(bars, "D", P.STUDY_PATTERNS)
    for column in ("ema20", "ema50", "ema200", "hi60", "base_lo", "vr", "phase"):
        both = newest.join(whole.select("symbol", "rn", F.col(column).alias("w")), ["symbol", "rn"]).where("rn = 150 and symbol = 'B' or symbol = 'A' and rn = %d" % max(r[1] for r in n))
        assert both.count() == 2 and both.where(f"not {column} <=> w").count() == 0


def test_tail_metrics_limit_the_history_before_their_windows(spark, tmp_path):
    rows = [r for symbol, n in (("A", 200), ("B", 61), ("C", 62), ("D", 1)) for r in series(walk(ord(symbol))[0][:n], symbol)]
    make(spark, rows).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    out = L.tail_metrics(bars, 80)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        mine = sorted(x for x in rows if x[0] == r["symbol"])
        ranges = [max([b[3] - b[4], *([abs(b[3] - a[5]), abs(b[4] - a[5])] if a else [])]) for a, b in zip([None, *mine], mine)]
        turnover = sorted(x[5] * x[6] for x in mine[-80:])
        middle = (turnover[(len(turnover) - 1) // 2] + turnover[len(turnover) // 2]) / 2
        expected = {"turnover": middle, "atr": sum(ranges[-14:]) / len(ranges[-14:]), "support": min(x[4] for x in mine[-35:]), "last_price": mine[-1][5],
                    "resistance": max([x[3] for x in mine[-61:-1]] or [mine[-1][3]])}
        assert {k: r[k] for k in expected} == pytest.approx(expected) and r["price_as_of"] == mine[-1][1]
