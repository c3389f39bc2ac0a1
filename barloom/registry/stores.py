"""Streams, stores, published versions and files: what is written is read back and compared.

Work folders lie in the shared folder of the session; each run takes new ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import patterns as P
from barloom.operators import statements as ST
from barloom.operators import universe as U
from barloom.operators.indicators import by_symbol
from barloom.plans import event_study as ES
from barloom.plans import scan as SC
from barloom.registry import patterns as RP
from barloom.registry import scan as RS
from barloom.registry import sql as S
from barloom.registry.bars import raw, smooth
from barloom.session import cut_lineage, work_folder
from barloom.sources import csv_tables as CSV
from barloom.sources import sinks
from barloom.sources import trade_ticks as T
from barloom.streaming import sealed_bars as SB

AS_OF = S.AS_OF

# --- streams ----------------------------------------------------------------

TICKS = "symbol string, ts timestamp, price double, size double"
LATENESS = "2 days"


def _arrivals(spark, d):
    """Events as ticks with the tenth of the month in which they arrive; one in seven comes six days late."""
    late = F.when(F.col("event_id") % 7 == 0, F.expr("INTERVAL 6 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    ts = F.col("ts").cast("timestamp")
    return T.table(spark, d, "events").filter("event_type is not null and value is not null").select(
        F.concat(F.lit("U"), (F.col("user_id") % 50).cast("string")).alias("symbol"), ts.alias("ts"), F.col("value").alias("price"),
        F.lit(1.0).alias("size"), F.floor((F.dayofmonth(ts + late) - 1) / 10 + 3 * (F.month(ts + late) - 1)).cast("int").alias("arrival"),
    )


def _landed(spark, d, step):
    """Let the ticks of each arrival land, in turn, and call ``step`` after each: every call is a restart of the stream."""
    ticks = cut_lineage(_arrivals(spark, d))
    landing = work_folder(spark, "landing")
    for arrival in sorted(r[0] for r in ticks.select("arrival").distinct().collect()):
        ticks.where(F.col("arrival") == arrival).drop("arrival").write.parquet(f"{landing}/arrival={arrival}")
        step(SB.tick_stream(spark, landing, TICKS))
    step(SB.tick_stream(spark, landing, TICKS))  # nothing new: the last watermark still seals


def _streamed(timeframe):
    def run(spark, d):
        path, checkpoint = work_folder(spark, "bars"), work_folder(spark, "stream")
        _landed(spark, d, lambda ticks: SB.drain(SB.sealed_bars(ticks, timeframe, LATENESS), path, checkpoint))
        return spark.read.parquet(path).select("symbol", "period", "date", "open", "high", "low", "close", "volume")

    return run


def streamed_months(spark, d):
    path, checkpoint = work_folder(spark, "months"), work_folder(spark, "stream")
    _landed(spark, d, lambda ticks: SB.drain_months(SB.sealed_bars(ticks, "D", LATENESS), path, checkpoint))
    return SB.read_months(spark, path)


# --- price files ---------------------------------------------------------------


def _price_lines(spark, d):
    """A file for each symbol: three notations of the header, and one file in ten without its close."""
    bars = raw(spark, d).withColumn("n", F.substring("symbol", 2, 20).cast("int"))
    text = {c: F.col(c).cast("string") for c in ("symbol", "date", "open", "high", "low", "close", "volume")}
    layouts = {
        "plain": ("Date,Ticker,Open,High,Low,Close,Volume", ("date", "symbol", "open", "high", "low", "close", "volume")),
        "turned": ("﻿VOLUME, close ,low,high,open,TimeStamp", ("volume", "close", "low", "high", "open", "date")),
        "adjusted": ("time,symbol_name,Adj Close,open,high,low,close", ("date", "symbol", "close", "open", "high", "low", "close")),
        "broken": ("date,symbol,open,high,low,volume", ("date", "symbol", "open", "high", "low", "volume")),
    }
    kind = F.when(F.col("n") % 10 == 9, "broken").when(F.col("n") % 3 == 0, "plain").when(F.col("n") % 3 == 1, "turned").otherwise("adjusted")
    bars = bars.withColumn("kind", kind).withColumn("file", F.concat(F.lit("/landed/prices_"), "symbol", F.lit(".csv")))
    line = header = None
    for name, (head, cells) in layouts.items():
        row = F.concat_ws(",", *(text[c] for c in cells))
        line = F.when(F.col("kind") == name, row) if line is None else line.when(F.col("kind") == name, row)
        header = F.when(F.col("kind") == name, head) if header is None else header.when(F.col("kind") == name, head)
    lines = bars.select("file", line.alias("line"), F.datediff("date", F.lit("1990-01-01")).cast("long").alias("place"))
    heads = bars.groupBy("file").agg(F.first(header).alias("line")).withColumn("place", F.lit(0).cast("long"))
    return lines.unionByName(heads)


def price_files(spark, d):
    rows, _ = CSV.price_files(_price_lines(spark, d))
    return rows.select(
        "symbol", "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume", F.round("adjusted_close", 6).alias("adjusted_close")
    )


def price_file_problems(spark, d):
    _, problems = CSV.price_files(_price_lines(spark, d))
    return problems.select("file", F.array_join("missing", ",").alias("missing"))


# --- stores by key ----------------------------------------------------------------


def _fetched(spark, d, day):
    """Order totals per customer and year as statements, fetched on ``day``."""
    orders = T.table(spark, d, "orders")
    return orders.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), F.year("o_orderdate").alias("fiscal_year")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total_revenue"), F.count(F.lit(1)).alias("orders")
    ).withColumn("fetched_at", F.lit(day).cast("timestamp"))


def statement_store(spark, d):
    """All statements fetched in January, one customer in nine again in March without its first years: what is fresh then."""
    path = work_folder(spark, "statements")
    sinks.refresh_store(_fetched(spark, d, "2024-01-10"), path)
    again = _fetched(spark, d, "2024-03-01").where("CAST(substring(symbol, 2) AS INT) % 9 = 0 AND fiscal_year >= 1994")
    sinks.refresh_store(again.withColumn("total_revenue", F.col("total_revenue") + 1), path)
    rows = sinks.read_store(spark, path)
    fresh = ST.fresh_store(rows, "2024-03-05").select("symbol", "fiscal_year", F.lit(True).alias("fresh"))
    return rows.join(fresh, ["symbol", "fiscal_year"], "left").select("symbol", "fiscal_year", "total_revenue", "orders", F.coalesce("fresh", F.lit(False)).alias("fresh"))


def profile_store(spark, d):
    """Profiles of two schema versions in one store: only the new version is read."""
    path = work_folder(spark, "profiles")
    pages = T.table(spark, d, "pages").select(F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("symbol"), F.md5("html").alias("digest"), "page_id")
    sinks.write_profiles(pages.withColumn("schema_version", F.lit(1)).drop("page_id"), path)
    sinks.write_profiles(pages.where("page_id % 4 = 1").withColumn("schema_version", F.lit(2)).drop("page_id"), path)
    return sinks.read_profiles(spark, path, 2).select("symbol", "digest", "schema_version")


# --- universe update ----------------------------------------------------------------

#: Per managed group of the update: first and last part, day of the snapshot, and what is wrong with it.
SNAPSHOTS = (
    ("HSTECH", 1, 32, "2001-10-30", ""),
    ("HSI", 1, 40, "2001-10-30", ""),
    ("NASDAQ100", 20, 119, "2001-10-30", "repeated"),
    ("SP400", 1, 400, "2001-10-01", ""),
    ("CSI300", 1, 300, "2001-10-30", "nameless"),
    ("SP500", 400, 899, "2001-10-30", ""),
    ("OWN", 1, 50, "2001-10-30", ""),
)
SECOND = (
    ("HSTECH", 10, 42, "2001-10-29", "two dates"),
    ("HSI", 30, 129, "2001-10-30", ""),
    ("NASDAQ100", 20, 119, "2001-11-20", ""),
    ("SP400", 1, 400, "2001-10-30", "wrong market"),
    ("CSI300", 1, 300, "2001-10-30", ""),
    ("SP500", 100, 599, "2001-10-30", ""),
)


def _registered(spark, d):
    """Parts as a universe: the first 400 are in SP500, every third is somebody's own, some are in HSI."""
    k = F.col("p_partkey")
    tags = F.concat_ws("|", F.when(k <= 400, "SP500"), F.when(k % 3 == 0, "MINE"), F.when(k.between(20, 60), "HSI"), F.when(k > 1500, U.UNTAGGED))
    return T.table(spark, d, "part").where("p_partkey % 5 <> 0").select(
        F.concat(F.lit("P"), k.cast("string")).alias("symbol"), F.col("p_name").alias("name"), F.lit("US").alias("market"),
        F.when(k % 4 == 0, "Unknown").otherwise(F.col("p_type")).alias("sector"), tags.alias("index_groups"),
    )


def _members(spark, d, snapshots):
    plan = spark.createDataFrame(list(snapshots), "group string, low long, high long, day string, fault string")
    part, k, fault = T.table(spark, d, "part"), F.col("p_partkey"), F.col("fault")
    rows = part.join(F.broadcast(plan), k.between(F.col("low"), F.col("high")))
    market = F.coalesce(*(F.when(F.col("group") == g, m) for g, (m, _, _) in U.MANAGED_GROUPS.items()), F.lit("US"))
    key = F.when((fault == "repeated") & (k == F.col("high")), F.col("low")).otherwise(k)
    return rows.select(
        "group", F.date_add(F.col("day").cast("date"), F.when((fault == "two dates") & (k == F.col("high")), 1).otherwise(0)).alias("as_of"),
        F.concat(F.lit("P"), key.cast("string")).alias("symbol"), F.when((fault == "nameless") & (k == 7), " ").otherwise(F.col("p_name")).alias("name"),
        F.when((fault == "wrong market") & (k == 9), "TH").otherwise(market).alias("market"), F.col("p_brand").alias("sector"),
    )


def _update(snapshots, report):
    def run(spark, d):
        merged, told = U.update_memberships(_registered(spark, d), _members(spark, d, snapshots), AS_OF)
        if report:
            return told.select("group", "members", "as_of", "error", "added", "removed", F.round("removed_share", 6).alias("removed_share"), "accepted")
        return merged.select("symbol", "name", "market", "sector", "index_groups")

    return run


def holdings_dates(spark, d):
    """Order dates as holdings files write them; one notation in seven is none of theirs."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    kinds = [
        F.date_format(day, "yyyy-MM-dd"), F.concat(F.lit("As of "), F.date_format(day, "dd-MMM-yyyy")), F.date_format(day, "yyyyMMdd"),
        F.concat(F.date_format(day, "yyyyMMdd"), F.lit(".0")), F.replace(F.date_format(day, "MMM d, yyyy"), F.lit("Sep "), F.lit("Sept ")),
        F.concat(F.lit(" "), F.upper(F.date_format(day, "d-MMM-yyyy")), F.lit(" ")), F.date_format(day, "yyyy/MM/dd"),
    ]
    text = F.coalesce(*(F.when(k % len(kinds) == i, t) for i, t in enumerate(kinds)))
    return T.table(spark, d, "orders").select("o_orderkey", U.parse_holdings_date(text).alias("day"))


# --- a caller's own detector -----------------------------------------------------------


def _pullback(timeframe):
    """A close above the 15-bar high after a lower low, while the slow average rises."""
    close, level = F.col("close"), F.col("pull_high")
    fires = (F.col("rn") >= 60) & (close > level) & (F.col("pull_low") < F.col("low_20_back")) & (close > F.col("ema50"))
    score = F.least(F.lit(90.0), F.lit(50.0) + (F.try_divide(close, level) - 1) * 400)
    reason = F.when(F.col("vr") >= 1.15, "volume above its average")
    return F.when(fires, P.hit("pullback", "BUY", score, F.lit(55.0), level, reason, label="Pullback ended"))


def pullback_detector():
    return P.OwnDetector(
        "pullback", _pullback, {"pull_high": ("max", "high", -15, -1), "pull_low": ("min", "low", -10, 0)}, {"low_20_back": F.lag("low", 20).over(by_symbol())}
    )


def own_pattern_hits(spark, d):
    """Breakouts and the caller's sixth pattern, weekly."""
    patterns = ("breakout", pullback_detector())
    hits = RP.hits_of(spark, d, "W", patterns)
    return hits.select("symbol", "date", F.explode("hits").alias("h")).where("h.name = 'pullback'").select(
        "symbol", "date", "h.name", "h.side", "h.label", F.round("h.score", 5).alias("score"), F.round("h.level", 6).alias("level")
    )


# --- files of a scan and a study ----------------------------------------------------------


def scan_export_file(spark, d):
    """The scan's export as a file, read back."""
    path = work_folder(spark, "export")
    health = spark.range(1).select(F.lit("ready").alias("state"), F.lit(True).alias("can_publish"))
    sinks.write_scan_export(RS.published_scan(spark, d), health, path)
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} {k}" for c, k in _EXPORTED))
    return rows.select("symbol", "market", "currency", "market_phase", *[F.round(c, 5).alias(c) for c in ("technical_score", "final_score")], "grade", "decision", "verification_level", "liquidity_score", "pe", "pbv", "upside_pct", "price_as_of", "patterns", "stop")


_TEXTS = {"symbol", "name", "market", "sector", "currency", "market_phase", "grade", "decision", "verification_level"}
_EXPORTED = [(c, "string" if c in _TEXTS else "date" if c == "price_as_of" else "double") for c in sinks.EXPORT_COLUMNS] + [("patterns", "string"), ("stop", "double")]


def scan_summary_file(spark, d):
    path = work_folder(spark, "summary")
    sinks.write_scan_summary(SC.scan_overview(RS.published_scan(spark, d)), path, AS_OF)
    rows = spark.read.schema("results long, best_score double, top_grades long, busiest_market string, as_of date").json(path)
    return rows.withColumn("best_score", F.round("best_score", 5))


def study_files(spark, d):
    """The study's tables as files, without its events: statistics and edges read back."""
    path = work_folder(spark, "study")
    sinks.write_study(ES.event_study(smooth(spark, d), T.listing(spark, d), as_of=AS_OF, **RP.WEEKLY), path)
    edges = spark.read.parquet(f"{path}/edges")
    return edges.select("pattern", "horizon", "samples", "return_edge_pp", "hit_rate_edge_pp", "baseline_return_pct_net")


QUERIES = {
    "streamed_daily_bars": _streamed("D"),
    "streamed_weekly_bars": _streamed("W"),
    "streamed_months": streamed_months,
    "price_files": price_files,
    "price_file_problems": price_file_problems,
    "statement_store": statement_store,
    "profile_store": profile_store,
    "universe_update": _update(SNAPSHOTS, False),
    "universe_update_report": _update(SNAPSHOTS, True),
    "universe_second_update": _update(SECOND, False),
    "universe_second_report": _update(SECOND, True),
    "holdings_dates": holdings_dates,
    "own_pattern_hits": own_pattern_hits,
    "scan_export_file": scan_export_file,
    "scan_summary_file": scan_summary_file,
    "study_files": study_files,
}

# --- SQL ---------------------------------------------------------------------------------

_ARRIVED = """
arrived AS (
  SELECT 'U' || (user_id % 50) AS symbol, ts, value AS price,
    CAST(floor((day(ts + late) - 1) / 10 + 3 * (month(ts + late) - 1)) AS INT) AS arrival
  FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN INTERVAL 6 DAYS ELSE INTERVAL 0 DAYS END AS late FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL)
),
batches AS (SELECT arrival, max(ts) AS newest FROM arrived GROUP BY 1),
marks AS (
  SELECT arrival, coalesce(max(newest) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAYS, TIMESTAMP '1970-01-01') AS mark,
    max(newest) OVER () - INTERVAL 2 DAYS AS last_mark FROM batches
)"""


def _sealed_sql(timeframe):
    """A tick counts unless its period was sealed before it arrived; a period comes out once the last mark has passed its end."""
    unit, width = {"D": ("day", "1 DAY"), "W": ("week", "7 DAYS")}[timeframe]
    return f"""
kept AS (
  SELECT a.*, date_trunc('{unit}', ts) AS period, last_mark FROM arrived a JOIN marks USING (arrival) WHERE date_trunc('{unit}', ts) + INTERVAL {width} > mark
),
sealed AS (
  SELECT symbol, CAST(period AS DATE) AS period, CAST(max(ts) AS DATE) AS date, arg_min(price, (ts, price)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (ts, price)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM kept WHERE period + INTERVAL {width} <= last_mark GROUP BY symbol, kept.period
)"""


_FILES = f"""
lines AS (SELECT *, CAST(substr(symbol, 2) AS INT) AS n, '/landed/prices_' || symbol || '.csv' AS file FROM raw_bars)"""

_PULL = f"""
p AS (
  SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS pull_high,
    min(low) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS pull_low, lag(low, 20) OVER (PARTITION BY symbol ORDER BY date) AS low_20_back FROM f
)"""

_MARKETS = " ".join(f"WHEN '{g}' THEN '{m}'" for g, (m, _, _) in U.MANAGED_GROUPS.items())
_BOUNDS = ", ".join(f"('{g}', '{m}', {a}, {b})" for g, (m, a, b) in U.MANAGED_GROUPS.items())


def _update_sql(snapshots):
    values = ", ".join(f"('{g}', {a}, {b}, DATE '{day}', '{fault}')" for g, a, b, day, fault in snapshots)
    return S.with_(f"""
plan(grp, low, high, day, fault) AS (VALUES {values}),
bounds(grp, want, least, most) AS (VALUES {_BOUNDS}),
members AS (
  SELECT grp, CASE WHEN fault = 'two dates' AND p_partkey = high THEN day + 1 ELSE day END AS as_of,
    'P' || CASE WHEN fault = 'repeated' AND p_partkey = high THEN low ELSE p_partkey END AS symbol,
    CASE WHEN fault = 'nameless' AND p_partkey = 7 THEN ' ' ELSE p_name END AS name,
    CASE WHEN fault = 'wrong market' AND p_partkey = 9 THEN 'TH' ELSE CASE grp {_MARKETS} ELSE 'US' END END AS market, p_brand AS sector
  FROM part JOIN plan ON p_partkey BETWEEN low AND high
),
have AS (
  SELECT 'P' || p_partkey AS symbol, p_name AS name, 'US' AS market, CASE WHEN p_partkey % 4 = 0 THEN 'Unknown' ELSE p_type END AS sector,
    concat_ws('|', CASE WHEN p_partkey <= 400 THEN 'SP500' END, CASE WHEN p_partkey % 3 = 0 THEN 'MINE' END,
      CASE WHEN p_partkey BETWEEN 20 AND 60 THEN 'HSI' END, CASE WHEN p_partkey > 1500 THEN '{U.UNTAGGED}' END) AS tags
  FROM part WHERE p_partkey % 5 <> 0
),
old AS (SELECT symbol, unnest(string_split(tags, '|')) AS grp FROM have WHERE tags <> ''),
counted AS (
  SELECT m.grp, count(*) AS members, max(as_of) AS as_of, min(as_of) AS oldest, count(DISTINCT symbol) AS symbols, any_value(b.least) AS least, any_value(b.most) AS most,
    count(*) FILTER (trim(coalesce(m.name, '')) = '' OR m.market <> b.want) AS bad, any_value(b.grp) AS managed
  FROM members m LEFT JOIN bounds b ON b.grp = m.grp GROUP BY 1
),
moved AS (
  SELECT coalesce(n.grp, o.grp) AS grp, count(*) FILTER (o.symbol IS NULL) AS added, count(*) FILTER (n.symbol IS NULL) AS removed, count(o.symbol) AS before
  FROM (SELECT DISTINCT grp, symbol FROM members) n FULL JOIN (SELECT * FROM old WHERE grp IN (SELECT grp FROM bounds)) o ON n.grp = o.grp AND n.symbol = o.symbol GROUP BY 1
),
report AS (
  SELECT c.grp, members, as_of, added, removed, removed / nullif(before, 0)::DOUBLE AS removed_share,
    CASE WHEN managed IS NULL THEN 'not_managed' WHEN oldest <> as_of THEN 'mixed_dates' WHEN as_of > DATE '{AS_OF}' OR DATE '{AS_OF}' - as_of > 14 THEN 'stale_or_future'
      WHEN members NOT BETWEEN least AND most THEN 'count_out_of_bounds' WHEN symbols <> members THEN 'duplicate_symbols' WHEN bad > 0 THEN 'missing_name_or_wrong_market' END AS error
  FROM counted c LEFT JOIN moved m ON m.grp = c.grp
),
judged AS (SELECT *, error IS NULL AND NOT coalesce(removed_share > 0.35, false) AS accepted FROM report),
good AS (SELECT m.* FROM members m JOIN judged j ON j.grp = m.grp AND j.accepted),
fresh AS (
  SELECT symbol, arg_max(name, grp) AS name, arg_max(market, grp) AS market, arg_min(nullif(sector, 'Unknown'), grp) AS sector FROM good GROUP BY 1
),
tags AS (
  SELECT symbol, grp FROM old WHERE grp NOT IN (SELECT grp FROM judged WHERE accepted)
    AND NOT (grp = '{U.UNTAGGED}' AND symbol IN (SELECT symbol FROM fresh))
  UNION SELECT symbol, grp FROM good
),
joined AS (SELECT symbol, string_agg(grp, '|' ORDER BY grp) AS groups FROM tags GROUP BY 1),
merged AS (
  SELECT coalesce(h.symbol, f.symbol) AS symbol, coalesce(h.name, f.name) AS name, coalesce(f.market, h.market) AS market,
    CASE WHEN coalesce(h.sector, 'Unknown') IN ('Unknown', '', '-', 'Other') THEN coalesce(f.sector, h.sector, 'Unknown') ELSE h.sector END AS sector
  FROM have h FULL JOIN fresh f ON h.symbol = f.symbol
)""")


_REPORT = "SELECT grp AS \"group\", members, as_of, error, added, removed, round(removed_share, 6) AS removed_share, accepted FROM judged"
_MERGED = f"SELECT m.symbol, name, market, sector, coalesce(groups, '{U.UNTAGGED}') AS index_groups FROM merged m LEFT JOIN joined USING (symbol)"

SQL = {
    "streamed_daily_bars": S.with_(_ARRIVED, _sealed_sql("D")) + "SELECT * FROM sealed",
    "streamed_weekly_bars": S.with_(_ARRIVED, _sealed_sql("W")) + "SELECT * FROM sealed",
    "streamed_months": S.with_(_ARRIVED, _sealed_sql("D"))
    + """SELECT symbol, strftime(period, '%Y-%m') AS month, arg_min(open, period) AS open, max(high) AS high, min(low) AS low, arg_max(close, period) AS close, sum(volume) AS volume,
  min(date) AS first, max(date) AS last FROM sealed GROUP BY 1, 2""",
    "price_files": S.with_(S.RAW, _FILES)
    + """SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CASE WHEN n % 3 = 2 THEN 0.0 ELSE volume END AS volume,
  CASE WHEN n % 3 = 2 THEN round(close, 6) END AS adjusted_close FROM lines WHERE n % 10 <> 9""",
    "price_file_problems": S.with_(S.RAW, _FILES) + "SELECT DISTINCT file, 'close' AS missing FROM lines WHERE n % 10 = 9",
    "statement_store": """WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS fiscal_year, round(sum(o_totalprice), 2) AS total_revenue, count(*) AS orders FROM orders GROUP BY 1, 2),
again AS (SELECT * FROM y WHERE k % 9 = 0 AND fiscal_year >= 1994)
SELECT 'C' || k AS symbol, fiscal_year, total_revenue, orders, false AS fresh FROM y WHERE k NOT IN (SELECT k FROM again)
UNION ALL SELECT 'C' || k, fiscal_year, total_revenue + 1, orders, true FROM again""",
    "profile_store": "SELECT 'P' || page_id AS symbol, md5(html) AS digest, 2 AS schema_version FROM pages WHERE page_id % 4 = 1",
    "universe_update": _update_sql(SNAPSHOTS) + _MERGED,
    "universe_update_report": _update_sql(SNAPSHOTS) + _REPORT,
    "universe_second_update": _update_sql(SECOND) + _MERGED,
    "universe_second_report": _update_sql(SECOND) + _REPORT,
    "holdings_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 6 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "own_pattern_hits": S.with_(*RP.features_sql("W"), _PULL, recursive=True)
    + """SELECT symbol, date, 'pullback' AS name, 'BUY' AS side, 'Pullback ended' AS label, round(least(90, 50 + (close / pull_high - 1) * 400), 5) AS score, round(pull_high, 6) AS level
  FROM p WHERE rn >= 60 AND close > pull_high AND pull_low < low_20_back AND close > ema50""",
    "scan_export_file": S.with_(*RS.scan_ctes(), recursive=True)
    + """SELECT symbol, market, trading AS currency, phase AS market_phase, round(tech, 5) AS technical_score, round(final, 5) AS final_score, grade, decision, level AS verification_level,
  liq AS liquidity_score, pe, pbv, up AS upside_pct, price_as_of, replace(patterns, '|', ' | ') AS patterns, round(stop, 4) AS stop FROM sd JOIN (SELECT symbol AS s, price_as_of FROM tm) ON s = symbol""",
    "scan_summary_file": f"SELECT *, DATE '{AS_OF}' AS as_of FROM ({RS.SQL['scan_overview']})",
    "study_files": RP.SQL["event_study_edges"],
}
