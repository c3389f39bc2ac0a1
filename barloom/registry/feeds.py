"""Universe, feed health, journals, screener and shape matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import contribution as CO
from barloom.operators import health as H
from barloom.operators import journal as J
from barloom.operators import screener as SC
from barloom.operators import shapes as SH
from barloom.operators import universe as U
from barloom.registry import sql as S
from barloom.registry import statements as RS
from barloom.registry.bars import raw, smooth
from barloom.sources import trade_ticks as T

AS_OF = "2001-10-31"


def price_health(spark, d):
    return H.price_health(raw(spark, d), T.listing(spark, d), AS_OF)


def symbol_freshness(spark, d):
    return H.symbol_freshness(raw(spark, d), AS_OF)


def _behind(bars, day, days):
    """A feed that lags up to ``days`` days behind ``day``, by the symbol's number."""
    number = F.substring("symbol", 2, 20).cast("int")
    return bars.filter(F.col("date") < F.date_sub(F.lit(day).cast("date"), number % days))


def oldest_stale(spark, d):
    return H.oldest_stale(_behind(raw(spark, d), "2001-10-30", 9), AS_OF)


def stale_symbols(spark, d):
    return H.stale_symbols(raw(spark, d), T.listing(spark, d), "2001-10-29")


def gap_fill(spark, d):
    bars = raw(spark, d)
    out = H.fill_gaps(_behind(bars, "2001-10-29", 13), bars, T.listing(spark, d), "2001-10-30")
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("date").alias("latest_date"))


def retained_history(spark, d):
    bars = raw(spark, d)
    failed = T.listing(spark, d).filter("market = 'TH'").select("symbol")
    new = bars.join(failed, "symbol", "left_anti").filter("date >= DATE '2001-01-01'")
    out = H.retain_failed(new, bars, failed)
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


def publish_guard(spark, d):
    got = raw(spark, d).filter("date >= DATE '2001-10-25'").select("symbol")
    return H.publish_ratio(T.listing(spark, d), got)


def statement_health(spark, d):
    fetched = T.table(spark, d, "orders").groupBy(F.concat(F.lit("S"), (F.col("o_custkey") % 100).cast("string")).alias("symbol")).agg(
        F.max("o_orderdate").cast("timestamp").alias("fetched_at")
    )
    return H.statement_health(T.listing(spark, d), RS._coverage(spark, d), fetched, "2001-08-05")


def feed_checks(spark, d):
    return H.feed_checks(T.listing(spark, d), raw(spark, d), "2001-11-08")


def universe_overview(spark, d):
    latest = H.latest_dates(raw(spark, d))
    return U.coverage_overview(T.listing(spark, d), latest, RS._coverage(spark, d), F.lit("2001-10-30").cast("date"))


def members_of(spark, d):
    """Part suppliers as index members: group = brand, symbol = supplier."""
    pairs = T.table(spark, d, "lineitem").join(T.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return pairs.select(F.col("p_brand").alias("group"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), "l_shipdate")


def membership_changes(spark, d):
    rows = members_of(spark, d)
    old = rows.filter("l_shipdate < TIMESTAMP_NTZ '1998-05-01 00:00:00'")
    new = rows.filter("l_shipdate >= TIMESTAMP_NTZ '1998-05-01 00:00:00'")
    return U.membership_changes(old, new).withColumn("removed_share", F.round("removed_share", 6))


def membership_merge(spark, d):
    existing = T.listing(spark, d).select("symbol", "name", "market", F.lit("Unknown").alias("sector"), "index_groups")
    snap = T.listing(spark, d).filter("account_balance > 5000").select(
        F.lit("G1").alias("group"), "symbol", "name", "market", "sector"
    )
    return U.merge_memberships(existing, snap, ("G1",)).select("symbol", "market", "sector", "index_groups")


def member_counts(spark, d):
    return T.listing(spark, d).groupBy("market").agg(F.count(F.lit(1)).alias("members"))


def normalized_symbols(spark, d):
    rows = T.table(spark, d, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("word"))
    hk = U.normalize_symbol(F.col("p_partkey"), F.lit("HK"))
    us = U.normalize_symbol(F.concat("word", F.lit(".a")), F.lit("US"))
    return rows.select("p_partkey", hk.alias("hk"), us.alias("us"), U.exchange_symbol(hk, F.lit("HK")).alias("chart"))


def _trades(spark, d):
    """Orders as paper trades: entry = price, stop and exit from the customer and priority."""
    o = T.table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.when(key % 3 == 0, "SELL").otherwise("BUY").alias("side"),
        F.col("o_totalprice").alias("entry"),
        F.round(F.col("o_totalprice") * (0.9 + (key % 5) * 0.04), 6).alias("stop"),
        F.when(F.col("o_orderstatus") != "O", F.round(F.col("o_totalprice") * (0.8 + (key % 41) * 0.01), 6)).alias("exit"),
        F.col("o_orderdate").cast("date").alias("opened_on"),
        key.alias("trade_id"),
    )


def closed_trades(spark, d):
    return J.close_trades(_trades(spark, d)).select("trade_id", "side", "state", "risk_pct", "return_pct", "return_pct_net", "r_multiple")


def rejected_trades(spark, d):
    return J.rejected_trades(_trades(spark, d)).select("trade_id", "error")


def trade_summary(spark, d):
    return J.journal_summary(J.close_trades(_trades(spark, d)))


def _reviews(spark, d):
    c = T.table(spark, d, "customer")
    k = F.col("c_custkey")
    text = lambda m: F.when(k % m != 0, F.col("c_name")).otherwise("")
    return c.select(
        F.col("c_name").alias("symbol"),
        F.element_at(F.array(*[F.lit(s) for s in ("Watch", "Approved", "Owned", "Bought")]), (k % 4 + 1).cast("int")).alias("status"),
        F.when(k % 11 == 0, "huge").when(k % 2 == 0, "wide").otherwise("").alias("moat"),
        F.when(k % 3 == 0, "").otherwise("leader").alias("ai_trend"),
        F.col("c_acctbal").alias("fair_value"),
        *[text(m).alias(n) for m, n in zip((13, 17, 19, 23, 29, 31, 37, 41, 43), J.PROFILE_TEXTS)],
        F.when(k % 7 == 0, "see notes").otherwise("note\nHTTPS://example.com/x").alias("source_urls"),
    )


def review_rules(spark, d):
    return J.with_review_rules(_reviews(spark, d)).select("symbol", "research_verified", "company_profile_verified", "error")


def _companies(spark, d):
    filings = T.listing(spark, d).select(
        "symbol",
        F.element_at(F.array(*[F.lit(i) for i in (
            "Services-Prepackaged Software", "Retail-Drug Stores and Proprietary Stores", "Retail-Eating Places", "State Commercial Banks",
            "Crude Petroleum & Natural Gas", "Cement, Hydraulic", "Motor Vehicles & Passenger Car Bodies", "Blank Checks")]),
            (F.substring("symbol", 2, 20).cast("int") % 8 + 1)).alias("industry"),
    )
    quality = SC.quality_snapshot(RS.five(spark, d))
    return SC.build_screener(filings, T.listing(spark, d), quality, None, "ALL")


def screener(spark, d):
    out = SC.filter_companies(_companies(spark, d), trend="consumer", min_growth=-90.0, max_debt=5.0)
    return out.select("symbol", "industry_group", F.concat_ws("|", "trends").alias("trends"), "statements", "roe", "debt_to_equity", "net_margin", "revenue_cagr")


def industry_counts(spark, d):
    return SC.industry_counts(_companies(spark, d))


def trend_counts(spark, d):
    return SC.trend_counts(_companies(spark, d))


def shape_vectors(spark, d):
    rows = T.table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")
    )
    # Closed to a ring of 65 points, so that resampling to 64 has something to do.
    rows = SH.with_shape(rows.select("vec_id", F.concat("v", F.slice("v", 1, 1)).alias("v")), "v")
    return rows.select("vec_id", F.posexplode("shape").alias("i", "z")).select("vec_id", "i", F.round("z", 6).alias("z"))


def _index(spark, d):
    return SH.shape_index(smooth(spark, d), T.listing(spark, d), AS_OF, bars_kept=180)


def shape_match(spark, d):
    index = _index(spark, d)
    query = SH.with_shape(index.filter("symbol = 'S1'").select("closes"), "closes")
    return SH.match_shapes(index, query).select("symbol", F.round("score", 6).alias("score"))


def ranked_orders(spark, d):
    """All orders ranked by price, without one task that sees them all."""
    rows = T.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return CO.global_rank(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


def shape_closes(spark, d):
    out = SH.last_per_period(smooth(spark, d), "W")
    return out


def interpolated(spark, d):
    bars = raw(spark, d).select("symbol", F.datediff("date", F.lit("1995-01-01").cast("date")).alias("i"), F.when(F.col("volume") % 3 == 0, F.col("close")).alias("v"))
    return SH.interpolate_missing(bars, "symbol", "i", "v").withColumn("v", F.round("v", 6))


QUERIES = {
    f.__name__: f
    for f in (
        price_health, symbol_freshness, oldest_stale, stale_symbols, gap_fill, retained_history, publish_guard, statement_health, feed_checks,
        universe_overview, membership_changes, membership_merge, member_counts, normalized_symbols, closed_trades, rejected_trades,
        trade_summary, review_rules, screener, industry_counts, trend_counts, shape_vectors, shape_match, shape_closes, ranked_orders,
    )
}
QUERIES["interpolated_series"] = interpolated

_LATEST = "latest AS (SELECT symbol, max(date) AS latest_date FROM raw_bars GROUP BY 1)"
_TRADES = """
t0 AS (SELECT o_orderkey AS trade_id, CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, o_totalprice AS entry,
  round(o_totalprice * (0.9::DOUBLE + (o_orderkey % 5) * 0.04::DOUBLE), 6) AS stop,
  CASE WHEN o_orderstatus <> 'O' THEN round(o_totalprice * (0.8::DOUBLE + (o_orderkey % 41) * 0.01::DOUBLE), 6) END AS exit FROM orders),
t1 AS (SELECT *, CASE WHEN entry <= 0 THEN 'entry_not_positive' WHEN side = 'BUY' AND stop >= entry THEN 'stop_not_below_entry'
  WHEN side = 'SELL' AND stop > 0 AND stop <= entry THEN 'stop_not_above_entry' WHEN exit <= 0 THEN 'exit_not_positive' END AS error,
  round(abs(entry - stop) / entry * 100, 2) AS risk_pct, (exit / entry - 1) * 100 * CASE WHEN side = 'SELL' THEN -1 ELSE 1 END AS gross FROM t0),
t2 AS (SELECT trade_id, side, CASE WHEN exit IS NULL THEN 'open' ELSE 'closed' END AS state, risk_pct, round(gross, 3) AS return_pct,
  round(gross - 0.3, 3) AS return_pct_net, round(gross / nullif(risk_pct, 0), 2) AS r_multiple FROM t1 WHERE error IS NULL)"""

_COMPANIES = [
    S.LISTING,
    RS.STATEMENTS,
    RS.FIVE,
    RS.ratios_sql("five0", "ar"),
    """
qa AS (SELECT symbol, count(*) AS statements, arg_min(total_revenue, period_end) AS r1, arg_max(total_revenue, period_end) AS r2,
  max(roe) FILTER (i = 1) AS roe, max(debt_to_equity) FILTER (i = 1) AS de, max(net_margin) FILTER (i = 1) AS nm
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS i FROM ar) GROUP BY 1),
co AS (
  SELECT l.symbol, q.statements, round(q.roe, 1) AS roe, round(q.de, 2) AS debt_to_equity, round(q.nm, 1) AS net_margin,
    CASE WHEN r1 > 0 AND r2 > 0 THEN round((pow(r2 / r1, 1.0::DOUBLE / greatest(1, q.statements - 1)) - 1) * 100, 1) END AS revenue_cagr,
    CASE CAST(substr(l.symbol, 2) AS BIGINT) % 8 WHEN 0 THEN 'software' WHEN 1 THEN 'healthcare' WHEN 2 THEN 'consumer' WHEN 3 THEN 'financials'
      WHEN 4 THEN 'energy' WHEN 5 THEN 'materials' WHEN 6 THEN 'automotive' ELSE 'other' END AS industry_group
  FROM listing l LEFT JOIN qa q ON q.symbol = l.symbol
),
ct AS (SELECT *, CASE industry_group WHEN 'software' THEN ['ai', 'cloud'] WHEN 'healthcare' THEN ['healthcare'] WHEN 'consumer' THEN ['consumer']
  WHEN 'financials' THEN ['digital_finance'] WHEN 'energy' THEN ['real_assets'] WHEN 'materials' THEN ['energy_transition', 'infrastructure']
  WHEN 'automotive' THEN ['energy_transition'] ELSE [] END AS trends FROM co)""",
]


def _zshape(source):
    """Long form of the 64-point shapes of ``source`` (id, v)."""
    return f"""
pts AS (SELECT id, v, i, i * (len(v) - 1) / 63.0::DOUBLE AS x FROM {source}, unnest(range(64)) AS u(i)),
rs AS (SELECT id, i, v[CAST(floor(x) AS INTEGER) + 1] * (1 - (x - floor(x))) + v[least(len(v), CAST(floor(x) AS INTEGER) + 2)] * (x - floor(x)) AS y FROM pts),
zs AS (SELECT id, i, (y - avg(y) OVER (PARTITION BY id)) / coalesce(nullif(stddev_pop(y) OVER (PARTITION BY id), 0), 1) AS z FROM rs)"""


_TAILS = f"""
td AS (SELECT symbol, date, close FROM smooth_bars WHERE date < DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 180),
tl AS (SELECT symbol AS id, list(close ORDER BY date) AS v FROM td GROUP BY 1 HAVING count(*) >= 12)"""

SQL = {
    "price_health": S.with_(S.RAW, S.LISTING, _LATEST, "x AS (SELECT l.symbol, d.latest_date FROM listing l LEFT JOIN latest d ON d.symbol = l.symbol)",
    """
c AS (SELECT count(*) AS r, count(latest_date) AS s, count(*) FILTER (latest_date >= DATE '2001-10-30') AS f, max(latest_date) AS m FROM x),
h AS (SELECT *, CASE WHEN m < DATE '2001-10-30' THEN 'stale' WHEN s < 0.97 * r OR f < r THEN 'degraded' ELSE 'ready' END AS state FROM c)""")
    + """SELECT state, state = 'ready' AS can_publish, m AS latest_candle_date, DATE '2001-10-30' AS expected_eod_date, r AS symbols_requested, s AS symbols_succeeded,
  f AS symbols_fresh, r - s AS missing_count, 0 AS failed_count, round(s * 100.0::DOUBLE / r, 1) AS coverage FROM h""",
    "symbol_freshness": S.with_(S.RAW, _LATEST)
    + "SELECT count(*) AS checked, count(*) FILTER (latest_date >= DATE '2001-10-30') AS fresh, count(*) FILTER (latest_date < DATE '2001-10-30') AS stale, round(count(*) FILTER (latest_date >= DATE '2001-10-30') * 100.0::DOUBLE / count(*), 1) AS coverage_pct FROM latest",
    "oldest_stale": S.with_(S.RAW, "latest AS (SELECT symbol, max(date) AS latest_date FROM raw_bars WHERE date < DATE '2001-10-30' - CAST(substring(symbol, 2) AS INTEGER) % 9 GROUP BY 1)")
    + "SELECT * FROM latest WHERE latest_date < DATE '2001-10-30' ORDER BY latest_date, symbol LIMIT 12",
    "stale_symbols": S.with_(S.RAW, S.LISTING, _LATEST)
    + "SELECT l.symbol FROM listing l LEFT JOIN latest d ON d.symbol = l.symbol WHERE market = 'US' AND (latest_date IS NULL OR latest_date < DATE '2001-10-29')",
    "gap_fill": S.with_(S.RAW, S.LISTING, """
b AS (SELECT symbol, date FROM raw_bars WHERE date < DATE '2001-10-29' - CAST(substring(symbol, 2) AS INTEGER) % 13),
f AS (SELECT r.symbol, max(r.date) AS date FROM raw_bars r JOIN listing l ON l.symbol = r.symbol AND l.market = 'US' WHERE r.date <= DATE '2001-10-30' GROUP BY 1),
a AS (SELECT * FROM b UNION ALL SELECT f.symbol, f.date FROM f WHERE f.date > coalesce((SELECT max(b.date) FROM b WHERE b.symbol = f.symbol), DATE '1900-01-01'))""")
    + "SELECT symbol, count(*) AS bars, max(date) AS latest_date FROM a GROUP BY 1",
    "retained_history": S.with_(S.RAW, S.LISTING)
    + "SELECT r.symbol, count(*) AS bars FROM raw_bars r JOIN listing l ON l.symbol = r.symbol WHERE market = 'TH' OR date >= DATE '2001-01-01' GROUP BY 1",
    "publish_guard": S.with_(S.RAW, S.LISTING, "g AS (SELECT DISTINCT symbol FROM raw_bars WHERE date >= DATE '2001-10-25')")
    + "SELECT (SELECT count(*) FROM listing) AS requested, count(*) AS succeeded, count(*) >= 0.97 * (SELECT count(*) FROM listing) AS publish FROM listing JOIN g USING (symbol)",
    "statement_health": S.with_(*RS.COVERAGE, "ft AS (SELECT 'S' || (o_custkey % 100) AS symbol, max(o_orderdate) AS fetched_at FROM orders GROUP BY 1)")
    + """SELECT count(*) AS symbols_requested, count(*) FILTER (status <> 'missing') AS cached_symbols, count(*) FILTER (fetched_at >= TIMESTAMP '2001-07-28 00:00:00') AS fresh_symbols,
  count(*) FILTER (annual_complete) AS annual_5y_symbols, count(*) FILTER (status = 'complete') AS complete_symbols,
  count(*) FILTER (status NOT IN ('missing', 'complete')) AS partial_symbols, count(*) FILTER (status = 'missing') AS missing_symbols,
  round(count(*) FILTER (status = 'complete') * 100.0::DOUBLE / count(*), 1) AS complete_coverage_pct,
  CASE WHEN count(*) = count(*) FILTER (status = 'complete') THEN 'ready' WHEN count(*) FILTER (status <> 'missing') > 0 THEN 'partial' ELSE 'missing' END AS state
FROM cov3 c LEFT JOIN ft ON ft.symbol = c.symbol""",
    "feed_checks": S.with_(S.RAW, S.LISTING)
    + "SELECT (SELECT count(*) FROM listing) AS universe_symbols, count(DISTINCT symbol) AS priced_symbols, max(date) AS latest_date, DATE '2001-11-08' - max(date) AS age_days, DATE '2001-11-08' - max(date) > 5 AS too_old FROM raw_bars",
    "universe_overview": S.with_(*RS.COVERAGE, S.RAW, _LATEST, """
u AS (SELECT l.*, d.latest_date, c.status, c.annual_complete FROM listing l LEFT JOIN latest d ON d.symbol = l.symbol LEFT JOIN cov3 c ON c.symbol = l.symbol),
k AS (SELECT 'group' AS kind, unnest(string_split(upper(index_groups), '|')) AS id, latest_date, status, annual_complete FROM u
  UNION ALL SELECT 'market', market, latest_date, status, annual_complete FROM u UNION ALL SELECT 'total', 'all', latest_date, status, annual_complete FROM u)""")
    + """SELECT kind, id, count(*) AS registered, count(latest_date) AS price_available, count(*) FILTER (latest_date >= DATE '2001-10-30') AS price_fresh,
  count(latest_date) - count(*) FILTER (latest_date >= DATE '2001-10-30') AS price_stale, count(*) - count(latest_date) AS price_missing,
  count(*) FILTER (status <> 'missing') AS financial_cached, count(*) FILTER (annual_complete) AS annual_5y, count(*) FILTER (status = 'complete') AS financial_complete FROM k GROUP BY 1, 2""",
    "membership_changes": """WITH m AS (SELECT p_brand AS grp, 'S' || l_suppkey AS symbol, bool_or(l_shipdate < TIMESTAMP '1998-05-01') AS o, bool_or(l_shipdate >= TIMESTAMP '1998-05-01') AS n
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT grp AS "group", count(*) FILTER (n) AS members, count(*) FILTER (n AND NOT o) AS added, count(*) FILTER (o AND NOT n) AS removed, count(*) FILTER (o) AS before,
  round(count(*) FILTER (o AND NOT n)::DOUBLE / nullif(count(*) FILTER (o), 0), 6) AS removed_share,
  coalesce(count(*) FILTER (o AND NOT n)::DOUBLE / nullif(count(*) FILTER (o), 0) > 0.35, false) AS review FROM m GROUP BY 1""",
    "membership_merge": S.with_(S.LISTING)
    + """SELECT symbol, market, CASE WHEN account_balance > 5000 THEN sector ELSE 'Unknown' END AS sector,
  array_to_string(list_sort(CASE WHEN account_balance > 5000 THEN list_append(list_filter(string_split(index_groups, '|'), lambda g: g <> 'G1'), 'G1')
    ELSE list_filter(string_split(index_groups, '|'), lambda g: g <> 'G1') END), '|') AS index_groups FROM listing""",
    "member_counts": S.with_(S.LISTING) + "SELECT market, count(*) AS members FROM listing GROUP BY 1",
    "normalized_symbols": """SELECT p_partkey, CASE WHEN p_partkey > 0 AND p_partkey < 100000 THEN lpad(CAST(p_partkey AS VARCHAR), greatest(4, len(CAST(p_partkey AS VARCHAR)))::INT, '0') || '.HK' END AS hk,
  CASE WHEN len(split_part(p_name, ' ', 1)) <= 6 THEN upper(split_part(p_name, ' ', 1)) || '-A' END AS us,
  CASE WHEN p_partkey > 0 AND p_partkey < 100000 THEN 'HKEX:' || p_partkey END AS chart FROM part""",
    "closed_trades": S.with_(_TRADES) + "SELECT * FROM t2",
    "rejected_trades": S.with_(_TRADES) + "SELECT trade_id, error FROM t1 WHERE error IS NOT NULL",
    "trade_summary": S.with_(_TRADES)
    + """SELECT count(*) FILTER (state = 'open') AS open_count, count(*) FILTER (state = 'closed') AS closed_count,
  round(count(*) FILTER (return_pct_net > 0) * 100.0::DOUBLE / count(return_pct_net), 2) AS hit_rate_pct, round(avg(return_pct_net), 3) AS average_return_pct_net,
  round(avg(r_multiple), 2) AS average_r FROM t2""",
    "review_rules": """WITH r AS (SELECT c_name AS symbol, c_custkey AS k, c_acctbal AS fair, (c_custkey % 11 = 0 OR c_custkey % 2 = 0) AND c_custkey % 3 <> 0 AS reviewed,
  c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 23 <> 0 AND c_custkey % 29 <> 0 AND c_custkey % 31 <> 0
    AND c_custkey % 37 <> 0 AND c_custkey % 41 <> 0 AND c_custkey % 43 <> 0 AND c_custkey % 7 <> 0 AS texts FROM customer)
SELECT symbol, reviewed AS research_verified, reviewed AND texts AS company_profile_verified,
  CASE WHEN k % 4 = 3 THEN 'invalid_status' WHEN k % 11 = 0 THEN 'invalid_moat' WHEN fair < 0 THEN 'negative_fair_value'
    WHEN k % 4 IN (1, 2) AND NOT (reviewed AND texts) THEN 'profile_incomplete' END AS error FROM r""",
    "screener": S.with_(*_COMPANIES)
    + """SELECT symbol, industry_group, array_to_string(trends, '|') AS trends, statements, roe, debt_to_equity, net_margin, revenue_cagr FROM ct
WHERE list_contains(trends, 'consumer') AND revenue_cagr >= -90 AND debt_to_equity <= 5""",
    "industry_counts": S.with_(*_COMPANIES) + "SELECT industry_group, count(*) AS companies FROM ct GROUP BY 1",
    "trend_counts": S.with_(*_COMPANIES)
    + "SELECT t.trend, count(c.symbol) AS companies FROM (SELECT unnest(['ai', 'cloud', 'healthcare', 'energy_transition', 'digital_finance', 'infrastructure', 'consumer', 'real_assets']) AS trend) t LEFT JOIN ct c ON list_contains(c.trends, t.trend) GROUP BY 1",
    "shape_vectors": S.with_("src AS (SELECT vec_id AS id, CAST(embedding || embedding[1:1] AS DOUBLE[]) AS v FROM embeddings)", _zshape("src"))
    + "SELECT id AS vec_id, i, round(z, 6) AS z FROM zs",
    "shape_match": S.with_(S.SMOOTH, _TAILS, _zshape("tl"))
    + """SELECT a.id AS symbol, round(greatest(0, least(100, (sum(a.z * b.z) / 64 + 1) * 50)), 6) AS score
FROM zs a JOIN zs b ON a.i = b.i AND b.id = 'S1' GROUP BY 1 ORDER BY sum(a.z * b.z) DESC, a.id LIMIT 8""",
    "ranked_orders": "SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders",
    "shape_closes": S.with_(S.SMOOTH) + "SELECT symbol, max(date) AS date, arg_max(close, date) AS close FROM smooth_bars GROUP BY symbol, date_trunc('week', date)",
    "interpolated_series": S.with_(S.RAW, """
g AS (SELECT symbol, date - DATE '1995-01-01' AS i, CASE WHEN volume % 3 = 0 THEN close END AS v FROM raw_bars),
h AS (SELECT symbol, i, v, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS li,
  min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM g),
j AS (SELECT h.symbol, h.i, l.v AS lv, r.v AS rv, li, ri FROM h LEFT JOIN g l ON l.symbol = h.symbol AND l.i = li LEFT JOIN g r ON r.symbol = h.symbol AND r.i = ri)""")
    + "SELECT symbol, i, round(CASE WHEN li IS NULL THEN rv WHEN ri IS NULL THEN lv WHEN li = ri THEN lv ELSE lv * (1 - (i - li) / (ri - li)::DOUBLE) + rv * ((i - li) / (ri - li)::DOUBLE) END, 6) AS v FROM j WHERE li IS NOT NULL OR ri IS NOT NULL",
}
