"""SQL building blocks for the check texts. Each constant is a CTE list entry."""

from __future__ import annotations

AS_OF = "2001-11-02"

LISTING = """
listing AS (
  SELECT 'S' || s_suppkey AS symbol, s_name AS name, s_acctbal AS account_balance,
    CASE n_regionkey WHEN 0 THEN 'US' WHEN 1 THEN 'TH' WHEN 2 THEN 'HK' WHEN 3 THEN 'CN' WHEN 4 THEN 'UK' END AS market,
    CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN '.BK' WHEN 2 THEN '.HK' WHEN 3 THEN '.SS' WHEN 4 THEN '.L' END AS suffix,
    n_name AS sector, r_name || '|G' || (s_suppkey % 3) AS index_groups
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

RAW = """
raw_bars AS (
  SELECT symbol, date,
    first(price ORDER BY l_orderkey, l_linenumber, l_partkey, price, size) AS open,
    max(price) AS high, min(price) AS low,
    last(price ORDER BY l_orderkey, l_linenumber, l_partkey, price, size) AS close,
    sum(size) AS volume
  FROM (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
               l_quantity AS size, l_orderkey, l_linenumber, l_partkey FROM lineitem)
  GROUP BY symbol, date
)"""

SMOOTH = """
day_means AS (
  SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
         round(avg(l_extendedprice), 6) AS mean_price, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2
),
smooth_close AS (
  SELECT symbol, date, volume,
    round(avg(mean_price) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS close
  FROM day_means
),
smooth_bars AS (
  SELECT symbol, date, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), close) AS open,
    round(close * 1.01, 6) AS high, round(close * 0.99, 6) AS low, close, volume
  FROM smooth_close
)"""


def resampled(source: str, name: str, timeframe: str, as_of: str | None = AS_OF) -> str:
    unit = {"W": "week", "M": "month"}[timeframe]
    keep = (
        f"WHERE NOT (period = date_trunc('{unit}', DATE '{as_of}') AND period = max_period)" if as_of else ""
    )
    return f"""
{name}_all AS (
  SELECT symbol, date_trunc('{unit}', date) AS period, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, date) AS close, sum(volume) AS volume, max(date) AS date
  FROM {source} GROUP BY 1, 2
),
{name} AS (
  SELECT symbol, date, open, high, low, close, volume
  FROM (SELECT *, max(period) OVER (PARTITION BY symbol) AS max_period FROM {name}_all) {keep}
)"""


def numbered(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM {source}
)"""


def ema(source: str, name: str, spans: tuple[int, ...] = (20, 50, 200)) -> str:
    """Recursive averages over ``source`` (which has rn); needs WITH RECURSIVE."""
    seed = ", ".join(f"close AS ema{n}" for n in spans)
    step = ", ".join(f"(b.close - e.ema{n}) * (2.0::DOUBLE / {n + 1}) + e.ema{n}" for n in spans)
    return f"""
{name} AS (
  SELECT symbol, rn, {seed} FROM {source} WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, {step} FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.rn = e.rn + 1
)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes) + "\n"
