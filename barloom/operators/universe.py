"""Index membership: normalize, validate, merge, count."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.filters import group_set

# Managed index groups with their market and allowed member counts.
MANAGED_GROUPS = {
    "SP500": ("US", 490, 520),
    "NASDAQ100": ("US", 95, 110),
    "SP400": ("US", 390, 415),
    "CSI300": ("CN", 300, 300),
    "HSI": ("HK", 85, 110),
    "HSTECH": ("HK", 30, 35),
}
MAXIMUM_AGE_DAYS = 14
MAXIMUM_DISAPPEARED = 0.35
UNTAGGED = "WATCHLIST"


def parse_holdings_date(value: Column) -> Column:
    """Dates as holdings files write them: ISO, 05-Sep-2026, Sep 5, 2026, 20260905, Sept."""
    text = F.regexp_replace(F.trim(value.cast("string")), r"^As of ", "")
    text = F.regexp_replace(text, r"\.0$", "")
    text = F.regexp_replace(text, r"(?i)Sept\b", "Sep")
    # Patterns are tried only on text of their own shape.
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
        .when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
        .when(text.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), F.try_to_date(F.initcap(text), "d-MMM-yyyy"))
        .when(text.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), F.try_to_date(F.initcap(text), "MMM d, yyyy"))
    ).cast("date")


def normalize_symbol(value: Column, market: Column) -> Column:
    """Exchange code to symbol; NULL when it is not valid for the market."""
    raw = F.upper(F.trim(value.cast("string")))
    number = F.when(raw.rlike(r"^\d{1,9}$"), raw.cast("int"))
    hong_kong = F.when((number > 0) & (number < 100000), F.concat(F.lpad(number.cast("string"), F.greatest(F.lit(4), F.length(number.cast("string"))), F.lit("0")), F.lit(".HK")))
    other = F.when(raw.rlike(r"^[A-Z][A-Z0-9]{0,5}([.-][A-Z])?$"), F.regexp_replace(raw, r"\.", "-"))
    return F.when(market == "HK", hong_kong).otherwise(other)


def equity_members(rows: DataFrame, market: str) -> DataFrame:
    """Members of a holdings table with Ticker, Name, Sector, Asset Class, Market Currency."""
    symbol = normalize_symbol(F.col("Ticker"), F.lit(market))
    out = rows.filter(F.col("Asset Class") == "Equity")
    wrong_counter = F.lit(market == "HK") & ~F.coalesce(F.col("Market Currency") == "HKD", F.lit(False))
    return out.select(
        symbol.alias("symbol"),
        F.trim("Name").alias("name"),
        F.coalesce(F.nullif("Sector", F.lit("")), F.lit("Unknown")).alias("sector"),
        F.lit(market).alias("market"),
        F.when(wrong_counter, "wrong_currency").when(symbol.isNull(), "invalid_symbol").alias("error"),
    )


def sheet_members(rows: DataFrame, market: str = "US") -> DataFrame:
    """Members of a holdings sheet landed as CSV: Name, Ticker, Identifier, Shares Held, Local Currency, Sector."""
    name = F.upper(F.trim(F.coalesce("Name", F.lit(""))))
    ticker = F.trim(F.coalesce("Ticker", F.lit("")))
    cash = ticker.isin("USD", "CASH_USD") | name.isin("US DOLLAR", "U.S. DOLLAR") | name.startswith("CASH") | name.startswith("CONTRA ")
    present = (ticker != "") & (F.coalesce(F.trim("Identifier"), F.lit("")) != "") & (F.coalesce(F.trim(F.col("Shares Held")), F.lit("")) != "")
    symbol = normalize_symbol(ticker, F.lit(market))
    return rows.filter(present & ~cash).select(
        symbol.alias("symbol"),
        F.trim("Name").alias("name"),
        F.lit(market).alias("market"),
        F.when(F.coalesce("Sector", F.lit("")).isin("", "-"), "Unknown").otherwise(F.col("Sector")).alias("sector"),
        F.when(~F.col("Identifier").rlike(r"^[A-Z0-9]{9}$"), "invalid_identifier")
        .when(~F.coalesce(F.col("Local Currency") == "USD", F.lit(False)), "wrong_currency")
        .when(symbol.isNull(), "invalid_symbol")
        .alias("error"),
    )


def index_members(rows: DataFrame, index_code: str = "000300", market: str = "CN") -> DataFrame:
    """Constituents landed as CSV: date, index_code, code, name, exchange."""
    code = F.lpad(F.regexp_replace("code", r"\.0$", ""), 6, "0")
    exchange = F.lower(F.regexp_replace("exchange", " ", ""))
    suffix = F.when(exchange == "shanghaistockexchange", ".SS").when(exchange == "shenzhenstockexchange", ".SZ")
    listed = F.lpad(F.regexp_replace("index_code", r"\.0$", ""), 6, "0")
    return rows.select(
        F.when(code.rlike(r"^\d{6}$"), F.concat(code, suffix)).alias("symbol"),
        F.trim("name").alias("name"),
        F.lit("Unknown").alias("sector"),
        F.lit(market).alias("market"),
        parse_holdings_date(F.col("date")).alias("as_of"),
        F.when(listed != index_code, "wrong_index").when(suffix.isNull() | ~code.rlike(r"^\d{6}$"), "unknown_exchange_or_code").alias("error"),
    )


def duplicate_symbols(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def validate_members(members: DataFrame, today: dt.date | str) -> DataFrame:
    """One row per group with its counts and the first rule it breaks, if any.

    ``members``: group, as_of, symbol, name, market. Rules on managed groups:
    at most 14 days old and not in the future, count inside its bounds, unique
    symbols, names present, the group's market.
    """
    day = F.lit(today).cast("date")
    rules = members.sparkSession.createDataFrame(
        [(g, *v) for g, v in MANAGED_GROUPS.items()], "group string, _market string, _low int, _high int"
    )
    stats = (
        members.join(F.broadcast(rules), "group", "left")
        .groupBy("group")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.count_distinct("symbol").alias("symbols"),
            F.min("as_of").alias("oldest"),
            F.max("as_of").alias("newest"),
            F.first("_low").alias("_low"),
            F.first("_high").alias("_high"),
            F.count_if((F.coalesce(F.trim("name"), F.lit("")) == "") | (F.col("market") != F.col("_market"))).alias("_bad"),
        )
    )
    error = (
        F.when(F.col("oldest") != F.col("newest"), "mixed_dates")
        .when((F.col("newest") > day) | (F.datediff(day, F.col("newest")) > MAXIMUM_AGE_DAYS), "stale_or_future")
        .when((F.col("members") < F.col("_low")) | (F.col("members") > F.col("_high")), "count_out_of_bounds")
        .when(F.col("symbols") != F.col("members"), "duplicate_symbols")
        .when(F.col("_bad") > 0, "missing_name_or_wrong_market")
    )
    return stats.select("group", "members", F.col("newest").alias("as_of"), error.alias("error"))


def membership_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per group: size, added, removed, and whether too many members disappeared.

    Tables ``group, symbol``. Counts only; :func:`changed_symbols` lists them.
    """
    both = _pairs(old, new)
    return (
        both.groupBy("group")
        .agg(
            F.count_if("_new").alias("members"),
            F.count_if(F.col("_new") & ~F.col("_old")).alias("added"),
            F.count_if(F.col("_old") & ~F.col("_new")).alias("removed"),
            F.count_if("_old").alias("before"),
        )
        .withColumn("removed_share", F.try_divide(F.col("removed"), F.col("before")))
        .withColumn("review", F.coalesce(F.col("removed_share") > MAXIMUM_DISAPPEARED, F.lit(False)))
    )


def _pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    a = old.select("group", "symbol", F.lit(True).alias("_old")).distinct()
    b = new.select("group", "symbol", F.lit(True).alias("_new")).distinct()
    return a.join(b, ["group", "symbol"], "full_outer").na.fill(False, ["_old", "_new"])


def changed_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    return _pairs(old, new).filter(F.col("_old") != F.col("_new")).select(
        "group", "symbol", F.when(F.col("_new"), "added").otherwise("removed").alias("change")
    )


def merge_memberships(existing: DataFrame, snapshots: DataFrame, refreshed: tuple[str, ...]) -> DataFrame:
    """Existing rows with refreshed group tags; nothing is ever deleted.

    ``snapshots``: group, symbol, name, market, sector of the ``refreshed`` groups.
    Their tags are replaced, custom tags stay, a symbol in no group becomes a
    watchlist entry. A known symbol takes the snapshot's market, and its sector
    only where its own is unknown.
    """
    members = _by_symbol(snapshots)
    both = existing.join(members, "symbol", "full_outer")
    own = F.filter(F.split(F.coalesce("index_groups", F.lit("")), r"\|"), lambda g: g != "")
    return _settled(both, F.array_except(own, F.array(*[F.lit(g) for g in refreshed])))


def _by_symbol(snapshots: DataFrame) -> DataFrame:
    """One row for each member of a snapshot, with all its groups."""
    return snapshots.groupBy("symbol").agg(
        F.sort_array(F.collect_set("group")).alias("_new"),
        F.max_by("name", "group").alias("_name"),
        F.max_by("market", "group").alias("_market"),
        F.min_by(F.nullif("sector", F.lit("Unknown")), "group").alias("_sector"),
    )


def _settled(both: DataFrame, kept: Column) -> DataFrame:
    """Merged rows from both sides: the tags ``kept`` with the new ones, and what each side knows of the symbol."""
    tags = F.array_union(kept, F.coalesce("_new", F.array().cast("array<string>")))
    tags = F.when(F.col("_new").isNotNull(), F.array_except(tags, F.array(F.lit(UNTAGGED)))).otherwise(tags)
    tags = F.when(F.size(tags) == 0, F.array(F.lit(UNTAGGED))).otherwise(F.array_sort(tags))
    vague = F.coalesce("sector", F.lit("Unknown")).isin("Unknown", "", "-", "Other")
    return both.select(
        "symbol",
        F.coalesce("name", "_name").alias("name"),
        F.coalesce("_market", "market").alias("market"),
        F.when(vague, F.coalesce("_sector", "sector", F.lit("Unknown"))).otherwise(F.col("sector")).alias("sector"),
        F.concat_ws("|", tags).alias("index_groups"),
    )


def update_memberships(existing: DataFrame, members: DataFrame, today: dt.date | str) -> tuple[DataFrame, DataFrame]:
    """(merged, report): a new snapshot merged into the universe, group by group.

    ``members``: group, as_of, symbol, name, market, sector. ``report`` has a row
    per group with its counts, the rule it breaks and whether it was ``accepted``; a
    group that breaks a rule or loses too many members keeps its old tags.
    """
    tags = existing.select("symbol", F.explode(F.split(F.coalesce("index_groups", F.lit("")), r"\|")).alias("group")).filter("group <> ''")
    managed = F.col("group").isin(*MANAGED_GROUPS)
    changes = membership_changes(tags.filter(managed), members.select("group", "symbol"))
    # A group that is only in the old universe has no new members to judge.
    report = validate_members(members, today).join(changes.select("group", "added", "removed", "removed_share", "review"), "group", "left")
    report = report.withColumn("error", F.when(~managed, "not_managed").otherwise(F.col("error")))
    report = report.withColumn("accepted", F.col("error").isNull() & ~F.coalesce("review", F.lit(False)))
    # Acceptance is a set that both sides are held against; at most one name per managed group.
    accepted = F.broadcast(report.filter(F.col("accepted") & managed).select("group"))
    kept = tags.join(accepted, "group", "left_anti").groupBy("symbol").agg(F.collect_set("group").alias("_kept"))
    new = _by_symbol(members.join(accepted, "group", "left_semi"))
    both = existing.join(new, "symbol", "full_outer").join(kept, "symbol", "left")
    return _settled(both, F.coalesce("_kept", F.array().cast("array<string>"))), report


def coverage_overview(universe: DataFrame, latest: DataFrame, coverage: DataFrame, expected: Column) -> DataFrame:
    """Registered, priced, fresh and statement counts per group, market and in total.

    ``latest``: symbol, latest_date. ``coverage``: symbol, status, annual_complete.
    """
    rows = (
        universe.select("symbol", "market", "index_groups")
        .join(latest.select("symbol", "latest_date"), "symbol", "left")
        .join(coverage.select("symbol", "status", "annual_complete"), "symbol", "left")
        .withColumn("_fresh", F.coalesce(F.col("latest_date") >= expected, F.lit(False)))
    )
    kinds = F.concat(
        F.transform(group_set(F.col("index_groups")), lambda g: F.struct(F.lit("group").alias("kind"), g.alias("id"))),
        F.array(
            F.struct(F.lit("market").alias("kind"), F.col("market").alias("id")),
            F.struct(F.lit("total").alias("kind"), F.lit("all").alias("id")),
        ),
    )
    # Counted per label with map-side partials: the total row is not a hot task.
    available = F.count("latest_date")
    fresh = F.count_if("_fresh")
    n = F.count(F.lit(1))
    return rows.select(F.explode(kinds).alias("k"), "latest_date", "_fresh", "status", "annual_complete").groupBy("k.kind", "k.id").agg(
        n.alias("registered"),
        available.alias("price_available"),
        fresh.alias("price_fresh"),
        (available - fresh).alias("price_stale"),
        (n - available).alias("price_missing"),
        F.count_if(F.coalesce("status", F.lit("missing")) != "missing").alias("financial_cached"),
        F.count_if(F.coalesce("annual_complete", F.lit(False))).alias("annual_5y"),
        F.count_if(F.coalesce(F.col("status") == "complete", F.lit(False))).alias("financial_complete"),
    )


def exchange_symbol(symbol: Column, market: Column) -> Column:
    """Symbol as an external charting site writes it, prefixed with its exchange."""
    place = F.upper(market)
    code = F.regexp_extract(symbol, r"(?i)^(\d+)\.HK$", 1)
    return (
        F.when(code != "", F.concat(F.lit("HKEX:"), F.regexp_replace(code, r"^0+(?=\d)", "")))
        .when(place == "TH", F.concat(F.lit("SET:"), F.replace(symbol, F.lit(".BK"), F.lit(""))))
        .when((place == "CN") & symbol.endswith(".SS"), F.concat(F.lit("SSE:"), F.replace(symbol, F.lit(".SS"), F.lit(""))))
        .when((place == "CN") & symbol.endswith(".SZ"), F.concat(F.lit("SZSE:"), F.replace(symbol, F.lit(".SZ"), F.lit(""))))
        .otherwise(symbol)
    )
