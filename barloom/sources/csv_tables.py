"""CSV readers: prices, fundamentals, universe."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.numeric import computed_once
from barloom.session import cut_lineage

# Accepted header names per price field.
PRICE_ALIASES = {
    "date": ("date", "timestamp", "time", "datetime"),
    "symbol": ("symbol", "ticker", "symbol_name"),
    "open": ("open",),
    "high": ("high",),
    "low": ("low",),
    "close": ("close",),
    "volume": ("volume",),
    "adjusted_close": ("adjusted_close", "adj_close", "adj close"),
    "adjusted_open": ("adjusted_open",),
}
REQUIRED = ("date", "open", "high", "low", "close")
# Prefixes of price files, longer ones first; further ones are a parameter.
FILE_PREFIXES = ("prices_", "trading_", "tradingview_")


def read_text_columns(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with every column as text under its trimmed, lower-case header name.

    Only the header line is read ahead; there is no inference pass. Files under
    one path must share a header: one that differs fails the job, since its
    columns would land under other names. ``read_price_files`` takes differing ones.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], T.StructType([]))
    # Names as the file has them, so that every file's header is held against them; then the plain ones.
    rows = spark.read.csv(path, header=True, schema=_text_schema([n or f"_c{i}" for i, n in enumerate(next(csv.reader([first[0][0]])))]), enforceSchema=False, mode="PERMISSIVE")
    return rows.toDF(*[_plain(n) for n in rows.columns])


def split_lines(lines: DataFrame, header: str, line: str = "line") -> DataFrame:
    """Text columns of lines without a header; other columns of ``lines`` stay. Short lines have nulls at the end."""
    names = [_plain(n or f"_c{i}") for i, n in enumerate(next(csv.reader([header])))]
    others = [c for c in lines.columns if c != line]
    schema = ", ".join(f"`{n}` string" for n in names)
    return lines.select(*others, _parsed(line, schema))


def _parsed(line: str, schema: str) -> Column:
    """A line's cells as columns. A generated row is not copied into later filters, which would parse the line once for each column they name."""
    return F.inline(F.array(F.from_csv(F.col(line), F.lit(schema))))


def _plain(name: str) -> str:
    return name.replace("\ufeff", "").strip().lower()


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def symbol_from_file(path: Column, prefixes: tuple[str, ...] = FILE_PREFIXES) -> Column:
    """Symbol a price file is named after; the first of ``prefixes`` that fits is stripped."""
    alternatives = "|".join(prefixes)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1), rf"^(?i:{alternatives})", "")
    return F.upper(F.regexp_replace(F.regexp_replace(stem, "_BK", ".BK"), "_", "."))


def parse_date(value: Column) -> Column:
    """ISO dates and timestamps, slashes, a trailing Z, and epoch seconds or milliseconds (UTC)."""
    text = F.trim(value)
    digits = text.rlike(r"^\d+$")
    number = F.when(digits, text.try_cast("bigint"))
    seconds = F.when(number > 10_000_000_000, F.floor(number / 1000)).otherwise(number)
    iso = F.regexp_replace(F.regexp_replace(text, "/", "-"), "Z", "+00:00")
    # The date part is taken as written, whatever the offset.
    return F.when(digits, F.timestamp_seconds(seconds).cast("date")).otherwise(F.try_to_date(F.substring(iso, 1, 10), "yyyy-MM-dd"))


def first_value(df: DataFrame, *names: str, default: str = "") -> Column:
    """First non-empty value across column aliases, case-insensitive."""
    lookup = {c.strip().lower(): c for c in df.columns}
    found = [F.nullif(F.col(f"`{lookup[n.lower()]}`"), F.lit("")) for n in names if n.lower() in lookup]
    return F.coalesce(*found, F.lit(default))


def read_price_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Price files that share one header to bars; see ``price_rows``."""
    return price_rows(read_text_columns(spark, path), F.input_file_name())


def read_price_files(spark: SparkSession, path: str | list[str], skip_bad: bool = False) -> DataFrame:
    """Price files of any headers to bars, in one job.

    Each file's own header decides where its fields are. A file without a required
    column is an error that names it, unless ``skip_bad`` leaves such files out. A
    record is a line; line breaks inside quotes are not read.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("value").alias("line"),
        # Lines of a file in order: its splits by their offset, lines as they are read.
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"),
    )
    rows, problems = price_files(lines, F.col("place.block") == 0)
    bad = [] if skip_bad else problems.limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r.file} is missing columns: {', '.join(r.missing)}" for r in bad))
    return rows


FIELD_ORDER = tuple(PRICE_ALIASES)


def _positions(header: str) -> tuple[list[int | None], list[str]]:
    """Where the fields are in a header, in the order of ``FIELD_ORDER``, and which required ones are not."""
    names = [_plain(n) for n in next(csv.reader([header]), [])]
    first = {n: k for k, n in reversed(list(enumerate(names)))}
    at = [next((first[a] for a in PRICE_ALIASES[f] if a in first), None) for f in FIELD_ORDER]
    return at, sorted(f for f, k in zip(FIELD_ORDER, at) if f in REQUIRED and k is None)


def price_files(lines: DataFrame, may_be_header: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, problems) of the lines of many price files.

    ``lines``: file, line, place (anything that orders the lines of a file). A file's
    first line is its header. Files are grouped by header: the distinct headers, few
    however many files there are, are resolved once, and every line is parsed once
    by the positions of its file. ``problems`` has ``file`` and ``missing`` of the
    files that lack a required column; they have no bars. Empty files have neither.
    ``may_be_header`` tells the lines among which headers are, where that is known.
    """
    spark = lines.sparkSession
    heads = lines.where(may_be_header) if may_be_header is not None else lines
    heads = heads.groupBy("file").agg(F.min_by("line", "place").alias("header"), F.min("place").alias("_first"))
    heads = cut_lineage(heads)
    headers = [r[0] for r in heads.select("header").distinct().collect()]
    resolved = [(h, *_positions(h)) for h in headers]
    width = max((len(next(csv.reader([h]), [])) for h in headers), default=1)
    layouts = spark.createDataFrame(resolved, "header string, _at array<int>, missing array<string>")
    files = heads.join(F.broadcast(layouts), "header")
    problems = files.where(F.size("missing") > 0).select("file", "missing")
    good = files.where(F.size("missing") == 0).select("file", "_first", "_at")
    rows = lines.join(good, "file").where(F.col("place") != F.col("_first"))
    schema = ", ".join(f"c{k} string" for k in range(max(width, 1)))
    cells = rows.select("file", "_at", _parsed("line", schema))
    cells = cells.select("file", "_at", F.array(*(F.col(f"c{k}") for k in range(max(width, 1)))).alias("_cells"))
    fields = {f: F.get("_cells", F.col("_at")[k]) for k, f in enumerate(FIELD_ORDER)}
    named = computed_once(cells, fields).drop("_at", "_cells")
    return price_rows(named, F.col("file")), problems


def price_rows(rows: DataFrame, file: Column) -> DataFrame:
    """Text columns to bars; a missing required column is an error, rows too short for them are skipped.

    ``file`` names the symbol of rows that have none.
    """
    lookup = set(rows.columns)
    chosen = {f: next((a for a in aliases if a in lookup), None) for f, aliases in PRICE_ALIASES.items()}
    missing = sorted(f for f in REQUIRED if chosen[f] is None)
    if missing:
        raise ValueError(f"price file is missing columns: {', '.join(missing)}")

    def text(field: str) -> Column:
        name = chosen[field]
        return F.nullif(F.trim(F.col(f"`{name}`")), F.lit("")) if name else F.lit(None).cast("string")

    complete = F.lit(True)
    for field in REQUIRED:
        complete = complete & F.col(f"`{chosen[field]}`").isNotNull()
    return rows.filter(complete).select(
        F.coalesce(text("symbol"), symbol_from_file(file)).alias("symbol"),
        parse_date(F.col(f"`{chosen['date']}`")).alias("date"),
        *[text(f).cast("double").alias(f) for f in ("open", "high", "low", "close")],
        F.coalesce(text("volume").cast("double"), F.lit(0.0)).alias("volume"),
        text("adjusted_close").cast("double").alias("adjusted_close"),
        text("adjusted_open").cast("double").alias("adjusted_open"),
    ).filter("symbol <> ''")


FUNDAMENTAL_NUMBERS = (
    "roe", "roa", "debt_to_equity", "revenue_growth", "profit_growth", "gross_margin", "net_margin", "pe", "pbv", "dividend_yield",
    "analyst_upside_pct", "liquidity_score",
)


def read_fundamentals_csv(spark: SparkSession, path: str) -> DataFrame:
    """Fundamentals files; see ``fundamental_rows``."""
    return fundamental_rows(read_text_columns(spark, path))


def fundamental_rows(rows: DataFrame) -> DataFrame:
    """Fundamentals with blank numbers as 0 and the usual text defaults."""
    have = set(rows.columns)

    def text(name: str, default: str = "") -> Column:
        # Only an absent column takes the default; a blank stays blank.
        return F.trim(F.coalesce(F.col(name), F.lit(""))) if name in have else F.lit(default)

    number = lambda n: F.coalesce(F.nullif(F.trim(n), F.lit("")).cast("double"), F.lit(0.0)) if n in have else F.lit(0.0)
    return rows.select(
        F.trim("symbol").alias("symbol"), text("name").alias("name"), text("market", "US").alias("market"), text("sector").alias("sector"),
        *[number(n).alias(n) for n in FUNDAMENTAL_NUMBERS],
        text("moat", "medium").alias("moat"), text("ai_trend", "neutral").alias("ai_trend"), text("notes").alias("notes"),
        text("index_groups").alias("index_groups"), F.lit(True).alias("fundamentals_verified"),
    )


def read_universe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Universe files; see ``universe_rows``."""
    return universe_rows(read_text_columns(spark, path))


def universe_rows(rows: DataFrame) -> DataFrame:
    """Listed symbols with market, sector and groups; rows without a symbol drop out."""
    out = rows.select(
        F.trim(first_value(rows, "symbol", "ticker")).alias("symbol"),
        F.trim(first_value(rows, "name")).alias("_name"),
        F.trim(first_value(rows, "market", default="US")).alias("market"),
        F.trim(first_value(rows, "sector", default="Unknown")).alias("sector"),
        F.trim(first_value(rows, "index_groups", "group")).alias("index_groups"),
    ).filter("symbol <> ''")
    return out.withColumn("name", F.coalesce(F.nullif("_name", F.lit("")), F.col("symbol"))).drop("_name")


def assert_unique_symbols(universe: DataFrame) -> DataFrame:
    """Fails the job when a symbol is listed twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    checked = universe.withColumn("_n", n)
    return checked.filter(F.coalesce(F.assert_true(F.col("_n") == 1, "duplicate symbol in universe").isNull(), F.lit(True))).drop("_n")


def symbol_list(universe: DataFrame, limit: int | None = None, position: str | None = None) -> DataFrame:
    """Distinct symbols with their market; ``limit`` keeps the first.

    The order is that of ``position``, a column with a row's place in its file,
    and a symbol's market is that of its first row; without it the order is by symbol.
    """
    if position is None:
        out = universe.groupBy("symbol").agg(F.min("market").alias("market"))
        return out.orderBy("symbol").limit(limit) if limit is not None else out
    out = universe.groupBy("symbol").agg(F.min_by("market", position).alias("market"), F.min(position).alias(position))
    return out.orderBy(position).limit(limit) if limit is not None else out
