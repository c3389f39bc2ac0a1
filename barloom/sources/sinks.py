"""Writers: exports, summaries, stores, publish-then-swap."""

from __future__ import annotations

import datetime as dt

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import cut_lineage

EXPORT_COLUMNS = (
    "symbol", "name", "market", "sector", "last_price", "currency", "market_phase", "technical_score", "fundamental_score",
    "business_score", "valuation_score", "final_score", "grade", "decision", "verification_level", "liquidity_score",
    "turnover_usd", "pe", "pbv", "upside_pct", "price_as_of",
)


class NotReady(RuntimeError):
    """The price feed is not fit to publish."""


def scan_export(results: DataFrame) -> DataFrame:
    """Flat scan rows: 21 plain columns, pattern labels joined by `` | `` and the stop."""
    return results.select(
        *EXPORT_COLUMNS,
        F.concat_ws(" | ", F.transform("patterns", lambda h: h["name"])).alias("patterns"),
        F.round("risk_plan.stop", 4).alias("stop"),
    )


def write_scan_export(results: DataFrame, health: DataFrame, path: str) -> None:
    """CSV export, refused unless the feed's state is ready. ``health`` is one row."""
    state = health.select("state", "can_publish").first()
    if state is None or not state["can_publish"]:
        raise NotReady(f"price feed is {state['state'] if state else 'missing'}")
    scan_export(results).write.mode("overwrite").option("header", True).csv(path)


def write_scan_summary(overview: DataFrame, path: str, as_of: dt.date | str) -> None:
    overview.withColumn("as_of", F.lit(as_of).cast("date")).write.mode("overwrite").json(path)


def write_study(study, folder: str, summary_only: bool = True) -> None:
    """Study tables as Parquet, from one run of the study; events only on request."""
    study = study.computed()
    for name in ("stats", "baseline", "edges"):
        getattr(study, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    if not summary_only:
        study.events.write.mode("overwrite").partitionBy("timeframe").parquet(f"{folder}/events")


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars partitioned by year, so date filters prune folders.

    Rows go to even partitions by year, as many as their size asks for; a large
    year is split over several tasks, a small one is not.
    """
    bars.withColumn("year", F.year("date")).hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def publish_version(table: DataFrame, folder: str, version: str) -> str:
    """Write a new version next to the old ones and only then point readers to it.

    Earlier versions stay as backups. Pointers are numbered, and the largest number
    is current; a reader always finds a whole version and a failed write changes
    nothing. A writer claims its number by creating a file that must not be there
    yet. Of several writers one can do that; the others take the next number.
    """
    target = f"{folder}/version={version}"
    table.write.mode("errorifexists").parquet(target)
    spark = table.sparkSession
    number = _pointers(spark, folder).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
    while not _create_new(spark, f"{folder}/_claims/{number:08d}"):
        number += 1
    # A folder of its own: writers that append to one folder share its temporary files.
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.parquet(f"{folder}/_versions/number={number}")
    return target


_POINTER = "version string, number long"


def _pointers(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_POINTER).parquet(f"{folder}/_versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _POINTER)


def _create_new(spark: SparkSession, name: str) -> bool:
    """Create an empty file; False if it is there already. One of several callers gets True.

    Shared file systems decide that themselves. The local one, as in tests, only
    promises it through the operating system's own call.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    path = path.makeQualified(system.getUri(), system.getWorkingDirectory())
    system.mkdirs(path.getParent())
    try:
        if system.getScheme() == "file":
            jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Path.of(path.toUri()), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            system.create(path, False).close()
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "AlreadyExistsException"):
            return False
        raise
    return True


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    row = _pointers(spark, folder).orderBy(F.desc("number")).first()
    if row is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/version={row['version']}")


# --- stores by key ------------------------------------------------------------

STORE_BUCKETS = 64


def key_bucket(key: str = "symbol", buckets: int = STORE_BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def refresh_store(rows: DataFrame, path: str, key: str = "symbol", buckets: int = STORE_BUCKETS) -> list[int]:
    """Put the new rows of some keys into a store, in place of all that it holds of these keys.

    The store is partitioned by buckets of the key. Only the buckets that ``rows``
    reach are read and written again (dynamic partition overwrite); the files of the
    others stay as they are. Gives the buckets written. One writer at a time; a
    store's number of buckets never changes.
    """
    spark = rows.sparkSession
    new = cut_lineage(rows.withColumn("bucket", key_bucket(key, buckets)))
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
    if not touched:
        return []
    out = new
    if _exists(spark, path):
        held = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        out = held.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
    out.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_store(spark: SparkSession, path: str, keys: list[str] | None = None, key: str = "symbol", buckets: int = STORE_BUCKETS) -> DataFrame:
    """A store's rows; with a caller's list of ``keys`` only their buckets are read."""
    rows = spark.read.parquet(path)
    if keys is not None:
        wanted = spark.createDataFrame([(k,) for k in keys], f"{key} string")
        reach = sorted({r[0] for r in wanted.select(key_bucket(key, buckets)).collect()})
        rows = rows.where(F.col("bucket").isin(reach) & F.col(key).isin(keys))
    return rows.drop("bucket")


def write_profiles(profiles: DataFrame, path: str) -> list[int]:
    """Filing profiles of some symbols into their store; ``schema_version`` tells how they were made."""
    return refresh_store(profiles, path)


def read_profiles(spark: SparkSession, path: str, schema_version: int) -> DataFrame:
    """Only profiles of the wanted version; the filter reaches the scan."""
    return read_store(spark, path).filter(F.col("schema_version") == schema_version)
