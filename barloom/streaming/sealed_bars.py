"""Bars from a tick stream, emitted only once their period is complete."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import cut_lineage


def sealed_bars(ticks: DataFrame, timeframe: str = "D", lateness: str = "1 day") -> DataFrame:
    """Daily or ISO-weekly bars in append mode.

    ``ticks``: symbol, ts (timestamp), price, size. The watermark seals a period:
    its bar is emitted once, when no tick of it can arrive any more, and later
    ones are dropped. State is one small row per symbol and open period.
    """
    width, start = {"D": ("1 day", "0 seconds"), "W": ("7 days", "4 days")}[timeframe.upper()]
    stamped = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    # The price breaks ties of the time stamp, so replays give the same bar.
    order = F.struct("ts", "price")
    return (
        stamped.groupBy(F.window("ts", width, startTime=start), "symbol")
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume"),
            F.max("ts").cast("date").alias("date"),
        )
        .select("symbol", F.col("window.start").cast("date").alias("period"), "date", "open", "high", "low", "close", "volume")
    )


def tick_stream(spark: SparkSession, landing: str, schema: str) -> DataFrame:
    """Ticks of all files that land in a folder, also in folders below it."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(landing)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take what has arrived since the last call, append the bars that it seals to ``path``, and stop.

    The state of open periods and the watermark live in ``checkpoint``, so a new
    process goes on where the last one stopped, and each bar is written once.
    """
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


# --- running months -----------------------------------------------------------

MONTHS = "symbol string, open double, high double, low double, close double, volume double, first date, last date, month string, batch long"


def month_rows(days: DataFrame) -> DataFrame:
    """Daily bars summed up per symbol and calendar month."""
    return (
        days.withColumn("month", F.date_format("date", "yyyy-MM"))
        .groupBy("symbol", "month")
        .agg(
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
            F.min("date").alias("first"),
            F.max("date").alias("last"),
        )
    )


def merge_months(days: DataFrame, batch: int, path: str) -> None:
    """Bring sealed days into the running months of ``path``; the same batch again changes nothing.

    A batch writes the whole new row of every symbol and month that it touches,
    into partitions of its own (month, batch). It starts from the rows of earlier
    batches only, so a replay makes the same rows in the same place. Months that
    the batch does not touch are neither read nor written.
    """
    new = cut_lineage(month_rows(days))
    touched = [r[0] for r in new.select("month").distinct().collect()]  # months within one batch's days
    if not touched:
        return
    known = read_months(days.sparkSession, path, batch).where(F.col("month").isin(touched)).join(new.select("symbol", "month"), ["symbol", "month"], "left_semi")
    both = new.unionByName(known)
    merged = both.groupBy("symbol", "month").agg(
        F.min_by("open", "first").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last").alias("close"),
        F.sum("volume").alias("volume"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    rows = merged.withColumn("batch", F.lit(batch).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(path)


def read_months(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """One row for each symbol and month, that of the latest batch (of those numbered below ``before``)."""
    try:
        rows = spark.read.schema(MONTHS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], MONTHS)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    values = [c for c in rows.columns if c not in ("symbol", "month", "batch")]
    latest = rows.groupBy("symbol", "month").agg(F.max_by(F.struct(*values), "batch").alias("row"))
    return latest.select("symbol", "month", "row.*")


def drain_months(daily_stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take what has arrived, merge the days that it seals into the months of ``path``, and stop."""
    writer = daily_stream.writeStream.outputMode("append").foreachBatch(lambda days, batch: merge_months(days, batch, path))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
