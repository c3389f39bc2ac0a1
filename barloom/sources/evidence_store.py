"""Study results that scans read: a versioned table for each timeframe, with the day it was measured."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.sinks import publish_version, read_current

#: Days after which a study says nothing any more; a parameter of the reader.
MAXIMUM_AGE_DAYS = 45
EVIDENCE = (
    "pattern string, timeframe string, available boolean, verdict string, tradeable boolean, signals long, horizon_bars int, "
    "average_return_pct_net double, hit_rate_pct double, average_max_drawdown_pct double, baseline_return_pct_net double, "
    "baseline_hit_rate_pct double, return_edge_pp double, hit_rate_edge_pp double, measured_on date"
)


def write_evidence(evidence: DataFrame, folder: str, timeframe: str, as_of: dt.date | str) -> str:
    """Publish the evidence of one study (see ``study.evidence``); earlier ones stay as versions."""
    rows = evidence.withColumn("measured_on", F.lit(as_of).cast("date"))
    return publish_version(rows, f"{folder}/timeframe={timeframe}", f"{as_of}-{uuid.uuid4().hex[:8]}")


def read_evidence(
    spark: SparkSession, folder: str, timeframe: str, as_of: dt.date | str, max_age_days: int = MAXIMUM_AGE_DAYS
) -> DataFrame:
    """The newest evidence of a timeframe, without rows that are too old or measured after ``as_of``.

    Nothing stored or nothing recent is an empty table: a scan then finds every
    pattern unmeasured, and none is tradeable.
    """
    try:
        rows = read_current(spark, f"{folder}/timeframe={timeframe}")
    except FileNotFoundError:
        return spark.createDataFrame([], EVIDENCE)
    age = F.datediff(F.lit(as_of).cast("date"), "measured_on")
    return rows.where((age >= 0) & (age <= max_age_days))
