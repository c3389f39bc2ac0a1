"""Session defaults. Operators never depend on them; they only make runs faster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session with adaptive execution and UTC dates."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master without one, as in tests, gets a temporary folder; on a
    cluster a missing folder is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="barloom-"))
        folder = _own_folder[0]
    return folder.rstrip("/")


_own_folder: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; the caller owns what it writes there."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def local_cores() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
