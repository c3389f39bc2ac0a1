"""As-of join: the last right row on or before each left row, per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def asof_join(left: DataFrame, right: DataFrame, values: list[str], key: str = "symbol", on: str = "date") -> DataFrame:
    """``left`` plus ``values`` of the newest ``right`` row with ``right.on <= left.on``.

    Union and one sort per key: linear in both sides, with no range condition
    that could turn into a nested loop. Each side has at most one row per key and
    date, so a key is bounded by the calendar.
    """
    payload = [c for c in left.columns if c not in (key, on)]
    l_rows = left.select(
        key, on, F.lit(1).alias("_side"), F.struct(F.lit(True).alias("_x"), *payload).alias("_payload"),
        *[F.lit(None).cast(right.schema[v].dataType).alias(f"_r_{v}") for v in values],
    )
    payload_type = l_rows.schema["_payload"].dataType
    r_rows = right.select(
        key, on, F.lit(0).alias("_side"), F.lit(None).cast(payload_type).alias("_payload"), *[F.col(v).alias(f"_r_{v}") for v in values]
    )
    w = Window.partitionBy(key).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l_rows.unionByName(r_rows)
    # One struct, so that values of one and the same row come together.
    seen = F.when(F.col("_side") == 0, F.struct(*[F.col(f"_r_{v}").alias(v) for v in values]))
    both = both.withColumn("_seen", F.last(seen, ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(key, on, *[F.col(f"_payload.{c}").alias(c) for c in payload], *[F.col(f"_seen.{v}").alias(v) for v in values])
