"""Connected components of a link table by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.staging import staged


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of ``links``.

    Each round a node takes the smallest root among its own and its neighbours',
    tells its old root about it, and roots then point to their root's root; so
    chains shrink geometrically. A hub's messages are reduced by a minimum before
    the shuffle. Every round is a written table.
    """
    ways = links.select(F.col(left).alias("node"), F.col(right).alias("other")).where("node <> other")
    ways = staged(ways.unionByName(ways.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    roots = staged(ways.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "roots")
    while True:
        of_other = roots.select(F.col("node").alias("other"), F.col("root").alias("heard"))
        heard = ways.join(of_other, "other").groupBy("node").agg(F.min("heard").alias("heard"))
        near = roots.join(heard, "node").select("node", "root", F.least("root", "heard").alias("least"))
        near = staged(near, "near")
        if near.where("least < root").isEmpty():
            return roots
        told = near.groupBy(F.col("root").alias("node")).agg(F.min("least").alias("told"))
        hooked = near.join(told, "node", "left").select("node", F.least("least", F.coalesce("told", "least")).alias("root"))
        hooked = staged(hooked, "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        roots = staged(hooked.join(up, "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root")), "roots")
