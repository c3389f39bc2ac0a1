"""A Merkle manifest of a table: one digest for all rows, and a proof for each.

Every row is a leaf. The leaves of a group stand in order of their key; runs of
``fan_out`` nodes become one node, level by level, until one is left, the group's
subroot. Subroots make a tree of the same kind above them, up to the root. A row's
proof are the other nodes of its run on each level.

The tree is rolled up by digits. The place of a leaf is written to the base of the
fan-out, and each grouping takes the lowest digit away and nests the structs below
it. That goes on within blocks of ``fan_out ** LEVELS`` leaves, whatever the size of
a group: rows are dealt by block once, all groupings of a block follow without
another exchange, and a block's nested struct is bounded. The blocks' own digests
are the leaves of the next tier, a thousandth as many. On the way back one transform
walks down each nested struct and gathers the siblings, and an explode gives the
rows; a block meets the siblings above it in a grouping by its number. No step joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.staging import staged

FAN_OUT = 2
#: Levels that are nested in one struct: 1,024 leaves with a fan-out of two.
LEVELS = 10
#: Rows of a partition, about, where leaves are put in order.
BUCKET_ROWS = 50_000
#: Siblings of one level: all digests before the own node, and all after it.
PATH = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """What a field adds to its leaf: byte count, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def group_name(value: Column) -> Column:
    """A key that sorts null first, then by bytes, and is never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def placed(leaves: DataFrame) -> DataFrame:
    """Adds ``index``, the place within ``group`` by ``key`` and ``leaf``, and ``total``, the group's leaves.

    Rows are dealt by range over all groups, so a group may take any number of
    partitions; equal rows are told apart by ``place``, so they may too. Only the
    partitions' counts are summed up.
    """
    order = ["group", F.asc_nulls_first("key"), "leaf", "place"]
    buckets = max(8, -(-leaves.count() // BUCKET_ROWS))
    dealt = staged(leaves.repartitionByRange(buckets, *order).withColumn("bucket", F.spark_partition_id()), "dealt")
    totals = dealt.groupBy("group", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "group", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("group")).alias("total")
    )
    inside = F.row_number().over(Window.partitionBy("group", "bucket").orderBy(*order[1:])) - 1
    rows = dealt.withColumn("inside", inside).join(starts, ["group", "bucket"])
    return rows.withColumn("index", (F.col("start") + F.col("inside")).cast("long")).drop("bucket", "start", "inside", "place")


def _above(total: Column, width: int) -> Column:
    """Nodes of a level where each stands for ``width`` leaves."""
    return F.ceil(total / F.lit(width)).cast("long")


def rolled(nodes: DataFrame, fan_out: int, levels: int) -> DataFrame:
    """``group, total, block, digest, nested`` of ``nodes`` (group, total, index, digest, held: a struct).

    A level at which a group has only one node left adds no hash.
    """
    place = F.col("index")
    digits = [F.pmod(F.floor(place / F.lit(fan_out**k)), F.lit(fan_out)).cast("int").alias(f"d{k}") for k in range(levels)]
    df = nodes.select("group", "total", F.floor(place / F.lit(fan_out**levels)).cast("long").alias("block"), *digits, "digest", F.col("held").alias("nested"))
    df = df.repartition("group", "block")
    for k in range(levels):
        kept = ["group", "total", "block", *(f"d{j}" for j in range(k + 1, levels))]
        runs = df.groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), "digest", "nested"))).alias("nested"))
        hashed = F.when(_above(F.col("total"), fan_out**k) > 1, F.sha2(F.array_join("nested.digest", ""), 256)).otherwise(F.col("nested")[0]["digest"])
        df = runs.withColumn("digest", hashed)
    return df.select("group", "total", "block", "digest", "nested")


def tree(nodes: DataFrame, fan_out: int = FAN_OUT, levels: int = LEVELS) -> list[DataFrame]:
    """All tiers of blocks over ``nodes``, each written; the last has one block for each group."""
    tiers = [staged(rolled(nodes, fan_out, levels), "tier")]
    while not tiers[-1].where("block > 0").isEmpty():
        below = tiers[-1].select(
            "group",
            _above(F.col("total"), fan_out**levels).alias("total"),
            F.col("block").alias("index"),
            "digest",
            F.struct(F.col("block").alias("under")).alias("held"),
        )
        tiers.append(staged(rolled(below, fan_out, levels), "tier"))
    return tiers


def _step(run: Column, child: Column) -> Column:
    """The siblings of ``child`` in its run."""
    before = F.filter(run, lambda s: s["digit"] < child["digit"])
    after = F.filter(run, lambda s: s["digit"] > child["digit"])
    digests = lambda a: F.array_join(F.transform(a, lambda s: s["digest"]), "")
    return F.struct(digests(before).alias("l"), digests(after).alias("r"))


def _down(hashed: Column) -> Callable[[Column], Column]:
    """From a node with ``nested`` children to the children with their own paths, where the level adds a hash."""

    def children(node: Column) -> Column:
        def child(c: Column) -> Column:
            longer = F.when(hashed, F.concat(F.array(_step(node["nested"], c)), node["path"])).otherwise(node["path"])
            return F.struct(c["nested"].alias("nested"), longer.alias("path"))

        return F.transform(node["nested"], child)

    return children


def _opened(blocks: DataFrame, kept: Sequence[str], fan_out: int, levels: int) -> DataFrame:
    """``kept``, ``held`` and ``path`` of every node of the blocks, which have ``nested`` and the ``path`` above them."""
    nodes = F.array(F.struct("nested", "path"))
    for k in reversed(range(levels)):
        nodes = F.flatten(F.transform(nodes, _down(_above(F.col("total"), fan_out**k) > 1)))
    return blocks.select(*kept, F.explode(nodes).alias("node")).select(*kept, F.col("node.nested").alias("held"), F.col("node.path").alias("path"))


def proofs(tiers: list[DataFrame], tops: DataFrame, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """``group, subroot, held, path`` of every leaf; ``tops`` has the ``subroot`` of each group, of any type, and the ``path`` above it."""
    paths = tops.select("group", F.lit(0).cast("long").alias("block"), "subroot", "path")
    for k, tier in reversed(list(enumerate(tiers))):
        none = F.lit(None)
        waiting = tier.select("group", "block", "total", "nested", none.cast(tops.schema["subroot"].dataType).alias("subroot"), none.cast(PATH).alias("path"))
        above = paths.select("group", "block", none.cast("long").alias("total"), none.cast(tier.schema["nested"].dataType).alias("nested"), "subroot", "path")
        met = waiting.unionByName(above).groupBy("group", "block").agg(
            *(F.first(c, ignorenulls=True).alias(c) for c in ("total", "nested", "subroot", "path"))
        )
        opened = _opened(met, ["group", "subroot"], fan_out, levels)
        if k == 0:
            return opened
        paths = staged(opened.select("group", F.col("held.under").alias("block"), "subroot", "path"), "paths")
    raise ValueError("a tree has a tier at least")


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    group: str = "lang",
    altered: Sequence[Column] | None = None,
    fan_out: int = FAN_OUT,
    levels: int = LEVELS,
) -> DataFrame:
    """``key, group, leaf, altered_leaf, subroot, root, path`` of every row of ``docs``.

    ``path``: per level from the leaf up, the digests left (``l``) and right (``r``)
    of the own node in its run. ``altered``: the columns with other values, to try
    proofs on; ``altered_leaf`` is their leaf where it differs, else null.

    Null values have their own mark in a leaf; a null group is a group of its own,
    the first. Rows without a key stand first in their group. Rows with the same key
    are ordered by their leaves; equal rows are equal leaves with a place each. An
    empty table gives no rows (and has no root). Other columns of ``docs`` are not read.
    """
    values = [F.col(c) for c in columns]
    leaves = docs.select(
        group_name(F.col(group)).alias("group"),
        F.col(key).alias("key"),
        leaf(values).alias("leaf"),
        (leaf(altered) if altered else F.lit(None).cast("string")).alias("other"),
        F.monotonically_increasing_id().alias("place"),
    )
    leaves = staged(leaves.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other"))), "leaves")
    nodes = placed(leaves).select("group", "total", "index", F.col("leaf").alias("digest"), F.struct("key", "leaf", "other").alias("held"))
    tiers = tree(nodes, fan_out, levels)
    # One row for each group from here on.
    subroots = tiers[-1].select("group", "digest")
    everything = Window.orderBy("group")
    tops = subroots.select(
        F.lit("").alias("group"),
        F.count("*").over(Window.partitionBy(F.lit(0))).alias("total"),
        (F.row_number().over(everything) - 1).cast("long").alias("index"),
        "digest",
        F.struct(F.col("group").alias("name"), F.col("digest").alias("subroot")).alias("held"),
    )
    upper = tree(tops, fan_out, levels)
    root = upper[-1].select(F.col("group"), F.col("digest").alias("subroot"), F.array().cast(PATH).alias("path"))
    opened = proofs(upper, root, fan_out, levels)
    # "subroot" of the upper tree is the root of all.
    of_groups = opened.select(F.col("held.name").alias("group"), F.struct(F.col("held.subroot").alias("own"), F.col("subroot").alias("root")).alias("subroot"), "path")
    rows = proofs(tiers, staged(of_groups, "subroots"), fan_out, levels)
    return rows.select(
        F.col("held.key").alias(key),
        F.when(F.col("group") != "", F.substring("group", 2, 2**31 - 1)).alias(group),
        F.col("held.leaf").alias("leaf"),
        F.col("held.other").alias("altered_leaf"),
        F.col("subroot.own").alias("subroot"),
        F.col("subroot.root").alias("root"),
        "path",
    )


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["l"], p["r"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))
