"""Shards of equal row counts that keep linked documents together.

Documents with equal texts are linked. Labels start from a hash of the row. In
each round every linked group looks which shard most of its members are in and
moves the others there, as far as that shard's quota has room. Only counts move:
a group is one row with its members per shard, however many they are, so a group
with a third of all rows is as cheap as a pair. Unlinked documents then fill
every shard to the same count, at most one apart.

Numbers without gaps come in two steps, inside buckets of rows and then by the
buckets' totals, so no task ever orders a whole shard or a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.staging import staged

SHARDS = 24
ROUNDS = 4
#: Rows of a bucket, about, and the most buckets.
BUCKET_ROWS = 50_000
MAX_BUCKETS = 20_000


def bucket_count(rows: int) -> int:
    return max(8, min(MAX_BUCKETS, -(-rows // BUCKET_ROWS)))


def numbered(rows: DataFrame, within: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2.. without gaps within ``within``, by ``bucket`` and ``order`` inside.

    The totals of the buckets are a small table of their own; its running sum is
    joined back, so the rows themselves are only ordered inside a bucket.
    """
    keys = [*within, bucket]
    totals = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = rows.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return inside.join(starts, keys).withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_start", "_inside")


def _sums(groups: DataFrame, shards: int) -> list[int]:
    """Members per shard over all groups."""
    row = groups.agg(*(F.coalesce(F.sum(F.col("held")[s]), F.lit(0)).alias(str(s)) for s in range(shards))).first()
    return [int(x) for x in row]


def propagate(groups: DataFrame, capacity: int, shards: int, rounds: int, buckets: int) -> DataFrame:
    """``groups`` (group, members, held: members per shard) after the rounds of moves."""
    for _ in range(rounds):
        loads = _sums(groups, shards)
        room = [max(0, capacity - load) for load in loads]
        rooms = F.expr(f"array({', '.join(f'{r}L' for r in room)})")
        # Most members first; of equals the lower shard. Shards without room only keep what they have.
        best = F.expr(
            "array_max(transform(held, (n, s) -> struct(IF(rooms[s] > 0 OR n = members, n, -1L) AS n, -s AS back)))"
        )
        want = groups.withColumn("rooms", rooms).withColumn("best", best)
        want = want.select("group", "members", "held", "rooms", (-F.col("best.back")).alias("to"), F.greatest(F.col("best.n"), F.lit(0)).alias("stay"))
        want = want.withColumn("moving", F.when(F.expr("rooms[to] > 0"), F.col("members") - F.col("stay")).otherwise(0)).withColumn(
            "bucket", F.pmod(F.xxhash64("group", F.lit(7)), F.lit(buckets))
        )
        # First come, first served: what stands before a group in its bucket and in the buckets before.
        totals = want.groupBy("to", "bucket").agg(F.sum("moving").alias("sum"))
        earlier = Window.partitionBy("to").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select("to", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
        inside = Window.partitionBy("to", "bucket").orderBy(F.desc("stay"), "group").rowsBetween(Window.unboundedPreceding, -1)
        want = want.withColumn("ahead", F.coalesce(F.sum("moving").over(inside), F.lit(0))).join(starts, ["to", "bucket"])
        take = F.expr("greatest(0L, least(moving, rooms[to] - start - ahead))")
        moved = want.withColumn("take", take.cast("long"))
        # One walk over the shards: those before give up members until ``take`` have gone to the wanted one.
        walk = (
            "aggregate(sequence(0, size(held) - 1), named_struct('left', take, 'held', CAST(array() AS ARRAY<BIGINT>)), "
            "(a, s) -> named_struct('left', IF(s = to, a.left, a.left - least(held[s], a.left)), "
            "'held', array_append(a.held, IF(s = to, held[s] + take, held[s] - least(held[s], a.left)))), a -> a.held)"
        )
        groups = staged(moved.select("group", "members", F.expr(walk).alias("held")), "groups")
    return groups


def running(held: str) -> Column:
    """Sums of the counts up to each shard, in one walk."""
    return F.expr(
        f"aggregate({held}, named_struct('sum', 0L, 'ends', CAST(array() AS ARRAY<BIGINT>)), "
        "(a, n) -> named_struct('sum', a.sum + n, 'ends', array_append(a.ends, a.sum + n)), a -> a.ends)"
    )


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; law `rows`: counts of shards are at most one apart.

    A null text has size 8, the checksum of no bytes and no link; empty texts are
    linked like any equal texts. Rows without a key and repeated rows are placed
    like others. An empty table gives no rows.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("key"),
        (F.length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("crc"),
        F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("group"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = staged(rows, "rows")
    total = rows.count()
    buckets = bucket_count(total)
    start = F.pmod(F.xxhash64("key", "crc", "size", F.lit(1)), F.lit(shards))
    # By the row's place in the table: rows that are equal in everything are spread like others.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("place", F.lit(2)), F.lit(buckets))).drop("place")
    counted = rows.where("group IS NOT NULL").groupBy("group", "size", "crc").agg(
        F.count("*").alias("members"), F.array(*(F.count_if(start == s) for s in range(shards))).alias("held")
    )
    links = counted.where("members > 1").select(F.struct("group", "size", "crc").alias("group"), "members", "held")
    floor, extra = divmod(total, shards)
    links = staged(links, "groups")
    groups = propagate(links, floor + (extra > 0), shards, rounds, bucket_count(links.count()))
    loads = _sums(groups, shards)
    # The fuller shards take the odd rows.
    odd = set(sorted(range(shards), key=lambda s: (-loads[s], s))[:extra])
    quota = [floor + (s in odd) for s in range(shards)]
    quotas = F.expr(f"array({', '.join(f'{q}L' for q in quota)})")

    linked = rows.withColumn("group", F.struct("group", "size", "crc"))
    salts = linked.groupBy("group", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("group").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ends = groups.select("group", running("held").alias("ends"))
    placed = salts.join(ends, "group").select("group", "salt", "ends", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    joined = rows.select("key", "size", "crc", "salt", F.struct("group", "size", "crc").alias("group")).join(placed, ["group", "salt"], "left")
    rank = F.row_number().over(Window.partitionBy("group", "salt").orderBy("key")) - 1
    member = (
        joined.where("ends IS NOT NULL")
        .withColumn("rank", rank + F.col("first"))
        .withColumn("shard", F.expr("size(filter(ends, e -> e <= rank))"))
        .select("key", "size", "crc", "salt", "shard")
    )
    member = staged(numbered(member, ["shard"], "salt", ["key", "crc", "size"], "slot"), "members")
    kept = member.where(F.col("slot") < quotas[F.col("shard")])
    rest = member.where(F.col("slot") >= quotas[F.col("shard")]).select("key", "size", "crc", "salt")
    single = joined.where("ends IS NULL").select("key", "size", "crc", "salt")
    pool = numbered(single.unionByName(rest), [], "salt", ["key", "crc", "size"], "number")
    filled = [min(load, q) for load, q in zip(loads, quota)]
    ends_at, at = [], 0
    for load, q in zip(filled, quota):
        at += q - load
        ends_at.append(at)
    free_ends = F.expr(f"array({', '.join(f'{e}L' for e in ends_at)})")
    base = F.expr(f"array({', '.join(f'{f}L' for f in filled)})")
    begin = F.expr(f"array({', '.join(f'{e}L' for e in [0, *ends_at[:-1]])})")
    shard = F.size(F.filter(free_ends, lambda e: e <= F.col("number")))
    pool = pool.withColumn("shard", shard).withColumn("slot", F.col("number") - begin[F.col("shard")] + base[F.col("shard")])
    out = kept.select("key", "size", "crc", "shard", "slot").unionByName(pool.select("key", "size", "crc", "shard", "slot"))
    return out.select(F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int"), F.col("slot").cast("long"))


def cut_links(placed: DataFrame, group: Column) -> DataFrame:
    """Links that a placement cuts: of each group, members outside its fullest shard. One row."""
    cells = placed.groupBy(group.alias("group"), "shard").agg(F.count("*").alias("n"))
    groups = cells.groupBy("group").agg((F.sum("n") - F.max("n")).alias("cut"))
    return groups.agg(F.sum("cut").alias("cut"))
