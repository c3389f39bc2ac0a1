"""Mixing sources to target weights, in blocks of words, by DataFrame functions only.

The words of a source stand in one stream, documents in a hashed order, and the
stream is cut into blocks of a fixed number of words. Every output shard has a fixed
number of slots. Each slot draws a source by the targets, which gives multinomial
counts per shard; what a source was drawn beyond its quota is drawn again among the
sources that lack some, so quotas hold exactly. The slots of a source are numbered
over all shards. Its n-th slot maps to a block by a permutation of the source's own,
a new one for every pass through the blocks, and is joined with the documents' pieces
by the block's number.

A permutation is a swap-or-not network: in each round a number and its mirror image
round a secret point swap if a hashed bit says so. That needs no table, no sort and no
range that is a power of two, and is one array fold per slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; slots of an output shard.
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Slots of a partition, about.
PART_SLOTS = 50_000
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: How often the words of a source may be taken at most.
PASSES = 3
ROUNDS = 24
#: Rows of a bucket, about, where the documents of a source are put in order.
BUCKET_ROWS = 20_000
#: A prime below 2**31: products of two remainders fit a long.
PRIME = 2_147_483_647


def mixed_number(x: str) -> str:
    """SQL of a pseudorandom number from 0 to ``PRIME`` - 1 of the non-negative long ``x``."""
    once = f"(({x}) % {PRIME} * 48271 + 11) % {PRIME}"
    twice = f"(({once}) * ({once}) + 1299709) % {PRIME}"
    return f"((({twice}) * ({twice}) + 15485863) % {PRIME})"


def mixed_bit(x: str) -> str:
    """SQL of a pseudorandom bit of the non-negative long ``x``; cheaper than a number, it stands in every round."""
    once = f"(({x}) % {PRIME} * 48271 + 11) % {PRIME}"
    return f"((({once}) * ({once}) + 1299709) % {PRIME} % 2)"


def permuted(index: str, blocks: str, points: str, stream: str) -> Column:
    """``index`` (0 to ``blocks`` - 1) under the permutation that ``points`` and ``stream`` stand for."""
    mirror = f"(({points}[r] + {blocks} - x) % {blocks})"
    bit = mixed_bit(f"greatest(x, {mirror}) + ({stream} * {ROUNDS} + r) * 1000003")
    fold = f"aggregate(sequence(0, {ROUNDS - 1}), {index}, (x, r) -> CASE WHEN {bit} = 1 THEN {mirror} ELSE x END)"
    return F.expr(fold)


def points(blocks: str, stream: str) -> Column:
    """The points of the rounds of a permutation."""
    at = f"({stream} * {ROUNDS} + r)"
    wide = f"({mixed_number(at + ' + 700001')} * {PRIME} + {mixed_number(at + ' + 900007')})"
    return F.expr(f"transform(sequence(0, {ROUNDS - 1}), r -> {wide} % {blocks})")


def source_name(value: Column) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """``sizes`` (source, source_size) with ``number`` (order of sources), ``weight`` and ``target`` words.

    A source stops at ``passes`` times its size; what it can't take goes to the others
    by weight. In order of size per weight the first that keeps below its stop gives
    the words per weight of all that do. One row for each source; no step sees more.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    table = sizes.withColumn("number", (F.row_number().over(order) - 1).cast("long"))
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.pmod("number", F.lit(len(weights)))]
    table = table.withColumn("weight", weight).withColumn("stop", (F.col("source_size") * passes).cast("double"))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "number")
    so_far, everything = by_stop.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    stopped, weight_before = (F.coalesce(F.sum(c).over(so_far), F.lit(0.0)) for c in ("stop", "weight"))
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - stopped) / (F.sum("weight").over(everything) - weight_before)
    table = table.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("stop") / F.col("weight"))
    table = table.withColumn("chosen", F.min(F.when(F.col("fits"), F.struct(F.col("stop") / F.col("weight"), "number", "level"))).over(everything)["level"])
    target = F.least(F.col("stop"), F.coalesce(F.col("chosen"), F.lit(0.0)) * F.col("weight"))
    return table.select("source", "source_size", "number", "weight", target.alias("target"))


def streams(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, source, name, size, start`` of every row: its words, and those before it in its source.

    Rows stand by a hash of the key. Buckets are prefixes of it; a source of any size
    is put in order bucket by bucket, and only bucket totals are summed up.
    """
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        source_name(F.col(source)).alias("name"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("hash"),
        F.xxhash64(text).alias("other"),
    )
    rows = staged(rows, "sized")
    digits, total = 2, rows.count()
    while 16**digits * BUCKET_ROWS < total:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("hash", 1, digits))
    totals = rows.groupBy("name", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("name", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("name", "bucket").orderBy("hash", "key", "size", "other").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["name", "bucket"])
    return placed.select("key", "source", "name", "size", (F.col("first") + F.col("inside")).cast("long").alias("start"))


def plan(rows: DataFrame, block_words: int = BLOCK_WORDS, weights: Sequence[int] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """Per source of ``rows`` (as ``streams`` gives them): its size, target, ``blocks`` and ``quota`` of slots."""
    sizes = rows.groupBy("source", "name").agg(F.sum("size").alias("source_size"))
    table = targets(sizes.select("source", "source_size"), weights, passes).withColumn("name", source_name(F.col("source")))
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    table = table.withColumn("blocks", blocks)
    # A block of the source has source_size / blocks words on average, its last one being shorter.
    quota = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long")
    return table.withColumn("quota", F.when(F.col("source_size") > 0, F.least(quota, F.col("blocks") * passes)).otherwise(F.lit(0).cast("long")))


def draws(sources: DataFrame, slots: int, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """``shard, number, n``: how often each shard draws each source, one draw a slot by the sources' quotas.

    The range of the random number is cut into cells, more of them than sources, and
    each source is listed in the cells it reaches into; a slot meets the one or two
    sources of its cell and takes the one whose part holds its number.
    """
    count = sources.count()
    width = -(-PRIME // max(1024, 4 * count))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    to_number = lambda quota: F.floor(quota / F.lit(slots) * F.lit(PRIME)).cast("long")
    parts = sources.where("quota > 0").withColumn("begin", F.coalesce(F.sum("quota").over(before), F.lit(0)))
    parts = parts.select("number", to_number(F.col("begin")).alias("low"), to_number(F.col("begin") + F.col("quota")).alias("high"))
    cells = parts.where("low < high").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") / width).cast("long"), F.floor((F.col("high") - 1) / width).cast("long")))
    )
    drawn = sources.sparkSession.range(slots).select(
        F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), F.expr(mixed_number(f"id + {seed} * 1000003")).alias("u")
    )
    drawn = drawn.withColumn("cell", F.floor(F.col("u") / width).cast("long"))
    met = drawn.join(staged(cells, "cells"), "cell").where("u >= low AND u < high")
    return met.groupBy("shard", "number").agg(F.count("*").alias("n"))


def settled(drawn: DataFrame, sources: DataFrame, parts: int = 8) -> DataFrame:
    """``shard, number, turn``: the slots, with the turns of a source numbered from 0 to its quota.

    Draws beyond a quota, in a random order of shards, go to the sources that were
    drawn too rarely: the i-th draw too many meets the i-th missing turn. ``parts``:
    partitions in which counts become slots again.
    """
    cells = drawn.join(sources.select("number", "quota"), "number")
    mixed = Window.partitionBy("number").orderBy(F.expr(mixed_number("shard * 7919 + number")), "shard").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("n").over(mixed), F.lit(0)))
    cells = cells.withColumn("kept", F.expr("greatest(0L, least(n, quota - first))"))
    cells = staged(cells, "draws")
    # A few bytes of counts stand for many slots: dealt by number, not by size.
    dealt = cells.where("kept > 0").repartition(parts, "shard", "number")
    kept = dealt.select("shard", "number", F.explode(F.expr("sequence(first, first + kept - 1)")).alias("turn"))

    def listed(df: DataFrame, n: str, order: Sequence[str]) -> DataFrame:
        """One row for each of ``n``, numbered through. Only rows with some come here: few for each source."""
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        begins = df.where(f"{n} > 0").withColumn("_begin", F.coalesce(F.sum(n).over(before), F.lit(0)))
        return begins.withColumn("_i", F.explode(F.expr(f"sequence(0L, {n} - 1)"))).withColumn("i", F.col("_begin") + F.col("_i"))

    over = listed(cells.withColumn("over", F.col("n") - F.col("kept")), "over", ["shard", "number"]).select("i", "shard")
    had = cells.groupBy("number").agg(F.sum("kept").alias("had"))
    lacking = sources.select("number", "quota").join(had, "number", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    lacking = listed(lacking.withColumn("lacks", F.col("quota") - F.col("had")), "lacks", ["number"])
    again = over.join(lacking.select("i", "number", (F.col("had") + F.col("_i")).alias("turn")), "i")
    return kept.unionByName(again.select("shard", "number", "turn"))


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    weights: Sequence[int] = WEIGHTS,
    passes: int = PASSES,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """The mix and the documents that it is made from.

    The mix has one row for each piece of a document in a slot: ``shard, slot, source,
    pass, block, key, start, word, words`` (``words`` words of the document from its
    ``word``-th on, from 0). The documents have ``key, source, size, start,
    source_size, target``; ``source`` and ``start`` tell rows with words apart. Both are
    written tables, and the same on every run.

    A null text has no words, and a document without words is in no block. Rows without
    a source are one source, the last; rows without a key, with a repeated key or of
    equal texts are documents like others. Without any words there are no slots. Other
    columns are not read.
    """
    rows = staged(streams(docs, key, text, source), "streams")
    sources = staged(plan(rows, block_words, weights, passes), "sources")
    slots = int(sources.agg(F.sum("quota")).first()[0] or 0)
    turns = settled(draws(sources, slots, shard_slots, seed), sources, max(8, -(-slots // PART_SLOTS)))
    stream = f"(number * {passes} + pass)"
    laps = sources.where("blocks > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long"))))
    laps = staged(laps.select("number", "name", "blocks", "pass", points("blocks", stream).alias("points")), "laps")
    sized = sources.select("number", F.col("blocks").alias("_blocks"))
    turns = turns.join(sized, "number").withColumn("pass", F.floor(F.col("turn") / F.col("_blocks")).cast("long"))
    turns = turns.withColumn("at", F.col("turn") % F.col("_blocks")).drop("_blocks").join(laps, ["number", "pass"])
    in_shard = Window.partitionBy("shard").orderBy(F.expr(mixed_number("turn * 31 + number * 7919")), "number", "turn")
    slot_rows = turns.select(
        "shard", (F.row_number().over(in_shard) - 1).alias("slot"), "name", "pass", permuted("at", "blocks", "points", stream).alias("block")
    )
    first, last = F.floor(F.col("start") / block_words).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    pieces = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.select("key", "source", "name", "start", "block", (begin - F.col("start")).alias("word"), (end - begin).alias("words"))
    mix = slot_rows.join(pieces, ["name", "block"]).select("shard", "slot", "source", "pass", "block", "key", "start", "word", "words")
    known = rows.join(sources.select("name", "source_size", "target"), "name").select("key", "source", "size", "start", "source_size", "target")
    return staged(mix, "mix"), known


def taken(mix: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` with ``taken``: the words of each document that the mix takes, repeats counted."""
    sums = mix.groupBy(source_name(F.col("source")).alias("_name"), F.col("start").alias("_start")).agg(F.sum("words").alias("taken"))
    rows = known.withColumn("_name", source_name(F.col("source")))
    # Documents without words share their start with the next one; they are in no piece.
    held = rows.where("size > 0").withColumn("_start", F.col("start")).join(sums, ["_name", "_start"], "left")
    none = rows.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    both = held.select(*known.columns, "taken").unionByName(none.select(*known.columns, "taken"))
    return both.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
