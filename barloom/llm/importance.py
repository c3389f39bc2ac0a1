"""Importance resampling of documents towards the distribution of a target table.

Runs of words are hashed into buckets. The logarithm of a bucket's share in the
target over its share in the documents is its gain; a document's weight is the mean
gain of its features, and the gains are one array of ``buckets`` numbers, so scoring
is an array look-up without any join. Noise from a hash of the key (Gumbel) turns the
highest scores into a sample drawn by weight.

The highest ``k`` are found by a distributed quickselect. Each round draws pivots at
random among the keys that are left, counts exactly how many keys are better than
each, equal and worse, and goes on between the two pivots that enclose the k-th key.
Keys are composite and distinct, so ties are settled in the same way at every size.
Only the winners are sorted, by range over all tasks, and ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.sharding import numbered
from barloom.llm.staging import staged

#: Fixed values of the feature rule: letters that are lower-cased, and what a word is.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Size of the array of gains; a parameter, and the same for every amount of data.
BUCKETS = 10_000
#: Pivots of a round of the quickselect.
PIVOTS = 31
#: Winners of a partition, about, where they are sorted.
BUCKET_ROWS = 50_000


def features(rows: DataFrame, text: str = "text", lowest: int = 1, highest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``n_words`` and ``hashed``: the bucket of each run of ``lowest`` to ``highest`` words. Null is no words."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    split = rows.withColumn("_words", words)

    def hashed(run: Column) -> Column:
        return F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int")

    def runs(n: int) -> Column:
        if n == 1:
            return F.transform("_words", hashed)
        starts = F.sequence(F.lit(1), F.size("_words") - (n - 1))
        found = F.transform(starts, lambda at: hashed(F.array_join(F.slice("_words", at, n), " ")))
        return F.when(F.size("_words") >= n, found).otherwise(F.array().cast("array<int>"))

    found = runs(lowest) if lowest == highest else F.concat(*(runs(n) for n in range(lowest, highest + 1)))
    return split.withColumns({"n_words": F.size("_words"), "hashed": found}).drop("_words", text)


def histogram(feature_rows: DataFrame) -> dict[int, int]:
    """Features per bucket, summed up before the shuffle; at most one number a bucket comes to the driver."""
    counts = feature_rows.select(F.explode("hashed").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return {r.bucket: r.n for r in counts.collect()}


def gains(of_docs: dict[int, int], of_target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of smoothed shares, rounded down, for each bucket."""
    docs, target = float(sum(of_docs.values()) + buckets), float(sum(of_target.values()) + buckets)
    return [
        math.floor(1000 * math.log((of_target.get(b, 0) + 1.0) * docs / ((of_docs.get(b, 0) + 1.0) * target))) for b in range(buckets)
    ]


def weight(hashed: Column, gain: list[int]) -> Column:
    """Mean gain of the features, rounded down; 0 without features."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    total = F.aggregate(hashed, F.lit(0).cast("long"), lambda a, b: a + table[b])
    n = F.size(hashed).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(((total - F.pmod(total, n)) / n).cast("long"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of seed and key; a null key is the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def kth(rows: DataFrame, key: Column, k: int, pivots: int = PIVOTS, seed: int = 1):
    """The k-th smallest (from 1) value of the struct ``key``, whose values are all distinct; ``k`` is at most the rows.

    A round reads the keys that are left twice, and leaves about one in half the
    number of pivots; those are written, so all rounds together write less than the
    first one reads. Nothing but pivots and their counts comes to the driver.
    """
    left = rows.select(key.alias("key"))
    kind = left.schema["key"].dataType
    while True:
        seed += 1
        drawn = [r.key for r in left.orderBy(F.xxhash64("key", F.lit(seed))).limit(pivots).collect()]
        at = [F.struct(*(F.lit(p[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields)) for p in drawn]
        counts = left.agg(
            *(F.count_if(F.col("key") < p).alias(f"less{i}") for i, p in enumerate(at)),
            *(F.count_if(F.col("key") == p).alias(f"same{i}") for i, p in enumerate(at)),
        ).first()
        low = high = None
        for i in range(len(at)):
            less, same = counts[f"less{i}"], counts[f"same{i}"]
            if less < k <= less + same:
                return drawn[i]
            if less + same < k and (low is None or less + same > low[0]):
                low = (less + same, i)
            if less >= k and (high is None or less < high[0]):
                high = (less, i)
        if low is not None:
            left = left.where(F.col("key") > at[low[1]])
            k -= low[0]
        if high is not None:
            left = left.where(F.col("key") < at[high[1]])
        left = staged(left, "keys-left")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    lowest: int = 1,
    highest: int = 1,
    buckets: int = BUCKETS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of every row of ``docs``.

    ``rank`` counts the drawn rows from 1, by score, then smaller key; it is null for
    the others. Of the rows with ``least_words`` words, ``percent`` of a hundred are
    drawn, rounded down. Null and empty texts have no features and weight 0. A row
    without a key stands behind those with one on ties; rows that repeat a key are
    rows of their own (on ties fewer features first, then their place in the table).
    An empty target leaves weights that only tell rare buckets from common ones; an
    empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    split = staged(features(rows, "text", lowest, highest, buckets), "features")
    aims = target.select(F.col(target_text).alias("text"))
    gain = gains(histogram(split), histogram(features(aims, "text", lowest, highest, buckets)), buckets)
    weighed = split.select(
        "key", "n_words", F.size("hashed").cast("long").alias("n_features"), weight(F.col("hashed"), gain).alias("weight")
    )
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed)).withColumn("place", F.monotonically_increasing_id())
    scored = staged(scored, "scored")
    able = F.col("n_words") >= least_words
    wanted = scored.where(able).count() * percent // 100
    out = ["key", "n_words", "n_features", "weight", "score"]
    if wanted == 0:
        return scored.select(F.col("key").alias(key), *out[1:], F.lit(None).cast("long").alias("rank"))
    better = F.struct(
        (-F.col("score")).alias("score"),
        F.col("key").isNull().alias("keyless"),
        F.coalesce("key", F.lit(0)).alias("key"),
        F.col("n_features").alias("features"),
        F.col("place").alias("place"),
    )
    last = kth(scored.where(able), better, wanted, pivots, seed)
    bound = F.struct(*(F.lit(last[f]).alias(f) for f in ("score", "keyless", "key", "features", "place")))
    drawn = F.coalesce(able & (better <= bound), F.lit(False))
    winners = scored.where(drawn).withColumn("order", better)
    parts = max(8, -(-wanted // BUCKET_ROWS))
    dealt = staged(winners.repartitionByRange(parts, "order").withColumn("bucket", F.spark_partition_id()), "winners")
    ranked = numbered(dealt, [], "bucket", ["order"], "rank").select(*out, (F.col("rank") + 1).alias("rank"))
    losers = scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(losers).withColumnRenamed("key", key)
