"""Benchmark decontamination with spaced seeds.

A mask such as 1101010 takes some of seven neighbouring words and ignores the
others; hashes of the taken words of documents and items are joined. Around each
hit, document and item are laid side by side on the hit's diagonal and words are
compared one by one, so substituted words inside a copied passage are tolerated
and chance hits fall away. Items of more than seven words keep at least one seed
under every set of substitutions that the rule allows. Shorter ones are taken
whole: by every choice of as many of their words as the rule asks for.

A bitmap of the items' words, of fixed size, first drops the windows with a word
that no item has. The items' hashes are broadcast only while there are at most ``MAX_BROADCAST``
of them; beyond that the same join shuffles. Only hits travel back to the
documents. One hot document or item is many independent rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.staging import staged

#: Fixed masks of one span: 1 takes the word, 0 ignores it. Each takes four.
MASKS = ("1101100", "1100101", "1010011", "0101101")
#: Items up to so many words have no spaced seeds but choices of their words.
SPAN = 7
#: A window of so many words with at least so many equal ones is an overlap.
WINDOW = 13
LEAST_EQUAL = 10
#: Words of 64 bits in the bitmap of the items' words.
BIT_WORDS = 4096
#: Rows of the small side that may be broadcast (about 24 bytes each).
MAX_BROADCAST = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def hashed_words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``id`` and ``words``, the hashes of the lower-cased words. A null key or text gives none."""
    body = F.lower(F.col(text))
    words = F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1)).alias("texts")
    split = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), words)
    return split.select("id", F.expr("transform(texts, w -> xxhash64(w))").alias("words"))


def vocabulary_bits(items: DataFrame) -> list[int]:
    """A bitmap of the hashed words of ``items``: ``BIT_WORDS`` numbers, whatever the items. A word's bit is never missing."""
    words = items.select(F.explode("words").alias("w"))
    bits = words.groupBy(F.expr(f"CAST(shiftrightunsigned(w, 6) & {BIT_WORDS - 1} AS INT)").alias("at"))
    out = [0] * BIT_WORDS
    for at, value in bits.agg(F.expr("bit_or(shiftleft(1L, CAST(w & 63 AS INT)))").alias("value")).collect():
        out[at] = value
    return out


def needed_of(size: int, window: int = WINDOW, least_equal: int = LEAST_EQUAL) -> int:
    """Equal words that make an overlap with an item of ``size`` words."""
    return -(-min(size, window) * least_equal // window)


def short_choices(sizes: list[int], window: int = WINDOW, least_equal: int = LEAST_EQUAL) -> list[tuple[int, tuple[int, ...]]]:
    """For items of these few sizes: size and places of every choice of as many words as an overlap needs."""
    return [(n, places) for n in sizes for places in combinations(range(n), needed_of(n, window, least_equal))]


def seeds(hashed: DataFrame, short: list[tuple[int, tuple[int, ...]]], bits: list[int] | None = None) -> DataFrame:
    """``id``, ``place`` of the window and ``seed``, a hash of mask and taken words.

    Without ``bits`` the seeds of items: of those up to ``SPAN`` words the choices in
    ``short``, of longer ones the masks. With ``bits`` those of documents: masks and
    choices anywhere, only windows whose taken words all may be words of the items.
    """
    if bits is not None:
        numbers = ", ".join(f"{b}L" if b > -(2**63) else "(-9223372036854775807L - 1L)" for b in bits)
        known = f"(shiftright(array({numbers})[CAST(shiftrightunsigned(w, 6) & {BIT_WORDS - 1} AS INT)], CAST(w & 63 AS INT)) & 1L) = 1L"
        hashed = hashed.withColumn("known", F.expr(f"transform(words, w -> {known})"))
    masks = [(0, tuple(k for k, bit in enumerate(mask) if bit == "1")) for mask in MASKS]
    arrays = []
    for number, (size, places) in enumerate([*masks, *short]):
        # A choice ends with its first and last word: the others may lie outside the document.
        first, span = (places[0], places[-1] - places[0] + 1) if size else (0, SPAN)
        taken = ", ".join(f"words[i + {k - first}]" for k in places)
        if bits is not None:
            fits = " AND ".join([f"size(words) >= {span}", *(f"known[i + {k - first}]" for k in places)])
            windows = f"filter(sequence(0, greatest(size(words) - {span}, 0)), i -> {fits})"
        elif size:
            windows = f"filter(array({first}), i -> size(words) = {size})"
        else:
            windows = f"filter(sequence(0, greatest(size(words) - {span}, 0)), i -> size(words) > {SPAN})"
        arrays.append(f"transform({windows}, i -> struct(i AS place, xxhash64({number}, {taken}) AS seed))")
    return hashed.select("id", F.explode(F.expr(f"concat({', '.join(arrays)})")).alias("s")).select("id", "s.place", "s.seed")


def _small(df: DataFrame, bound: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    least_equal: int = LEAST_EQUAL,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """Document and item pairs that share a passage: ``doc_id, item_id, n_equal, word_start``.

    ``n_equal`` is the most equal words in a window of ``window`` words (of the whole
    item where that is shorter, at the same share), ``word_start`` where the first
    such window begins in the document. Rows with a null key or text and texts without
    words share nothing. Rows that repeat a key count as one document, which
    shares what any of them does.
    """
    held = staged(hashed_words(items, item_key, item_text).where(F.size("words") >= 1), "items")
    sizes = held.where(F.size("words") <= SPAN).select(F.size("words").alias("n")).distinct().collect()
    short = short_choices(sorted(r["n"] for r in sizes), window, least_equal)
    item_seeds = seeds(held, short).select(F.col("id").alias("item"), F.col("place").alias("item_place"), "seed")
    words = hashed_words(docs, key, text)
    hits = (
        seeds(words, short, vocabulary_bits(held))
        .join(_small(staged(item_seeds, "item-seeds"), max_broadcast), "seed")
        .select("id", "item", (F.col("place") - F.col("item_place")).alias("diagonal"))
        .distinct()
    )
    hits = staged(hits, "seed-hits")
    hit_ids = hits.select("id").distinct()
    texts = words.join(_small(hit_ids, max_broadcast), "id", "left_semi")
    lanes = hits.join(held.select(F.col("id").alias("item"), F.col("words").alias("item_words")), "item")
    # The item's stretch of the document, cut out before anything else moves.
    aligned = texts.join(lanes, "id").select(
        "id",
        "item",
        "diagonal",
        F.size("item_words").alias("n"),
        F.expr(
            "filter(transform(item_words, (w, k) -> struct(k, k + diagonal BETWEEN 0 AND size(words) - 1"
            " AND words[if(k + diagonal BETWEEN 0 AND size(words) - 1, k + diagonal, 0)] = w AS same)), x -> x.same)"
        ).alias("equal"),
    )
    needed = F.ceil(F.least(F.col("n"), F.lit(window)) * F.lit(least_equal) / F.lit(window))
    steps = aligned.where(F.size("equal") >= needed).select("id", "item", "diagonal", "n", F.explode("equal.k").alias("k")).distinct()
    # Windows that end at an equal word hold all that matter: any other can slide there without losing one.
    back = Window.partitionBy("id", "item", "diagonal").orderBy("k").rangeBetween(-(window - 1), 0)
    counted = steps.select("id", "item", "diagonal", "n", "k", F.count("*").over(back).alias("n_equal"), F.min("k").over(back).alias("first"))
    best = F.max(F.struct(F.col("n_equal"), (-(F.col("first") + F.col("diagonal"))).alias("back")))
    return (
        counted.where(F.col("n_equal") >= needed)
        .groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))
        .agg(best.alias("best"))
        .select("doc_id", "item_id", F.col("best.n_equal").alias("n_equal"), (-F.col("best.back")).cast("long").alias("word_start"))
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that share no passage with an item; rows without a key or text stay."""
    found = staged(leaks(docs, items, key, **options).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    return docs.join(_small(found, options.get("max_broadcast", MAX_BROADCAST)), F.col(key) == F.col("_leaked"), "left_anti")
