"""Documents linked by the Jaccard similarity of their word shingles, exactly.

The document by shingle incidence matrix is multiplied with its transpose in
blocks of shingles: overlap counts of two documents add up over the blocks, and
pairs below the bounds that their sizes set are discarded before any sets are
compared. The matrix is thinned first, by steps that lose no link:

- Documents with the same shingle set are one node (equal texts among them).
- Two linked nodes lack few of each other's shingles, so they share one of the
  ``prefix`` of each: its shingles of smallest hash, as many as a node may lack,
  and one. With a sixteenth more they share several. A node whose prefix has
  fewer shared shingles than that is linked with nothing.
- For the nodes that are left, whole sets are counted. A node can overlap with
  another by its shared shingles at most, so it needs 80 % of its own to be
  shared. It enters the product with its rarest ones, as many as it may lack and
  one; passages that many documents share are common and open no pairs.
- A node first meets only the most central node of its shingles (that whose
  shingles are most shared: of edited copies, the original), and the centre of the
  component that it is in. That links groups of copies of any size by a pair or
  two for each. The product itself then takes only pairs that are not connected
  yet and can be linked by what both share with that centre.

Candidates are verified on whole sets. Sizes: 100 * overlap >= 80 * union, in
integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm import wordhash
from barloom.llm.components import components
from barloom.llm.staging import staged

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Rarest common shingles that a pair must show in the product.
COUNTED = 3
#: Rounds in which a node meets one more central node of another component before the product.
ROUNDS = 1
#: Rows of a table of ids that may be broadcast (8 bytes each, checked).
MAX_BROADCAST = 2_000_000


def least_overlap(n):
    """Least overlap of a set of n with any linked one: PERCENT of n, rounded up."""
    return (n * PERCENT + 99) // 100


def prefix_size(n):
    """Shingles of n that enter the first step: one more than can be lacking, and a sixteenth."""
    return np.minimum(n, n - least_overlap(n) + 1 + n // 16)


def least_shared(n):
    """Prefix shingles that a set of n shares with any linked one, by the smallest size of that."""
    m = least_overlap(n)
    return np.maximum(1, np.minimum(np.minimum(m, m - least_overlap(m) + 1 + m // 16) - (m - least_overlap(m)), prefix_size(n) - (n - least_overlap(n))))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[wordhash.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: its rows' set sizes, where the sets begin, nodes (hashes of the sets) and the shingles by row and hash."""
    for words in wordhash.blocks(batch.column("_text")):
        row, value = wordhash.shingles(words, WIDTH)
        count = np.bincount(row, minlength=words.rows)
        begin = np.concatenate(([0], np.cumsum(count)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wordhash.mixed(value))))
        node = wordhash.mixed(sums[begin[1:]] - sums[begin[:-1]] + count.astype(np.uint64)).view(np.int64)
        yield words, count, begin, node, value


def nodes_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``text_hash`` (of the text as it is), set size ``n`` and ``node`` (null without words)."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, count, _, node, _ in _sets(batch):
                keys, hashes = (batch.column(c).slice(words.first_row, words.rows) for c in ("_key", "_hash"))
                sizes = pa.array(count.astype(np.int64))
                yield pa.RecordBatch.from_arrays([keys, hashes, sizes, pa.array(node, mask=count == 0)], ["key", "text_hash", "n", "node"])

    named = docs.select(F.col(key).cast("long").alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    return named.mapInArrow(nodes, "key long, text_hash long, n long, node long")


def _row_id(key: str, text_hash: str) -> Column:
    """What tells texts apart, smallest key first: a key may stand for several texts, and a text may lack a key."""
    return F.struct(F.col(key).isNull().alias("keyless"), F.col(key).alias("key"), F.col(text_hash).alias("text_hash"))


def _rows_with(docs: DataFrame, ids: DataFrame, key: str, text: str, how: str) -> DataFrame:
    """Rows of ``docs`` whose key and text are among ``ids`` (key, text_hash), or are not, by ``how``."""
    ids = ids.select(F.col("key").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(ids, F.col(key).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), how)


def prefixes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``shingle, node``: prefix shingles of every node, once in each task that meets the node."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for words, count, begin, node, value in _sets(batch):
                new = np.zeros(words.rows, dtype=bool)
                for k in np.flatnonzero(count):
                    if (name := int(node[k])) not in met:
                        met.add(name)
                        new[k] = True
                row = np.repeat(np.arange(words.rows), count)
                inside = new[row] & (np.arange(len(value)) - begin[row] < prefix_size(count)[row])
                # As signed numbers shingles are only names; which are smallest is settled here.
                yield pa.RecordBatch.from_arrays([pa.array(value[inside].view(np.int64)), pa.array(node[row[inside]])], ["shingle", "node"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(spread, "shingle long, node long")


def whole_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row with words: ``node`` and ``shingles``, the whole set; once in each task that meets the node."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for _, count, begin, node, value in _sets(batch):
                new = np.zeros(len(count), dtype=bool)
                for k in np.flatnonzero(count):
                    if (name := int(node[k])) not in met:
                        met.add(name)
                        new[k] = True
                held = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node), held], ["node", "shingles"]).filter(pa.array(new))

    return docs.select(F.col(text).alias("_text")).mapInArrow(sets, "node long, shingles array<long>")


def _overlap(n: Column) -> Column:
    return F.floor((n * PERCENT + 99) / 100)


def _least_shared(n: Column) -> Column:
    m = _overlap(n)
    g = lambda x: F.least(x, x - _overlap(x) + 1 + F.floor(x / 16)) - (x - _overlap(x))
    return F.greatest(F.lit(1), F.least(g(m), g(n)))


def survivors(prefix_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``node, n`` of the nodes that share enough of their prefix with others."""
    same = Window.partitionBy("shingle")
    shared = prefix_rows.withColumns({"low": F.min("node").over(same), "high": F.max("node").over(same)}).where("low <> high")
    # A node stands once for each task that met it.
    counted = shared.groupBy("node").agg(F.count("*").alias("rows"), F.count_distinct("shingle").alias("shared"))
    return counted.join(sizes, "node").where(F.col("shared") >= _least_shared(F.col("n"))).select("node", "n")


def incidence(sets: DataFrame) -> DataFrame:
    """``shingle, node, n, shared, place, central``: the part of the matrix that can reach the bounds.

    ``shared``: how many shingles of the node others have; ``place``: of this
    shingle among them, rarest first, from 0; ``central``: how common the node's
    shingles are on average.
    """
    rows = sets.select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    common = rows.withColumn("df", F.count("*").over(Window.partitionBy("shingle"))).where("df > 1")
    of_node = Window.partitionBy("node")
    ranked = common.withColumns(
        {
            "place": F.row_number().over(of_node.orderBy("df", "shingle")) - 1,
            "shared": F.count("*").over(of_node),
            "central": F.sum("df").over(of_node) / F.col("n"),
        }
    )
    able = ranked.where(F.col("shared") >= _overlap(F.col("n")))
    # Places among all shingles: those of this node alone come first.
    kept = able.where(F.col("place") + F.col("n") - F.col("shared") <= F.col("n") - _overlap(F.col("n")) + (COUNTED - 1))
    return kept.select("shingle", "node", "n", "shared", "place", "central")


def _can_link(n: Column, m: Column, most: Column) -> Column:
    """Whether sets of n and m may be linked if they overlap by ``most`` at most."""
    return most * (100 + PERCENT) >= (n + m) * PERCENT


def central_pairs(matrix: DataFrame) -> DataFrame:
    """Candidates ``a, b, n, m``: each node ``b`` with the most central node ``a`` of another component that it meets.

    ``matrix`` has ``root``, and ``centre`` and ``inside`` as ``with_centres`` makes them.
    """
    same = Window.partitionBy("shingle")
    who = F.struct("central", "node", "root", "n", "shared", "centre", "inside")
    top = matrix.withColumn("top", F.max(who).over(same))
    next_best = F.max(F.when(F.col("root") != F.col("top.root"), who)).over(same)
    met = top.withColumn("next", next_best).where("next IS NOT NULL")
    met = met.withColumn("hub", F.when(F.col("root") != F.col("top.root"), F.col("top")).otherwise(F.col("next")))
    chosen = met.where(_can_link(F.col("n"), F.col("hub.n"), _most_shared("hub."))).groupBy("node", "n").agg(F.max("hub").alias("hub"))
    return chosen.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("n"), F.col("n").alias("m"))


def _most_shared(other: str) -> Column:
    """Most that a node can share with another (columns with the prefix ``other``), from what both share with their centre.

    With a common centre: inside it no more than the less similar node does, and
    outside it no more than either shares with anyone there. That rules out nearly
    every pair of edited copies that are not linked by their original.
    """
    inside, shared = F.least("inside", other + "inside"), F.least("shared", other + "shared")
    outside = F.least(F.col("shared") - F.col("inside"), F.col(other + "shared") - F.col(other + "inside"))
    return F.when(F.col("centre") == F.col(other + "centre"), inside + outside).otherwise(shared)


def centre_pairs(matrix: DataFrame, met: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates ``a, b, n, m`` of nodes ``b`` with the most central node ``a`` of the component of the node that they met."""
    nodes = matrix.groupBy("node").agg(F.max("n").alias("n"), F.max("central").alias("central"))
    of_root = roots.join(nodes, "node").groupBy("root").agg(F.max(F.struct("central", "node", "n")).alias("c"))
    of_hub = roots.join(of_root, "root").select(F.col("node").alias("a"), F.col("c.node").alias("centre"), F.col("c.n").alias("size"))
    found = met.select("a", "b", "m").join(of_hub, "a").where((F.col("centre") != F.col("a")) & (F.col("centre") != F.col("b")))
    return found.select(F.col("centre").alias("a"), "b", F.col("size").alias("n"), "m")


def with_centres(matrix: DataFrame, met: DataFrame) -> DataFrame:
    """Adds ``centre`` and ``inside``: how much of it the node holds. ``met`` (a, b, overlap); a node without is its own centre."""
    known = met.select(F.col("b").alias("node"), F.col("a").alias("_centre"), F.col("overlap").alias("_inside"))
    joined = matrix.join(known, "node", "left")
    own = F.col("_centre").isNull()
    return joined.withColumns(
        {"centre": F.when(own, F.col("node")).otherwise(F.col("_centre")), "inside": F.when(own, F.col("shared")).otherwise(F.col("_inside"))}
    ).drop("_centre", "_inside")


def _with_roots(matrix: DataFrame, roots: DataFrame) -> DataFrame:
    return matrix.join(roots.withColumnRenamed("root", "_root"), "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")


def open_pairs(matrix: DataFrame) -> DataFrame:
    """Candidates between nodes of different components, from the product over all blocks.

    Rows of a shingle stand together, by size, so a node meets the larger ones that
    still fit and can share enough with it. If two sets overlap by k, their first
    ``COUNTED`` common shingles stand among the first shared - k + ``COUNTED`` of
    each; only those places count. Overlaps there are added up within a block and
    over all blocks, and a pair with fewer is discarded. Only shingles of two
    components are left by then.
    """
    both = Window.partitionBy("shingle")
    mixed = matrix.withColumns({"low": F.min("root").over(both), "high": F.max("root").over(both)}).where("low <> high")
    names = ("shingle", "n", "node", "root", "shared", "centre", "inside", "place")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            shingle, n, node, root, shared, centre, inside, place = (rows.column(c).to_numpy() for c in names)
            spare = shared - place + (COUNTED - 1)  # most overlap for which the place counts
            edges = np.concatenate(([0], np.flatnonzero(shingle[1:] != shingle[:-1]) + 1, [len(shingle)]))
            one, two, waiting = [], [], 0
            for begin, end in zip(edges, edges[1:]):
                reach = begin + np.searchsorted(n[begin:end] * PERCENT, n[begin:end] * 100, "right")
                for i in range(begin, end):
                    j = np.arange(i + 1, reach[i - begin])
                    common = np.minimum(inside[i], inside[j]) + np.minimum(shared[i] - inside[i], shared[j] - inside[j])
                    most = np.where(centre[i] == centre[j], common, np.minimum(shared[i], shared[j]))
                    needed = ((n[i] + n[j]) * PERCENT + 99 + PERCENT) // (100 + PERCENT)
                    j = j[(root[j] != root[i]) & (most >= needed) & (spare[i] >= needed) & (spare[j] >= needed)]
                    if len(j):
                        one.append(np.full(len(j), i))
                        two.append(j)
                        waiting += len(j)
                    if waiting > 500_000:
                        yield added(n, node, np.concatenate(one), np.concatenate(two))
                        one, two, waiting = [], [], 0
            if waiting:
                yield added(n, node, np.concatenate(one), np.concatenate(two))

        def added(n: np.ndarray, node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            """Overlap counts of this block, one row per pair."""
            swap = node[i] > node[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            order = np.lexsort((node[j], node[i]))
            i, j = i[order], j[order]
            at = np.flatnonzero(np.concatenate(([True], (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1]))))
            overlap = np.diff(np.append(at, len(i)))
            i, j = i[at], j[at]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], n[i], n[j], overlap)], ["a", "b", "n", "m", "overlap"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            last = batch.column("shingle")[-1].as_py()
            if batch.column("shingle")[0].as_py() == last and (not held or held[-1].column("shingle")[-1].as_py() == last):
                held.append(batch)
                continue
            start = int(np.searchsorted(batch.column("shingle").to_numpy(), last))
            yield from pairs(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = [batch.slice(start)]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    dealt = mixed.select(*names).repartition("shingle").sortWithinPartitions("shingle", "n", "node")
    found = dealt.mapInArrow(product, "a long, b long, n long, m long, overlap long")
    summed = found.groupBy("a", "b", "n", "m").agg(F.sum("overlap").alias("overlap"))
    needed = F.ceil((F.col("n") + F.col("m")) * PERCENT / (100 + PERCENT))
    return summed.where(F.col("overlap") >= F.least(F.lit(COUNTED), needed)).drop("overlap")


def overlaps(pairs: DataFrame, sets: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``pairs`` (a, b, n, m) with ``overlap`` of their whole sets and whether they are ``linked``.

    Only the sets of nodes that stand in a pair move.
    """

    def needed(side: str) -> DataFrame:
        ids = _small(pairs.select(F.col(side).alias("node")).distinct(), max_broadcast)
        return sets.join(ids, "node", "left_semi").select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}"))

    both = pairs.join(needed("b"), "b").join(needed("a"), "a")
    counted = both.withColumn("overlap", F.size(F.array_intersect("of_a", "of_b")).cast("long")).drop("of_a", "of_b")
    return counted.withColumn("linked", F.col("overlap") * 100 >= (F.col("n") + F.col("m") - F.col("overlap")) * PERCENT)


def _small(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def grouped_rows(docs: DataFrame, key: str, text: str, max_broadcast: int = MAX_BROADCAST, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: ``key, text_hash, n, node`` and ``group``, the same for all rows that links reach; null without words."""
    rows = staged(nodes_of(docs, key, text), "nodes")
    # One text stands for a node, with a key or without.
    sizes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("n").alias("n"), F.min(_row_id("key", "text_hash")).alias("row"))
    left = staged(survivors(prefixes(docs, text), sizes).join(sizes.select("node", "row"), "node"), "survivors")
    wanted = left.select("row.key", "row.text_hash").distinct()
    texts = _rows_with(docs, _small(wanted, max_broadcast), key, text, "left_semi")
    nodes = _small(left.select("node"), max_broadcast)
    sets = staged(whole_sets(texts, text).join(nodes, "node", "left_semi"), "sets")
    if not sets.groupBy("node").count().where("count > 1").isEmpty():  # a row that the table repeats
        sets = staged(sets.dropDuplicates(["node"]), "sets")
    matrix = staged(incidence(sets), "matrix")

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        return staged(overlaps(pairs, sets, max_broadcast), name)

    alone = matrix.withColumns({"root": F.col("node"), "centre": F.col("node"), "inside": F.col("shared")})
    met = compared(central_pairs(alone), "met")
    links = met.where("linked").select("a", "b")
    centred = compared(centre_pairs(matrix, met, components(links)), "centred")
    links = links.unionByName(centred.where("linked").select("a", "b"))
    roots = components(links)
    # The centre's overlap, where it was not the node that was met.
    met = centred.unionByName(met.join(centred.select("b"), "b", "left_anti"))
    matrix = staged(with_centres(matrix, met), "centred-matrix")
    for _ in range(rounds):
        found = compared(central_pairs(_with_roots(matrix, roots)), "central").where("linked").select("a", "b")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        roots = components(links)
    more = compared(open_pairs(_with_roots(matrix, roots)), "open").where("linked").select("a", "b")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    return rows.join(roots, "node", "left").select("key", "text_hash", "n", "node", F.coalesce("root", "node").alias("group"))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    ``component_id`` is the smallest key that links reach. Null, empty and
    white-space texts have no shingles and are linked with nothing: they keep their
    own key. A row without a key links others like any row, and joins their group,
    but never names it; where no row has a key, the component is null. Rows that
    repeat a key with other texts are linked each by its own text.
    """
    grouped = grouped_rows(docs, key, text, max_broadcast, rounds)
    least = grouped.where("group IS NOT NULL").groupBy("group").agg(F.min("key").alias("least"))
    return grouped.join(least, "group", "left").select(
        F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component_id")
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row of ``docs`` for each group, and every row that is in none.

    A group keeps its row of smallest key; of equal keys that of smallest text hash,
    and a row without a key only where none has one. That is settled for each row, so
    a key that stands for several texts keeps what the groups of those texts keep.
    Texts without words are in no group; of rows that repeat a key and such a text
    one stays, and without a key all of them.
    """
    grouped = staged(grouped_rows(docs, key, text, max_broadcast), "groups")
    row = _row_id("key", "text_hash")
    kept = grouped.where("group IS NOT NULL").groupBy("group").agg(F.min(row).alias("kept"))
    gone = grouped.join(kept, "group").where(row != F.col("kept")).select("key", "text_hash").distinct()
    left = _rows_with(docs, _small(gone, max_broadcast), key, text, "left_anti")
    same = grouped.where("key IS NOT NULL OR group IS NOT NULL").groupBy("key", "text_hash").agg(F.count("*").alias("n"))
    repeated = staged(same.where("n > 1").join(gone, ["key", "text_hash"], "left_anti").select("key", "text_hash"), "repeated")
    if repeated.isEmpty():
        return left
    again = _small(repeated, max_broadcast)
    return _rows_with(left, again, key, text, "left_anti").unionByName(_rows_with(left, again, key, text, "left_semi").dropDuplicates([key, text]))
