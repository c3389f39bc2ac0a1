"""Text probability under a hierarchical Pitman-Yor model.

Two levels of restaurants. The context of a token is the whole word before it, or
the start of the text. Every context has a restaurant; all of them share one
parent, which stands on a uniform base over the V known words and one class for
all others. A customer of a context who opens a table sends one to the parent.

    p(w | u) = (c - d t) / (q + C) + (q + d T) / (q + C) p0(w)

c customers and t tables of w in restaurant u, C and T their sums over words,
d the discount and q the strength; p0 is the same formula at the parent. Seatings
are sampled by Gibbs sweeps: all customers of a dish leave and take their seats
again one after another, with the totals of the last sweep. After burn-in c - d t,
q + d T and p0 are averaged over the sweeps; the formula of averages sums to one.

Data that moves. Words go to buckets by their hash, and a context's totals to the
bucket of its word. A sweep runs for all words at once, each bucket in one task: it
sends the tables of each context in it to the context's bucket, which answers with
the sums. Counts of (word, context) pairs are combined per block of text before they
move. Whatever moves names a word once by its hash and then by its place among those
names, as compressed bytes (``packed``). The seatings are a written table, part of the
model: whole numbers, from which probabilities are made where they are asked for.
With l = q + d T a score is

    log p(w | u) = log(l / (q + C)) + log((c - d t) / l + p0(w))

whose first part depends on u alone. It is added where u is met as a word, and the
second where w is, so a block's tokens move once; a bucket gives back one sum per document.
Words with a large share of all tokens (found on a bounded sample, which only
decides where they go) are spread over all buckets by word and context; their root
figures and their totals as contexts are a short list on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import wordhash
from barloom.llm.staging import dropped, staged

#: Context of a text's first token.
START = np.uint64(0)
STRENGTH = 1.0
SWEEPS, BURN_IN = 3, 1
#: Texts of so many characters share a bucket, about; fewest buckets.
BUCKET_CHARS, LEAST_BUCKETS = 12_500_000, 96
#: Share of the tokens that makes a word hot, and documents that are looked at for that.
HOT_SHARE, HOT_SAMPLE = 1 / 400, 2000
#: Text of a block, and tokens of blocks that are sent to be scored together: they share their names.
BLOCK_BYTES, SENT_TOKENS = 2 << 20, 1_000_000
SEED = 20240131
END = np.uint64(0x9E3779B97F4A7C15)
#: Customers that are seated one by one; beyond, in steps of a sixteenth of those seated.
ONE_BY_ONE = 256


class Tokens(NamedTuple):
    word: np.ndarray
    row: np.ndarray
    context: np.ndarray


def tokens_of(words: wordhash.Words) -> Tokens:
    """All tokens of a block in order: the words of each row, then its end."""
    count = np.bincount(words.row, minlength=words.rows)
    ends = np.cumsum(count) + np.arange(words.rows)
    at = np.arange(len(words.row)) + words.row
    size = len(words.row) + words.rows
    word, row = np.full(size, END, dtype=np.uint64), np.zeros(size, dtype=np.int64)
    word[at], row[at], row[ends] = words.hash, words.row, np.arange(words.rows)
    context = np.full(size, START, dtype=np.uint64)
    context[1:] = word[:-1]
    context[ends[:-1] + 1] = START
    return Tokens(word, row, context)


def bucket_of(word: np.ndarray, context: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    value = wordhash.mixed(word ^ np.uint64(SEED))
    if len(hot):
        spread = np.isin(word, hot)
        value[spread] = wordhash.mixed(value[spread] + context[spread].astype(np.uint64))
    return (value % np.uint64(buckets)).astype(np.int32)


def owner_of(context: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that sums up a context's totals: the one of its word."""
    return (wordhash.mixed(context ^ np.uint64(SEED)) % np.uint64(buckets)).astype(np.int32)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    if len(new):
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values).cast(kind))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes. Numbers are whole and not negative, or floats; whole ones take the bytes that the largest needs.

    Bytes of one place lie together, since the high ones repeat.
    """
    arrays = tuple(a if a.dtype.kind == "f" else a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) for a in arrays)
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    head = [len(arrays), len(raw)]
    for a in arrays:
        head += [a.itemsize if a.dtype.kind == "u" else -a.itemsize, len(a)]
    return np.array(head, dtype=np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    number, size = np.frombuffer(data, np.int64, 2)
    head = np.frombuffer(data, np.int64, 2 * number, 16)
    raw, at = pa.decompress(data[16 + 16 * number :], int(size), codec="zstd", asbytes=True), 0
    out = []
    for width, length in head.reshape(-1, 2):
        planes = np.frombuffer(raw, np.uint8, abs(width) * length, at).reshape(abs(width), length)
        out.append(np.ascontiguousarray(planes.T).view(f"{'u' if width > 0 else 'f'}{abs(width)}").ravel())
        at += abs(width) * length
    return out


def _steps(rising: np.ndarray) -> np.ndarray:
    """Numbers that never fall, as differences; ``np.cumsum`` undoes it."""
    return np.diff(rising, prepend=rising[:1] * 0)


class Pairs(NamedTuple):
    """Words and contexts as places in ``names``, which are sorted and distinct; by word and context."""

    names: np.ndarray
    word: np.ndarray
    context: np.ndarray
    count: np.ndarray


def _named(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of a block, and each token's word and context as places in them."""
    names, at = np.unique(np.append(START, t.word), return_inverse=True)
    context = at[:-1].copy()
    context[t.context == START] = at[0]
    return names, at[1:], context


def _from_keys(names: np.ndarray, key: np.ndarray, count: np.ndarray) -> Pairs:
    size = max(1, len(names))
    return Pairs(names, (key // size).astype(np.int32), (key % size).astype(np.int32), count)


def _added(parts: Sequence[Pairs]) -> Pairs:
    """Pairs of all parts, counts added up."""
    if len(parts) == 1:
        return parts[0]
    names, place = np.unique(np.concatenate([p.names for p in parts]), return_inverse=True)
    first = np.cumsum([0, *(len(p.names) for p in parts)])
    key = np.concatenate([place[at + p.word].astype(np.int64) * len(names) + place[at + p.context] for at, p in zip(first, parts)])
    order = np.argsort(key)
    key, count = key[order], np.concatenate([p.count for p in parts])[order].astype(np.int64)
    at = _runs(key)
    return _from_keys(names, key[at], np.add.reduceat(count, at) if len(at) else count)


def _buckets_of(names: np.ndarray, word: np.ndarray, context: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """``bucket_of`` of words and contexts that are places in ``names``."""
    out = bucket_of(names, names, hot[:0], buckets)[word]
    spread = np.isin(names, hot)[word]
    out[spread] = bucket_of(names[word[spread]], names[context[spread]], hot, buckets)
    return out


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its rows, in order."""
    order = np.argsort(bucket.astype(np.min_scalar_type(int(bucket.max()))) if len(bucket) else bucket, kind="stable")
    at = _runs(bucket[order])
    for first, last in zip(at, np.append(at, len(order))[1:]):
        yield int(bucket[order[first]]), order[first:last]


COUNTS = "bucket int, pairs binary"


def _pairs_row(bucket: int, p: Pairs) -> tuple[int, bytes]:
    """The names that these pairs have, in few bytes."""
    used, place = np.unique(np.concatenate([p.word, p.context]), return_inverse=True)
    return bucket, packed(_steps(p.names[used]), _steps(place[: len(p.word)]), place[len(p.word) :], p.count)


def _held_pairs(data: bytes) -> Pairs:
    names, word, context, count = unpacked(data)
    return Pairs(np.cumsum(names, dtype=np.uint64), np.cumsum(word, dtype=np.int32), context.astype(np.int32), count.astype(np.int64))


def _rows(schema: str, rows: Sequence[tuple]) -> pa.RecordBatch:
    """Rows of a number and bytes."""
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, _names(schema))


def pair_counts(train: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """One row per bucket: its pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Pairs] = []

        def given() -> pa.RecordBatch:
            p = _added(held)
            bucket = _buckets_of(p.names, p.word, p.context, hot, buckets)
            return _rows(COUNTS, [_pairs_row(b, Pairs(p.names, p.word[own], p.context[own], p.count[own])) for b, own in _by_bucket(bucket)])

        for batch in batches:
            for words in wordhash.blocks(batch.column(0), BLOCK_BYTES):
                names, word, context = _named(tokens_of(words))
                held.append(_from_keys(names, *np.unique(word * len(names) + context, return_counts=True)))
                if sum(len(p.word) for p in held) > 1_500_000:
                    yield given()
                    held = []
        if held:
            yield given()

    def merge(rows: pa.Table) -> pa.Table:
        pairs = _added([_held_pairs(data) for data in rows.column("pairs").to_pylist()])
        return pa.Table.from_batches([_rows(COUNTS, [_pairs_row(rows.column("bucket")[0].as_py(), pairs)])])

    return train.mapInArrow(count, COUNTS).groupBy("bucket").applyInArrow(merge, COUNTS)


def seated(customers: np.ndarray, new_table: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after all customers of each dish sat down again.

    ``new_table``: (strength + discount * all tables) * probability of the dish at
    the parent. With n seated at t tables the next one opens a table with
    probability new_table / (new_table + n - discount * t).
    """
    order = np.argsort(-customers, kind="stable")
    left, a, t = -customers[order], new_table[order], np.ones(len(order))
    n = 1
    while True:
        active = int(np.searchsorted(left, -n, "left"))
        if not active:
            break
        p = a[:active] / (a[:active] + n - discount * t[:active])
        if n < ONE_BY_ONE:
            t[:active] += rng.random(active) < p
            n += 1
        else:
            step = n // 16
            t[:active] += rng.binomial(np.minimum(step, -left[:active] - n), p)
            n += step
    out = np.empty(len(order))
    out[order] = t
    return out


class Totals(NamedTuple):
    """After a sweep: all tables of the contexts and at the root, of hot words both, and of the contexts in the short list."""

    tables: float
    root_tables: float
    hot_tables: np.ndarray
    hot_root: np.ndarray
    short: np.ndarray


class Fixed(NamedTuple):
    """What the counts settle. The short list of contexts is the start and the hot words."""

    hot: np.ndarray
    hot_counts: np.ndarray
    texts: int
    tokens: int
    words: int
    discount: float
    root_discount: float


def root_probability(tables: np.ndarray, root_tables: np.ndarray, fixed: Fixed, totals: Totals) -> np.ndarray:
    """p0 of words with so many tables in the contexts and at the root."""
    rest = (STRENGTH + fixed.root_discount * totals.root_tables) / (STRENGTH + totals.tables) / (fixed.words + 1)
    return np.maximum(tables - fixed.root_discount * root_tables, 0) / (STRENGTH + totals.tables) + rest


class Bucket:
    """The pairs of a bucket with their seating. Word arrays are per distinct word; hot words keep no root here."""

    def __init__(self, number: int, pairs: Pairs, fixed: Fixed, buckets: int):
        self.number, self.pairs, self.count, self.fixed = number, pairs, pairs.count, fixed
        self.heads = _runs(pairs.word)
        self.sizes = np.diff(np.append(self.heads, len(pairs.word)))
        self.words = pairs.names[pairs.word[self.heads]]
        self.of_word = np.repeat(np.arange(len(self.heads)), self.sizes)
        place = np.searchsorted(fixed.hot, self.words)
        place = np.minimum(place, max(len(fixed.hot) - 1, 0))
        self.is_hot = (fixed.hot[place] == self.words) if len(fixed.hot) else np.zeros(len(self.words), dtype=bool)
        self.hot_place = place
        # Totals as contexts are asked for all names, by owner.
        owners = owner_of(pairs.names, buckets)
        order = np.argsort(owners, kind="stable")
        self.asked, self.owners = pairs.names[order], owners[order]
        #: Where each name is among those asked for.
        self.of_name = np.empty(len(order), dtype=np.int64)
        self.of_name[order] = np.arange(len(order))
        self.of_context = self.of_name[pairs.context]
        self.tables = np.ones(len(pairs.word))
        self.root_tables = np.ones(len(self.words))

    def word_tables(self) -> np.ndarray:
        return np.bincount(self.of_word, weights=self.tables, minlength=len(self.words))

    def p0(self, totals: Totals) -> np.ndarray:
        p = root_probability(self.word_tables(), self.root_tables, self.fixed, totals)
        if len(self.fixed.hot):
            of_hot = root_probability(totals.hot_tables, totals.hot_root, self.fixed, totals)
            p[self.is_hot] = of_hot[self.hot_place[self.is_hot]]
        return p

    def sweep(self, number: int, totals: Totals, of_contexts: np.ndarray) -> None:
        """``of_contexts``: tables of the contexts asked for, after the last sweep."""
        rng = np.random.default_rng([SEED, self.number, number])
        d = self.fixed.discount
        self.tables = seated(self.count, (STRENGTH + d * of_contexts[self.of_context]) * self.p0(totals)[self.of_word], d, rng)
        self.root_tables = _root_seated(self.word_tables(), self.fixed, totals, rng)


def _root_seated(tables: np.ndarray, fixed: Fixed, totals: Totals, rng: np.random.Generator) -> np.ndarray:
    new = (STRENGTH + fixed.root_discount * totals.root_tables) / (fixed.words + 1)
    return seated(tables.astype(np.int64), np.full(len(tables), new), fixed.root_discount, rng)


TOLD = "bucket int, sweep int, owner int, tables array<float>"
ASKED = "owner int, bucket int, contexts array<long>, tables array<float>, kind string, place int, value double"
ANSWER = f"{TOLD}, kind string, place int, value double"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _bucket(rows: pa.Table, told: pa.Table, fixed: Fixed, buckets: int) -> tuple[Bucket, np.ndarray]:
    """A bucket from its row, and the tables of its contexts in each sweep that was told."""
    b = Bucket(rows.column("bucket")[0].as_py(), _held_pairs(rows.column("pairs")[0].as_py()), fixed, buckets)
    told = told.sort_by([("sweep", "ascending"), ("owner", "ascending")]).combine_chunks()
    return b, told.column("tables").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, len(b.asked))


def asked_totals(counts: DataFrame, told: DataFrame, fixed: Fixed, history: list[Totals], buckets: int) -> DataFrame:
    """After ``len(history)`` sweeps: every bucket's answers for its contexts, and figures by kind and place, whose number is fixed."""

    def ask(rows: pa.Table, of_sweeps: pa.Table) -> pa.Table:
        names = _names(ASKED)
        if not len(rows):
            return pa.table([pa.nulls(0, t) for t in (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.string(), pa.int32(), pa.float64())], names)
        b, of_contexts = _bucket(rows, of_sweeps, fixed, buckets)
        for number, totals in enumerate(history):
            b.sweep(number, totals, of_contexts[number])
        cold, tables = ~b.is_hot, b.word_tables()
        parts = {
            "hot_tables": np.bincount(b.hot_place[b.is_hot], weights=tables[b.is_hot], minlength=len(fixed.hot)),
            "hot_counts": np.bincount(b.hot_place[b.is_hot], weights=np.add.reduceat(b.count, b.heads)[b.is_hot], minlength=len(fixed.hot)),
            # Root tables and words; pairs seen once and twice; words of one and two contexts; tables, texts and tokens.
            "other": np.array(
                [b.root_tables[cold].sum(), cold.sum(), (b.count == 1).sum(), (b.count == 2).sum(), (tables[cold] == 1).sum(), (tables[cold] == 2).sum()]
                + [b.tables.sum(), b.count[b.pairs.names[b.pairs.context] == START].sum(), b.count.sum()],
                dtype=float,
            ),
        }
        at = _runs(b.owners)
        ends = np.append(at, len(b.owners))
        sums = np.bincount(b.of_context, weights=b.tables, minlength=len(b.asked))
        n = len(at)
        out = [
            pa.table(
                [
                    pa.array(b.owners[at]),
                    pa.array(np.full(n, b.number, dtype=np.int32)),
                    _lists(b.asked.view(np.int64), ends, pa.int64()),
                    _lists(sums, ends, pa.float32()),
                    *(pa.nulls(n, t) for t in (pa.string(), pa.int32(), pa.float64())),
                ],
                names,
            )
        ]
        for kind, values in parts.items():
            values = values.astype(float)  # of nothing at all bincount makes whole numbers
            place = np.flatnonzero(values)
            n = len(place)
            own = pa.array(np.full(n, b.number, dtype=np.int32))
            none = (pa.nulls(n, pa.list_(t)) for t in (pa.int64(), pa.float32()))
            out.append(pa.table([own, own, *none, pa.array([kind] * n, pa.string()), pa.array(place.astype(np.int32)), pa.array(values[place])], names))
        return pa.concat_tables(out)

    def answer(rows: pa.Table) -> pa.Table:
        names, sweep = _names(ANSWER), len(history)
        asks = rows.filter(pa.compute.is_valid(rows.column("contexts"))).combine_chunks()
        told_figures = rows.filter(pa.compute.is_valid(rows.column("kind"))).combine_chunks()

        def figures(kind, place, value) -> pa.Table:
            n = len(place)
            nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32()))]
            return pa.table([*nothing, kind, place, value], names)

        out = [figures(*(told_figures.column(c) for c in ("kind", "place", "value")))]
        if len(asks):
            contexts, tables = (asks.column(c).combine_chunks() for c in ("contexts", "tables"))
            each, of = np.unique(contexts.flatten().to_numpy().view(np.uint64), return_inverse=True)
            sums = np.bincount(of, weights=tables.flatten().to_numpy())
            ends = np.append(0, np.cumsum(contexts.value_lengths().to_numpy()))
            n = len(asks)
            out.append(
                pa.table(
                    [
                        asks.column("bucket"),
                        pa.array(np.full(n, sweep, dtype=np.int32)),
                        asks.column("owner"),
                        _lists(sums[of], ends, pa.float32()),
                        *(pa.nulls(n, t) for t in (pa.string(), pa.int32(), pa.float64())),
                    ],
                    names,
                )
            )
            place, in_list = _short_places(each, fixed)
            n = int(in_list.sum())
            out.append(figures(pa.array(["short"] * n, pa.string()), pa.array(place[in_list].astype(np.int32)), pa.array(sums[in_list])))
        return pa.concat_tables(out)

    asks = counts.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(ask, ASKED)
    return asks.groupBy("owner").applyInArrow(answer, ANSWER)


def _short_places(contexts: np.ndarray, fixed: Fixed) -> tuple[np.ndarray, np.ndarray]:
    """Places of contexts in the short list, and whether they are in it."""
    spot, is_hot = _places(fixed.hot, contexts)
    return np.where(contexts == START, 0, spot + 1), is_hot | (contexts == START)


def _dense(figures: dict[int, float] | None, size: int) -> np.ndarray:
    out = np.zeros(size)
    for place, value in (figures or {}).items():
        out[place] = value
    return out


class Model(NamedTuple):
    """``seats``: a written table with the averaged seatings of every pair, one row per bucket."""

    fixed: Fixed
    history: list[Totals]
    buckets: int
    seats: DataFrame


SEATS = "bucket int, seats binary"


class Seats(NamedTuple):
    """Of a bucket, by word and context. Tables are sums over the samples.

    Per name: its tables as a context, in all buckets. Per word (a place in ``names``): its contexts and customers here
    and its probability at the root. Per pair: its context (a place), customers and tables.
    """

    names: np.ndarray
    as_context: np.ndarray
    words: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray
    p0: np.ndarray
    context: np.ndarray
    count: np.ndarray
    tables: np.ndarray


def samples_of(history: list[Totals]) -> list[int]:
    """The sweeps that are averaged."""
    return [k for k in range(len(history)) if k > min(BURN_IN, len(history) - 2)]


def seatings(counts: DataFrame, told: DataFrame, fixed: Fixed, history: list[Totals], buckets: int) -> DataFrame:
    """The seatings of all pairs, as the sweeps left them: each bucket takes its sweeps again, from the same seeds."""
    samples = samples_of(history)

    def seat(rows: pa.Table, of_sweeps: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.Table.from_batches([_rows(SEATS, [])])
        b, of_contexts = _bucket(rows, of_sweeps, fixed, buckets)
        tables, p0 = np.zeros(len(b.count)), np.zeros(len(b.words))
        for number, totals in enumerate(history):
            if number in samples:
                tables += b.tables
                p0 += b.p0(totals) / len(samples)
            if number < len(history) - 1:
                b.sweep(number, totals, of_contexts[number])
        as_context = of_contexts[samples].sum(axis=0)[b.of_name].astype(np.int64)
        customers = np.add.reduceat(b.count, b.heads)
        held = Seats(b.pairs.names, as_context, b.pairs.word[b.heads], b.sizes, customers, p0, b.pairs.context, b.count, tables.astype(np.int64))
        return pa.Table.from_batches([_rows(SEATS, [_seats_row(b.number, held)])])

    return counts.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(seat, SEATS)


def _seats_row(bucket: int, held: Seats) -> tuple[int, bytes]:
    return bucket, packed(*held._replace(names=_steps(held.names), words=_steps(held.words)))


def finer(seats: DataFrame, fixed: Fixed, buckets: int) -> DataFrame:
    """``seats`` in more buckets, a multiple of those that they are in."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = _held_seats(batch.slice(k, 1))
                at = np.repeat(np.arange(len(held.words)), held.sizes)
                bucket = _buckets_of(held.names, held.words[at], held.context, fixed.hot, buckets)
                for b, own in _by_bucket(bucket):
                    heads = _runs(at[own])
                    of, sizes = at[own][heads], np.diff(np.append(heads, len(own)))
                    used, place = np.unique(np.concatenate([held.words[of], held.context[own]]), return_inverse=True)
                    words, context = place[: len(of)], place[len(of) :]
                    part = Seats(
                        held.names[used], held.as_context[used], words, sizes, held.counts[of], held.p0[of], context, held.count[own], held.tables[own]
                    )
                    yield _rows(SEATS, [_seats_row(b, part)])

    return seats.mapInArrow(split, SEATS)


def _held_seats(rows: pa.RecordBatch | pa.Table) -> Seats:
    """The seats of one bucket's row; of no row, no seats."""
    if rows.num_rows == 0:
        kinds = (np.uint64, *[np.int64] * 4, float, *[np.int64] * 3)
        return Seats(*(np.zeros(0, kind) for kind in kinds))
    held = Seats(*unpacked(rows.column("seats")[0].as_py()))
    return held._replace(names=np.cumsum(held.names, dtype=np.uint64), words=np.cumsum(held.words, dtype=np.int64))


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice) if once else 0.5, 0.05, 0.95))


def hot_words(docs: DataFrame, text: str = "text", share: float = HOT_SHARE, sample: int = HOT_SAMPLE) -> np.ndarray:
    """Words with a large share of the tokens of some documents; at most ``1 / share`` of them. Only their place depends on it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in wordhash.blocks(batch.column(0)):
                word, n = np.unique(tokens_of(words).word, return_counts=True)
                often = n > max(1, share * n.sum() / 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[often].view(np.int64)), pa.array(n[often]), pa.array(np.full(often.sum(), n.sum()))], ["word", "n", "all"]
                )

    rows = docs.select(text).limit(sample).mapInArrow(count, "word long, n long, all long").collect()
    total = sum({(r["all"]): r["all"] for r in rows}.values()) or 1
    sums: dict[int, int] = {}
    for r in rows:
        sums[r["word"]] = sums.get(r["word"], 0) + r["n"]
    return np.sort(np.array([w for w, n in sums.items() if n >= share * total], dtype=np.int64).view(np.uint64))


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each job's shuffle files go when it ends: training writes its tables one after another, and none is planned twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def train(docs: DataFrame, learns: Column, text: str = "text", sweeps: int = SWEEPS) -> Model:
    """Counts of all rows where ``learns`` holds, then the sweeps. Null texts are empty texts."""
    spark = docs.sparkSession
    with _shuffles_freed(spark):
        return _trained(spark, docs.where(learns).select(text), text, sweeps)


def _trained(spark: SparkSession, learning: DataFrame, text: str, sweeps: int) -> Model:
    hot = hot_words(learning, text)
    chars = learning.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))
    counts = staged(pair_counts(learning, hot, buckets), "pair-counts")
    told = spark.createDataFrame([], TOLD)
    nothing = np.zeros(len(hot))
    fixed = Fixed(hot, nothing, 0, 0, 0, 0.5, 0.5)
    history: list[Totals] = []
    written = []
    for number in range(sweeps + 1):
        answers = staged(asked_totals(counts, told, fixed, history, buckets), "totals")
        written.append(answers)
        told = told.unionByName(answers.where("kind is null").select(*_names(TOLD)))
        figures: dict[str, dict[int, float]] = {}
        for kind, place, value in answers.where("kind is not null").groupBy("kind", "place").agg(F.sum("value")).collect():
            figures.setdefault(kind, {})[place] = value
        hot_tables, other = _dense(figures.get("hot_tables"), len(hot)), _dense(figures.get("other"), 9)
        if number == 0:
            hot_counts = _dense(figures.get("hot_counts"), len(hot))
            words = int(other[1] + (hot_counts > 0).sum())
            fixed = Fixed(hot, hot_counts, int(other[7]), int(other[8]), words, _discount(other[2], other[3]), _discount(other[4], other[5]))
            hot_root, root = np.minimum(hot_tables, 1.0), float(words)
        else:
            rng = np.random.default_rng([SEED, number - 1])
            hot_root = np.where(hot_tables > 0, _root_seated(hot_tables, fixed, history[-1], rng), 0.0)
            root = float(other[0] + hot_root.sum())
        history.append(Totals(float(other[6]), root, hot_tables, hot_root, _dense(figures.get("short"), len(hot) + 1)))
    seats = staged(seatings(counts, told, fixed, history, buckets), "seats")
    for table in (counts, *written):
        dropped(table)
    return Model(fixed, history, buckets, seats)


SENT = "bucket int, block long, body binary, ids array<long>, learns array<boolean>, tokens array<int>"
BACK = "block long, body binary, ids array<long>, learns array<boolean>, tokens array<int>"
RESULT = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, model: Model, learns: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, learned, n_tokens, n_known, base_score, score`` of every row of any table.

    The model has all that it learned in a table of its own, so a text's scores do
    not depend on what else is in ``docs``; ``learns`` only fills ``learned``. A table
    larger than the one learned from takes more buckets.

    Null and empty texts are their end alone. Null keys and repeated rows give rows
    like others. An empty table gives none; a model that saw nothing gives every
    token the one class for unknown words.
    """
    fixed, history, buckets, seats = model
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    times = max(1, -(-chars // (BUCKET_CHARS * buckets)))
    if times > 1:
        buckets *= times
        seats = finer(seats, fixed, buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        for batch in batches:
            for words in wordhash.blocks(batch.column("_text"), BLOCK_BYTES):
                t = tokens_of(words)
                names, word, context = _named(t)
                part = batch.slice(words.first_row, words.rows)
                learns = pa.array(part.column("_learns").to_numpy(zero_copy_only=False))
                tokens = np.bincount(t.row, minlength=words.rows).astype(np.int32)
                held.append((names, word.astype(np.int32), context.astype(np.int32), tokens, pa.concat_arrays([part.column("_key")]), learns))
                if sum(len(h[1]) for h in held) > SENT_TOKENS:
                    yield message(number, held)
                    number, held = number + 1, []
        if held:
            yield message(number, held)

    def message(number: int, held: list[tuple]) -> pa.RecordBatch:
        every, words, contexts, of_blocks, ids, learns = zip(*held)
        names, word, context = _numbered(every, words, contexts)
        tokens = np.concatenate(of_blocks)
        row = np.repeat(np.arange(len(tokens)), tokens)
        sent = []
        for bucket, own in _by_bucket(_buckets_of(names, word, context, fixed.hot, buckets)):
            own_words, of_word = np.unique(word[own], return_inverse=True)
            own_contexts, of_context = np.unique(context[own], return_inverse=True)
            sent.append((bucket, packed(_steps(names[own_words]), _steps(names[own_contexts]), of_word, of_context, _steps(row[own]))))
        # What the documents are goes along, to any bucket, and on from there.
        n = len(sent)
        sent.append((number % buckets, None))
        ends = pa.array(np.append(np.zeros(n + 1), len(tokens)).astype(np.int32))
        without = pa.array(np.append(np.ones(n, dtype=bool), False))
        lists = [pa.ListArray.from_arrays(ends, v, mask=without) for v in (pa.concat_arrays(ids), pa.concat_arrays(learns), pa.array(tokens))]
        bucket, body = _rows("bucket, body", sent).columns
        return pa.RecordBatch.from_arrays([bucket, pa.array(np.full(n + 1, number)), body, *lists], _names(SENT))

    def score(rows: pa.Table, model_rows: pa.Table) -> pa.Table:
        told = rows.filter(pa.compute.is_valid(rows.column("ids"))).combine_chunks()
        sent = rows.filter(pa.compute.is_valid(rows.column("body"))).combine_chunks()
        names = _names(BACK)
        out = [pa.table([told.column("block"), pa.nulls(len(told), pa.binary()), *(told.column(c) for c in names[2:])], names)]
        if len(sent):
            held = _held_seats(model_rows)
            parts = [unpacked(data) for data in sent.column("body").to_pylist()]
            word, of_word = _numbered([np.cumsum(p[0], dtype=np.uint64) for p in parts], [p[2] for p in parts])
            context, of_context = _numbered([np.cumsum(p[1], dtype=np.uint64) for p in parts], [p[3] for p in parts])
            key, of_pair = np.unique(of_word * len(context) + of_context, return_inverse=True)
            del of_word, of_context
            pairs = word[key // len(context)], context[key % len(context)]
            logs, base, known = _pair_scores(*pairs, held, fixed, history)
            logs = logs + _as_context(pairs[0], held, fixed, history)
            back, first = [], 0
            for *_, steps in parts:
                row, of = np.cumsum(steps, dtype=np.int64), of_pair[first : first + len(steps)]
                at = _runs(row)
                sums = (np.add.reduceat(v[of], at) for v in (logs, base, known.astype(np.int64)))
                back.append(packed(_steps(row[at]), *sums))
                first += len(steps)
            out.append(pa.table([sent.column("block"), pa.array(back, pa.binary()), *(pa.nulls(len(sent), told.column(c).type) for c in names[2:])], names))
        return pa.concat_tables(out)

    def finish(rows: pa.Table) -> pa.Table:
        told = rows.filter(pa.compute.is_valid(rows.column("ids"))).combine_chunks()
        back = rows.filter(pa.compute.is_valid(rows.column("body"))).column("body").to_pylist()
        ids = told.column("ids").combine_chunks().flatten()
        parts = [(np.cumsum(steps, dtype=np.int64), *sums) for steps, *sums in map(unpacked, back)]
        row, logs, base, known = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((logs, base, row))  # sums in one order, whatever came first
        row, logs, base, known = row[order], logs[order], base[order], known[order]
        add = lambda values: np.bincount(row, weights=values, minlength=len(ids))
        return pa.table(
            [
                ids,
                told.column("learns").combine_chunks().flatten(),
                told.column("tokens").combine_chunks().flatten().cast(pa.int64()),
                pa.array(add(known).astype(np.int64)),
                pa.array(add(base)),
                pa.array(add(logs)),
            ],
            _names(RESULT),
        )

    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), learns.alias("_learns"))
    back = rows.mapInArrow(send, SENT).groupBy("bucket").cogroup(seats.groupBy("bucket")).applyInArrow(score, BACK)
    return back.groupBy("block").applyInArrow(finish, RESULT)


def _places(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stand among distinct sorted values, and whether they do."""
    place = np.minimum(np.searchsorted(sorted_values, wanted), max(len(sorted_values) - 1, 0))
    return place, (sorted_values[place] == wanted) if len(sorted_values) else np.zeros(len(wanted), dtype=bool)


def _numbered(names: Sequence[np.ndarray], *places: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Distinct names of all parts, and the places of all parts as places in them."""
    every, at = np.unique(np.concatenate(names), return_inverse=True)
    ends = np.cumsum([len(n) for n in names])
    return [every, *(np.concatenate([at[last - len(n) : last][p] for last, n, p in zip(ends, names, of)]) for of in places)]


def _below(tables: np.ndarray, fixed: Fixed, history: list[Totals]) -> np.ndarray:
    """q + d T of contexts whose tables are sums over the samples."""
    return STRENGTH + fixed.discount * tables / len(samples_of(history))


def _as_context(word: np.ndarray, held: Seats, fixed: Fixed, history: list[Totals]) -> np.ndarray:
    """What a word gives to the score of the token after it; unknown words and the end give nothing, hot ones do so at that token."""
    place, known = _places(held.names[held.words], word)
    known &= (word != END) & ~_places(fixed.hot, word)[1]
    place, out = place[known], np.zeros(len(word))
    out[known] = np.log10(_below(held.as_context[held.words[place]], fixed, history) / (STRENGTH + held.counts[place]))
    return out


def _pair_scores(word: np.ndarray, context: np.ndarray, held: Seats, fixed: Fixed, history: list[Totals]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs by word and context: log10 of the averaged probability, of the base and whether the word is known.

    The first lacks what the context itself gives, unless that is in the short list.
    """
    context = context.astype(np.uint64)
    heads = _runs(word)
    of_word = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(word))))
    all_words = word[heads]
    place, is_known = _places(held.names[held.words], all_words)
    counts = np.zeros(len(all_words), dtype=np.int64)
    counts[is_known] = held.counts[place[is_known]]
    spot, is_hot = _places(fixed.hot, all_words)
    counts[is_hot] = fixed.hot_counts[spot[is_hot]]
    # Pairs of the model, in the order of word and context.
    pairs = np.repeat(np.arange(len(held.words), dtype=np.int64), held.sizes) * len(held.names) + held.context
    spot_of, is_there = _places(held.names, context)
    at, learned = _places(pairs, place[of_word].astype(np.int64) * len(held.names) + spot_of)
    learned &= is_known[of_word] & is_there
    p0 = np.zeros(len(all_words))
    samples = [history[k] for k in samples_of(history)]
    for totals in samples:
        of_hot = root_probability(totals.hot_tables, totals.hot_root, fixed, totals)
        p0[~is_known] += root_probability(np.zeros(1), np.zeros(1), fixed, totals)[0] / len(samples)
        p0[is_hot] += of_hot[spot[is_hot]] / len(samples)
    seated_here = is_known & ~is_hot
    p0[seated_here] = held.p0[place[seated_here]]
    unseated = is_hot & ~is_known
    p0[unseated] -= sum(root_probability(np.zeros(1), np.zeros(1), fixed, totals)[0] for totals in samples) / len(samples)
    total = p0[of_word]
    at = at[learned]
    own = held.count[at] - fixed.discount * held.tables[at] / len(samples)
    total[learned] += own / _below(held.as_context[held.context[at]], fixed, history)
    logs = np.log10(total)
    below = STRENGTH + fixed.discount * np.mean([totals.short for totals in samples], axis=0)
    after = np.log10(below / (STRENGTH + np.append(fixed.texts, fixed.hot_counts)))
    place_in_list, in_list = _short_places(context, fixed)
    logs[in_list] += after[place_in_list[in_list]]
    base = np.log10((counts + 0.5) / (fixed.tokens + 0.5 * (fixed.words + 1)))
    return logs, base[of_word], (counts > 0)[of_word]
