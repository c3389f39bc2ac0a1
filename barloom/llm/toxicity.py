"""Toxicity of texts behind leetspeak, spacing and repetition.

The channel: a writer turns letters into look-alikes, repeats them or puts
separators between them. A unit (a word with any repeated letter, inner separator
or look-alike, or a run of single letters) becomes a lattice: per character its readings with a cost, and being
dropped as a repetition or separator. A Viterbi search over pairs of letters
finds the reading that is likeliest under a character trigram model of the
corpus. Other words have one path, themselves.

Units with strong signs count as they read. A doubled letter, one separator or a
look-alike among hardly any letters is common in plain words too ('tool', 'so-so',
'1st'), so these units count both as written and as they read, and are shown and
counted as restored only where the reading has a weighted feature that the written
word lacks. Equal ones of a block are searched once.

The restored words and their beginnings are features of a logistic regression:
those that toxic texts hold more often than chance allows, with weights that are
not negative, so a long clean text does not add up to a toxic one.

The trigram counts are over all training texts. The labelled sample is bounded by
``MAX_LABELLED``. Work is per text; nothing is grouped by source or text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from barloom.llm import wordhash
from barloom.llm.staging import staged

#: Fixed look-alikes: what a character may stand for.
LOOKS_LIKE = {
    "@": "a", "4": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "!": "il", "1": "il", "|": "il", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z",
}
SEPARATORS = ".-_*' ~"
#: Log costs of a look-alike, a dropped repetition and a dropped separator.
LOOK, REPEAT, DROP = -1.0, -0.5, -0.7
#: Bound of the labelled sample of the fit.
MAX_LABELLED = 20_000
MAX_FEATURES = 4096
SLOT_BITS = 22
#: A feature must be this much beyond chance, and so many times as frequent in toxic texts.
LEAST_Z, LEAST_RATIO = 5.0, 5.0
BEGINNINGS = (4, 5)
#: Texts are handled in blocks of about so many bytes, whose arrays stay small.
BLOCK_BYTES = 1 << 18

_SYMBOLS = 29
_SYMBOL = np.full(256, 28, dtype=np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 0
_LETTER = (_SYMBOL >= 1) & (_SYMBOL <= 27)


def _marks(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters.encode())] = True
    return table


_LOOKS = _marks("".join(LOOKS_LIKE))
_BETWEEN = _marks(SEPARATORS)
_DIGIT = _marks("0123456789")
_EDGE = _marks(".,;:!?\"')]}>([{<&%#*`~|")


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all symbol triples of the texts; at most ``29 ** 3`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(_SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for words in wordhash.blocks(batch.column(0), BLOCK_BYTES):
                s = _SYMBOL[words.data]
                if len(s) > 2:
                    held += np.bincount((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:], minlength=len(held))
        code = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(held[code])], ["code", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "code long, n long")
    counts = np.zeros(_SYMBOLS**3)
    for code, n in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[code] = n
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after two others, smoothed by the shorter contexts."""
    three = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + _SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    return np.log((three + 20 * p2) / (three.sum(2, keepdims=True) + 20))


class Decoder:
    """Viterbi search in the lattice of a unit."""

    def __init__(self, log_probability: np.ndarray):
        self.log_p = log_probability.tolist()
        self.held = lru_cache(maxsize=100_000)(self._read)

    def read(self, unit: str) -> str:
        """The likeliest reading of a lower-cased unit. Readings of long units are not kept."""
        return self.held(unit) if len(unit) <= 64 else self._read(unit)

    def _read(self, unit: str) -> str:
        # The text of a state is a chain of (chain before, character), so long units take linear time.
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        before = ""
        for c in unit:
            code = ord(c)
            own = int(_SYMBOL[code]) if code < 256 else 27
            if c in SEPARATORS:
                paths = [(0, c, 0.0), (-1, "", DROP)]
            else:
                paths = [(own, c, 0.0)]
                paths += [(ord(x) - 96, x, LOOK) for x in LOOKS_LIKE.get(c, "")]
                if c == before:
                    paths.append((-1, "", REPEAT))
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, text) in states.items():
                row = self.log_p[a][b]
                for symbol, shown, cost in paths:
                    if symbol < 0:
                        key, value = (a, b), score + cost
                    else:
                        key, value = (b, symbol), score + cost + row[symbol]
                    if key not in new or value > new[key][0]:
                        new[key] = (value, (text, shown) if shown else text)
            states, before = new, c

        def spelled(text: tuple) -> str:
            out = []
            while text:
                text, shown = text
                out.append(shown)
            return "".join(reversed(out))

        return max(((score + self.log_p[a][b][0], spelled(text)) for (a, b), (score, text) in states.items()))[1]


class Units(NamedTuple):
    """Trimmed words, and which are units: ``single`` of one word, ``runs`` (first, last) of words with one character each.

    ``weak`` are words whose signs plain words have too.
    """

    start: np.ndarray
    end: np.ndarray
    single: np.ndarray
    runs: np.ndarray
    weak: np.ndarray


def units(words: wordhash.Words) -> Units:
    data, start, end = words.data, words.start.copy(), words.end.copy()
    for edge, at, step in ((end, lambda i: end[i] - 1, -1), (start, lambda i: start[i], 1)):
        left = np.arange(len(start))
        while len(left):
            left = left[(end[left] > start[left]) & _EDGE[data[np.minimum(at(left), len(data) - 1)]]]
            edge[left] += step
    # A row of three dollar signs at the end is decoration, one or two may be letters.
    left = np.flatnonzero(end - start > 3)
    left = left[(data[end[left] - 1] == 36) & (data[end[left] - 2] == 36) & (data[end[left] - 3] == 36)]
    while len(left):
        end[left] -= 1
        left = left[(end[left] > start[left]) & (data[end[left] - 1] == 36)]

    def inside(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks)))
        return total[end] - total[start]

    letter = _LETTER[data]
    letters, looks = inside(letter), inside(_LOOKS[data])
    between, digits = inside(_BETWEEN[data]), inside(_DIGIT[data])
    triple = np.zeros(len(data), dtype=bool)
    triple[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & letter[2:]
    tripled = inside(triple) > 0
    again = np.zeros(len(data), dtype=bool)
    for width, least, most in ((1, 0, 0x7F), (2, 0xC0, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xFF)):
        second = np.flatnonzero((data[width:] == data[:-width]) & (data[width:] >= least) & (data[width:] <= most) & letter[width:]) + width
        for k in range(1, width):
            second = second[second + k < len(data)]
            second = second[data[second + k] == data[second + k - width]]
        again[second] = True
    size = end - start
    single = (letters >= 2) & (((looks > 0) & (digits <= 2 * letters)) | tripled | ((between >= 2) & (2 * between >= letters - 1)))
    # One character alone is no word with signs; in a row of them it belongs to a run.
    weak = ~single & (size >= 2) & ((looks > 0) | (between > 0) | (inside(again) > 0))
    lone = (size == 1) & (letter | _LOOKS[data])[np.minimum(start, max(len(data) - 1, 0))] if len(data) else size == 1
    joined = np.zeros(len(size), dtype=bool)
    joined[1:] = lone[1:] & lone[:-1] & (words.row[1:] == words.row[:-1])
    first = np.flatnonzero(lone & ~joined)
    last = np.flatnonzero(lone & ~np.concatenate((joined[1:], [False]))) if len(size) else first
    runs = np.column_stack((first, last))
    return Units(start, end, np.flatnonzero(single), runs[runs[:, 1] - runs[:, 0] >= 2], np.flatnonzero(weak))


def readings(words: wordhash.Words, found: Units, decoder: Decoder) -> list[tuple[int, int, str]]:
    """First word, last word and restored text of every unit that reads otherwise than it is written."""
    out = []
    spans = [(i, i) for i in found.single] + [(int(a), int(b)) for a, b in found.runs]
    for first, last in sorted(spans):
        if first == last:
            written = words.data[found.start[first] : found.end[first]].tobytes().decode("utf-8", "replace")
        else:
            written = " ".join(chr(words.data[found.start[k]]) for k in range(first, last + 1))
        read = decoder.read(written)
        if read != written:
            out.append((first, last, read))
    return out


class Also(NamedTuple):
    """Words that count as written and as they read: ``word``, which of ``read`` it is, and one word written like that for each."""

    word: np.ndarray
    which: np.ndarray
    read: list[str]
    example: np.ndarray


def other_readings(words: wordhash.Words, found: Units, decoder: Decoder) -> Also:
    """The weak units that read otherwise than written."""
    start, end = found.start[found.weak], found.end[found.weak]
    _, one, which = np.unique(words.hashes_of(start, end), return_index=True, return_inverse=True)
    written = [words.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[one], end[one])]
    read = [decoder.read(w) for w in written]
    new = np.array([r != w for r, w in zip(read, written)], dtype=bool)
    place = np.cumsum(new) - 1
    changed = new[which]
    return Also(found.weak[changed], place[which[changed]], [r for r, n in zip(read, new) if n], found.weak[one[new]])


def features(source: wordhash.Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and slot of every feature of the stretches: the whole and its beginnings."""
    index, value = [], []
    for kind, size in enumerate((1 << 30, *BEGINNINGS)):
        long_enough = np.flatnonzero(end - start > size) if kind else np.arange(len(start))
        s = start[long_enough]
        hashes = source.hashes_of(s, np.minimum(end[long_enough], s + size))
        index.append(long_enough)
        value.append((wordhash.mixed(hashes + np.uint64(kind)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64))
    return np.concatenate(index), np.concatenate(value)


def features_of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and slot of every feature of its words."""
    index, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for again in wordhash.blocks(pa.array(texts, pa.string())):
        at, slot = features(again, again.start, again.end)
        index.append(again.first_row + again.row[at])
        value.append(slot)
    return np.concatenate(index), np.concatenate(value)


def gained(words: wordhash.Words, found: Units, also: Also, place: np.ndarray) -> np.ndarray:
    """Which of ``also.read`` have a feature of the model (``place`` not negative) that the written word lacks."""
    index, value = features_of_texts(also.read)
    at, written = features(words, found.start[also.example], found.end[also.example])
    has = set(zip(at[place[written] >= 0].tolist(), written[place[written] >= 0].tolist()))
    out = np.zeros(len(also.read), dtype=bool)
    for k, slot in zip(index[place[value] >= 0].tolist(), value[place[value] >= 0].tolist()):
        out[k] |= (k, slot) not in has
    return out


def slots(words: wordhash.Words, decoder: Decoder, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and slot of every feature of the restored words, and the number of restored units per row.

    Weak units are counted as restored by the model's ``place`` of each slot, without it not at all.
    """
    found = units(words)
    changed = readings(words, found, decoder)
    keep = found.end > found.start
    for first, last, _ in changed:
        keep[first : last + 1] = False
    restored = np.zeros(words.rows, dtype=np.int64)
    kept = np.flatnonzero(keep)
    index, slot = features(words, found.start[kept], found.end[kept])
    row, value = [words.row[kept[index]]], [slot]
    if changed:
        rows = np.array([words.row[first] for first, _, _ in changed])
        np.add.at(restored, rows, 1)
        index, slot = features_of_texts([text for _, _, text in changed])
        row.append(rows[index])
        value.append(slot)
    also = other_readings(words, found, decoder)
    if also.read:
        index, slot = features_of_texts(also.read)
        order = np.argsort(index, kind="stable")
        count = np.bincount(index, minlength=len(also.read))
        begin = np.cumsum(count) - count
        pair = np.unique(words.row[also.word] * len(also.read) + also.which)
        of_row, which = pair // len(also.read), pair % len(also.read)
        sizes = count[which]
        row.append(np.repeat(of_row, sizes))
        value.append(slot[order][np.repeat(begin[which], sizes) + wordhash._counters(sizes)])
        if place is not None:
            meant = gained(words, found, also, place)[also.which]
            np.add.at(restored, words.row[also.word[meant]], 1)
    return np.concatenate(row), np.concatenate(value), restored


class Model(NamedTuple):
    log_probability: np.ndarray
    slots: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


def places(model: Model) -> np.ndarray:
    """Place of each slot among the model's features, -1 for none."""
    out = np.full(1 << SLOT_BITS, -1, dtype=np.int16)
    out[model.slots] = np.arange(len(model.slots), dtype=np.int16)
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Trigrams of ``docs``, and a fit on at most ``max_labelled`` rows of ``labels`` (those with the smallest hash of their key).

    Null keys and labels other than 0 and 1 are not labels. Of documents that repeat
    a labelled key the smallest text is learned from, once, so the fit's rows are
    bounded too. Without labels every score is one half or less.
    """
    log_p = language_model(trigram_counts(docs, text))
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    sample = known.select(F.col(key).alias("_key"), F.col(label).cast("long").alias("_label"))
    sample = sample.orderBy(F.xxhash64("_key"), "_key", "_label").limit(max_labelled)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key")
    texts = texts.groupBy("_key", "_label").agg(F.min("_text").alias("_text")).select("_label", "_text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(log_p)
        for batch in batches:
            for words in wordhash.blocks(batch.column("_text"), BLOCK_BYTES):
                row, slot, _ = slots(words, decoder)
                pair = np.unique(row * (1 << SLOT_BITS) + slot)
                begin = np.searchsorted(pair, np.arange(words.rows + 1) << SLOT_BITS).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(begin), pa.array((pair & ((1 << SLOT_BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("_label").slice(words.first_row, words.rows), held], ["label", "slots"])

    rows = staged(texts.mapInArrow(spread, "label long, slots array<int>"), "labelled")
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    toxic, clean = totals["toxic"], totals["n"] - totals["toxic"]
    if not toxic or not clean:
        return Model(log_p, np.zeros(0, np.int64), np.zeros(0), math.log((toxic + 1) / (clean + 2)) if toxic < clean else 0.0)
    counted = rows.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    counted = counted.where("t >= 3")
    share = F.col("n") / F.lit(float(toxic + clean))
    spread_of = F.sqrt(share * (1 - share) * F.lit(1 / toxic + 1 / clean) + F.lit(1e-12))
    z = (F.col("t") / F.lit(float(toxic)) - (F.col("n") - F.col("t")) / F.lit(float(clean))) / spread_of
    rate = F.col("t") / F.lit(float(toxic)) >= F.lit(LEAST_RATIO / clean) * (F.col("n") - F.col("t"))
    chosen = counted.withColumn("z", z).where((F.col("z") >= LEAST_Z) & rate).orderBy(F.desc("z"), "slot").limit(MAX_FEATURES).collect()
    kept = np.array(sorted(r["slot"] for r in chosen), dtype=np.int64)
    listed = F.expr(f"array({', '.join(map(str, kept))})") if len(kept) else F.array().cast("array<int>")
    held = rows.select("label", F.array_intersect("slots", listed).alias("slots")).toPandas()
    weights, bias = fit(held["label"].to_numpy(), held["slots"].tolist(), kept)
    return Model(log_p, kept, weights, bias)


def fit(labels: np.ndarray, held: list, kept: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights that are not negative, by gradient steps with a small ridge."""
    row = np.repeat(np.arange(len(held)), [len(x) for x in held])
    column = np.searchsorted(kept, np.concatenate([np.asarray(x, dtype=np.int64) for x in held])) if len(row) else np.zeros(0, np.int64)
    weights, bias = np.zeros(len(kept)), math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    squares, bias_square = np.full(len(kept), 1e-8), 1e-8
    for _ in range(steps):
        z = bias + np.bincount(row, weights=weights[column], minlength=len(labels))
        rest = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels
        g = np.bincount(column, weights=rest[row], minlength=len(kept)) + 0.1 * weights
        squares += g * g
        bias_square += rest.sum() ** 2
        weights = np.maximum(0.0, weights - 0.5 * g / np.sqrt(squares))
        bias -= 0.5 * rest.sum() / math.sqrt(bias_square)
    return weights, bias


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc`` (the whole row), ``score`` (0 to 1) and ``n_restored``, the units that read otherwise than written.

    A null text is empty; an empty one has the score of a text without any sign.
    """
    schema = StructType([StructField("doc", docs.schema), StructField("score", DoubleType()), StructField("n_restored", LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.log_probability)
        place = places(model)
        for batch in batches:
            for words in wordhash.blocks(batch.column("_text"), BLOCK_BYTES):
                row, slot, restored = slots(words, decoder, place)
                column = place[slot].astype(np.int64)
                hit = column >= 0
                pair = np.unique(row[hit] * len(model.slots) + column[hit])
                size = max(len(model.slots), 1)
                z = model.bias + np.bincount(pair // size, weights=model.weights[pair % size], minlength=words.rows)
                part = batch.slice(words.first_row, words.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60)))), pa.array(restored)], ["doc", "score", "n_restored"]
                )

    return docs.select(F.struct("*").alias("doc"), F.col(text).alias("_text")).mapInArrow(score, schema)


def restored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc`` (the whole row) and ``restored``: the text, A-Z lower-cased, with every unit as it reads."""
    schema = StructType.fromDDL("restored string")
    schema = StructType([StructField("doc", docs.schema), *schema.fields])

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, place = Decoder(model.log_probability), places(model)
        for batch in batches:
            for words in wordhash.blocks(batch.column("_text"), 1):
                found, pieces, at = units(words), [], 0
                also = other_readings(words, found, decoder)
                meant = gained(words, found, also, place)
                more = [(int(k), int(k), also.read[w]) for k, w in zip(also.word, also.which) if meant[w]]
                for first, last, read in sorted(readings(words, found, decoder) + more):
                    pieces += [words.data[at : found.start[first]].tobytes(), read.encode()]
                    at = int(found.end[last])
                pieces.append(words.data[at:].tobytes())
                part = batch.slice(words.first_row, words.rows)
                out = pa.array([b"".join(pieces).decode("utf-8", "replace")] + [""] * (words.rows - 1))
                yield pa.RecordBatch.from_arrays([part.column("doc"), out], ["doc", "restored"])

    return docs.select(F.struct("*").alias("doc"), F.col(text).alias("_text")).mapInArrow(restore, schema)
