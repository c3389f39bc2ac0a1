"""Order-preserving packing of token streams by dynamic programming.

The token streams of a partition's documents stand in their order, one after
the other. Every position is a possible cut. The program picks the cuts with
the least total cost: padding of each sequence, a penalty for a cut inside a
document and a larger one inside a sentence, and a price per sequence.

    best(j) = cut(j) + price + min over i, position(j) - position(i) <= window, of best(i) + padding(j - i)

Padding is window - length, so the minimum runs over best(i) + position(i).
That is the minimum of a sliding window, which a monotone queue keeps as its
falling candidates. The queue is run for a window of positions at once: its state
before the window is a running minimum from the right, what the window adds is one
from the left, and the latter is repeated until nothing changes. That takes a few
rounds: of two positions in one window the direct step pays the window in padding at
most, and every step in between its price, so a best path has at most
1 + window / price steps there (``most_rounds``), however long the stream is.
Lengths that are a power of two take no padding; they are looked up one by one.

Work is per partition of the scan, with no shuffle: order is that of the table's
files and rows. Batches are packed with a carry of the last open sequence, so
memory holds one batch. A hot source or a huge document changes nothing: a
document is only tokens in the stream.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END = 0
#: Costs in tokens: a sequence, a cut at a sentence end, a cut inside a sentence.
PRICE, IN_DOCUMENT, IN_SENTENCE = 64.0, 2.0, 64.0
#: Sentence ends beyond ASCII: CJK, full-width, Arabic, Urdu, Devanagari, Ethiopic, Khmer, Burmese and the ellipsis.
MARKS = "\u3002\uff01\uff1f\uff0e\uff61\u061f\u06d4\u0964\u0965\u1362\u1367\u17d4\u104b\u2026"
#: Tokens that are packed at a time; the last sequences of a chunk are packed again with the next.
CHUNK = 200_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
)


def default_tokenizer() -> str:
    """The public vocabulary that the queries use; any ``tokenizers`` file of a byte-level BPE will do."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes without a visible character count up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizer:
    """The byte-level BPE of a ``tokenizers`` file, run by ``tiktoken``.

    A byte-level vocabulary lists single bytes and merges in the order of their
    rank, so the file's ids are the ranks; both libraries give the same ids and
    tests hold them against each other. The special token's string in a text is
    the special token, as in the file's own library.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        special = {t["content"]: t["id"] for t in held.get("added_tokens", ())}
        byte_of = byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): id_ for token, id_ in held["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)
        size = max([*ranks.values(), *special.values()]) + 1
        self.ends_sentence = np.zeros(size, dtype=bool)
        for token, id_ in ranks.items():
            self.ends_sentence[id_] = token.rstrip(b"\"')]").endswith((b".", b"!", b"?")) or b"\n" in token
        # A mark beyond ASCII may be spread over tokens, so the last three bytes of each token are kept.
        self.marks = np.unique([int.from_bytes(m.encode(), "big") for m in MARKS])
        self.tail, self.tail_size, self.may_end = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, dtype=bool)
        last_bytes = {m.encode()[-1] for m in MARKS}
        for token, id_ in ranks.items():
            self.tail[id_], self.tail_size[id_] = int.from_bytes(token[-3:], "big"), min(len(token), 3)
            self.may_end[id_] = token[-1] in last_bytes

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.asarray(self.core.encode(text, allowed_special="all"), dtype=np.uint32)
        return np.asarray(self.core.encode_ordinary(text), dtype=np.uint32)


    def sentence_ends(self, stream: np.ndarray) -> np.ndarray:
        """Positions after the last token of each sentence."""
        ends = self.ends_sentence[stream]
        at = np.flatnonzero(self.may_end[stream] & ~ends)
        tail, size = self.tail[stream[at]], self.tail_size[stream[at]]
        for back in (1, 2):
            before = stream[np.maximum(at - back, 0)]
            more = (size < 3) & (at >= back)
            tail = np.where(more, tail | self.tail[before] << 8 * size, tail) & 0xFFFFFF
            size = np.where(more, np.minimum(size + self.tail_size[before], 3), size)
        ends[at] = np.isin(tail, self.marks) | np.isin(tail & 0xFFFF, self.marks)
        return np.flatnonzero(ends) + 1


def cut_points(sentence_ends: np.ndarray, document_ends: np.ndarray, total: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream of ``total`` tokens may be cut, and the penalty of each.

    ``document_ends`` are positions after a document's last token, ``sentence_ends``
    after a sentence's. Every position may be cut, whatever the window.
    """
    penalty = np.full(total + 1, IN_SENTENCE)
    penalty[sentence_ends] = IN_DOCUMENT
    penalty[document_ends] = 0.0
    penalty[[0, -1]] = 0.0
    return np.arange(total + 1), penalty


def most_rounds(window: int) -> int:
    """Bound of the rounds within a window of positions: steps of a best path, one that enters it, one that changes nothing."""
    return 3 + int(window / PRICE)


def best_cuts(positions: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cut positions, first 0 and last the end, of least total cost."""
    total = int(positions[-1])
    price = np.full(total + 1, np.inf)
    price[positions] = penalty + PRICE
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    # A window of places without a cost stands before the first position.
    best = np.full(window + total + 1, np.inf)
    best[window] = 0.0
    ahead = best + np.arange(-window, total + 1)
    for begin in range(1, total + 1, window):
        end = min(begin + window, total + 1)
        s, e = begin + window, end + window
        here, own = np.arange(begin, end), price[begin:end]
        least = np.minimum.accumulate(ahead[s - window : s][::-1])[::-1][: e - s]
        for _ in range(most_rounds(window)):
            inner = np.minimum.accumulate(ahead[s:e])[:-1]
            reached = least.copy()
            np.minimum(reached[1:], inner, out=reached[1:])
            reached += window - here
            for p in powers:
                np.minimum(reached, best[s - p : e - p], out=reached)
            reached += own
            if np.array_equal(reached, best[s:e]):
                break
            best[s:e] = reached
            ahead[s:e] = reached + here
        else:
            raise AssertionError("a best path has more steps than its price allows")
    cuts, j = [total], total
    while j:
        at = j + window
        back = [p for p in powers if p <= j and best[at - p] + price[j] == best[at]]
        j = j - max(back) if back else int(np.argmin(ahead[at - window : at])) + j - window
        cuts.append(j)
    return cuts[::-1]


class Packer:
    """Takes documents in order, gives pieces; keeps what is not packed for good."""

    def __init__(self, first_sequence: int, tokenizer: Tokenizer, window: int = WINDOW, chunk: int = CHUNK):
        self.sequence, self.tokenizer, self.window, self.chunk = first_sequence, tokenizer, window, chunk
        self.open: list[tuple[int | None, np.ndarray, int]] = []  # id, ids, tokens already packed
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.open.append((doc_id, ids, 0))
        self.waiting += len(ids)
        return self.pack(last=False) if self.waiting >= self.chunk else []

    def pack(self, last: bool) -> list[tuple]:
        if not self.open:
            return []
        stream = np.concatenate([ids[done:] for _, ids, done in self.open])
        document_ends = np.cumsum([len(ids) - done for _, ids, done in self.open])
        sentence_ends = self.tokenizer.sentence_ends(stream)
        cuts = best_cuts(*cut_points(sentence_ends, document_ends, len(stream), self.window), self.window)
        if not last:
            # A cut far from the open end hardly depends on what follows; the rest is packed again.
            settled = [c for c in cuts if c <= len(stream) - 16 * self.window]
            cuts = settled if len(settled) > 1 else cuts
        pieces, k, position = [], 0, 0
        for begin, end in zip(cuts, cuts[1:]):
            offset = 0
            while position < end:
                doc_id, ids, done = self.open[k]
                take = min(len(ids) - done, end - position)
                crc = zlib.crc32(ids[done : done + take].astype("<u4").tobytes())
                pieces.append((doc_id, done, take, crc, len(ids), self.sequence, offset, end - begin))
                offset, position = offset + take, position + take
                self.open[k] = (doc_id, ids, done + take)
                k += done + take == len(ids)
            self.sequence += 1
        self.open = self.open[k:]
        self.waiting = sum(len(ids) - done for _, ids, done in self.open)
        return pieces


def packed(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece of a document: where it starts in the document and where it stands in its sequence.

    A null or empty text is the end token alone. Null keys are kept, repeated rows
    are packed each on its own. An empty table gives no rows. ``sequence_id`` is
    unique over the table: the number of the scan partition and a counter.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = None, None
        names = [x.split()[0] for x in PIECES.split(", ")]

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], names)

        for rows in batches:
            if packer is None and rows.num_rows:
                tokenizer = Tokenizer(tokenizer_path)
                packer = Packer(rows.column("_part")[0].as_py() << 33, tokenizer, window)
            for doc_id, body in zip(rows.column("_key"), rows.column("_text")):
                ids = np.append(tokenizer.ids(body.as_py() or ""), np.uint32(END))
                if pieces := packer.add(doc_id.as_py(), ids):
                    yield batch(pieces)
        if packer is not None and (pieces := packer.pack(last=True)):
            yield batch(pieces)

    rows = docs.select(
        F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), F.spark_partition_id().cast("long").alias("_part")
    )
    return rows.mapInArrow(pack, PIECES)
