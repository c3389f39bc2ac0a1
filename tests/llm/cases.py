"""Small inputs with every odd case, and plain-Python versions of the operators."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, doc string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def row(doc_id, text):
    return (doc_id, text, "en", "src0", len(text or ""), 0.5, "x", "y")


def frame(spark, texts):
    return spark.createDataFrame([row(i, t) for i, t in texts], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed, count, vocabulary=400):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    out, line = [], 0
    for _ in range(count):
        out.append(rng.choice(names[:40]) if rng.random() < 0.5 else rng.choice(names))
        line += 1
        if line > 12 and rng.random() < 0.2:
            out[-1] += "."
            line = 0
    return " ".join(out)


def odd_texts():
    """Null, empty, blank, single word, very long, a null key and repeated rows."""
    long = prose(5, 30_000)
    return [(1, None), (2, ""), (3, " \t\n "), (4, "Solo"), (5, long), (None, prose(6, 80)), (7, prose(7, 90)), (7, prose(7, 90)), (8, "\x0bnaïve\x0c ÉCLAIR\r\nß 雪 \U0001f600")]


def crc(value):
    return zlib.crc32(str(value).encode())


def shingle_set(text, width=5):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard_components(texts):
    """Component of each position, by comparing every two sets."""
    sets = [shingle_set(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(b)] = find(a)
    return [find(x) for x in range(len(texts))], [len(s) for s in sets]


def rule_statistics(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
