"""Quality rules as a short-circuit cascade.

A sample gives each rule's cost (seconds) and selectivity (rows it rejects of
those that reach it). The rules then stand in one CASE by rejection per cost, the base
checks first: a row stops at the first rule that rejects it. The order changes
the work, never the verdict. All statistics are built-in functions over one
row, so a hot source or group of copies needs no shuffle at all.

Null, empty and white-space texts have no words and fail the base check. Every
row of the input gives one row, repeated rows included. Columns of the input
keep their names inside the struct ``doc``.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import computed_once
from barloom.llm.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS = 200

BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


class Rule(NamedTuple):
    """``rejects``: SQL over ``body``, ``words`` and the base statistics."""

    name: str
    rejects: str


RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("shouting", "10 * (char_length(body) - char_length(replace(body, '!!', ''))) > 2 * n_words"),
    Rule("capitals", r"2 * (char_length(body) - char_length(regexp_replace(body, '\\p{Lu}+', ''))) > word_chars"),
    Rule(
        "stutter",
        "n_repeat_words > 0 AND 10 * size(filter(words, (w, i) -> i > 0 AND w = words[if(i > 0, i - 1, 0)])) > 3 * n_words",
    ),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines"),
)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (the whole row), ``body``, ``words`` and the base statistics of every row."""
    bodies = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    split = bodies.select(
        "doc",
        "body",
        F.regexp_extract_all("body", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.expr(r"filter(split(body, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    counted = split.select(
        "doc",
        "body",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.expr("aggregate(words, 0L, (a, w) -> a + char_length(w))").alias("word_chars"),
        (F.char_length("body") - F.char_length(F.regexp_replace("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "CASE WHEN size(words) < 3 THEN CAST(array() AS ARRAY<BIGINT>) ELSE"
            " transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END"
        ).alias("windows"),
    )
    repeated = counted.withColumn(
        "hits",
        F.expr(
            "CASE WHEN size(windows) = size(array_distinct(windows)) THEN NULL"
            " ELSE sort_array(transform(windows, (h, i) -> struct(h, i))) END"
        ),
    )
    twice = (
        "filter(hits, (x, k) -> (k > 0 AND x.h = hits[if(k > 0, k - 1, 0)].h)"
        " OR (k < size(hits) - 1 AND x.h = hits[if(k < size(hits) - 1, k + 1, 0)].h))"
    )
    covered = f"size(array_distinct(flatten(transform({twice}, x -> array(x.i, x.i + 1, x.i + 2)))))"
    return repeated.withColumn(
        "n_repeat_words", F.expr(f"CAST(CASE WHEN hits IS NULL THEN 0 ELSE {covered} END AS BIGINT)")
    ).drop("windows", "hits")


class Figures(NamedTuple):
    """What a sample says: seconds of each rule, and how many rows each set of rules rejects together."""

    seconds: dict[str, float]
    rejected: list[tuple[frozenset[str], int]]


def measured(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> Figures:
    """Cost and rejections of the rules on about ``sample_rows`` rows, drawn by a hash of their place in the table.

    The base checks come first whatever they cost, so the figures are of rows that
    pass them. The sample is a written table; only counts come to the driver, one
    for each set of rules that reject a row together.
    """
    share = sample_rows / max(docs.count(), 1)
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1_000_000)) < F.lit(int(1_000_000 * share) + 1)
    sample = staged(docs.select(F.col(text).alias("text"), drawn.alias("drawn")).where("drawn").select("text"), "rules-sample")
    # Written before the filter, which would otherwise be pushed into every step of the statistics.
    reached = staged(statistics(sample).drop("doc"), "rules-statistics").where(~F.expr(BASE_FAILED))

    def seconds(condition: Column) -> float:
        began = time.perf_counter()
        reached.agg(F.count_if(condition)).first()
        return time.perf_counter() - began

    floor = min(seconds(F.lit(True)) for _ in range(2))
    cost = {rule.name: max(min(seconds(F.expr(rule.rejects)) for _ in range(2)) - floor, 1e-4) for rule in rules}
    names = F.array_compact(F.array(*(F.when(F.expr(rule.rejects), rule.name) for rule in rules)))
    counts = reached.groupBy(names.alias("names")).agg(F.count("*").alias("n")).collect()
    return Figures(cost, [(frozenset(r["names"]), r["n"]) for r in counts])


def cascade(figures: Figures, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by rejection per cost, each counted on the rows that the ones before it let through; equal ones stay in the given order."""
    order, left, open_rules = [], figures.rejected, list(rules)
    while open_rules:
        worth = {r.name: sum(n for names, n in left if r.name in names) / figures.seconds[r.name] for r in open_rules}
        best = max(open_rules, key=lambda r: (worth[r.name], -rules.index(r)))
        order.append(best)
        open_rules.remove(best)
        left = [(names, n) for names, n in left if best.name not in names]
    return tuple(order)


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc``, the base statistics, ``base_failed`` and ``kept``.

    Which rule of several rejects a row first depends on the measured order, which
    may differ between runs, so it is not told; whether a row is kept does not.
    """
    stats = statistics(docs, text)
    kept = F.when(F.expr(BASE_FAILED), F.lit(False))
    for rule in cascade(measured(docs, text, rules, sample_rows), rules):
        kept = kept.when(F.expr(rule.rejects), F.lit(False))
    # Through a one-row generator: a filter on the verdict must not be pushed below the statistics,
    # where every use would compute them anew.
    return computed_once(
        stats.select("doc", "body", "words", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"),
        {"base_failed": F.expr(BASE_FAILED), "kept": kept.otherwise(F.lit(True))},
    ).select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
