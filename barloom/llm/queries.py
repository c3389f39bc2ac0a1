"""Registered queries of the subpackage: name -> callable, and the SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontamination, jaccard_join, licences, packing, pitman_yor, quality_qda, quality_rules, queries_corpus, sharding, toxicity, url_filter
from barloom.llm.staging import table


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("doc.doc_id").alias("doc_id"),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    )


def remainder(column: str, divisor: int) -> Column:
    """What fixes the folds: crc32 of the id as text, modulo ``divisor``. A row without an id is in no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def held_out(column: str, divisor: int, fold: int) -> Column:
    """Whether a row is held out. Rows without an id are not; they have no label, and a language model learns from their texts."""
    return F.coalesce(remainder(column, divisor) == fold, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    learns = ~held_out("doc_id", 5, 0)
    scored = toxicity.scored(docs, toxicity.train(docs.where(learns), labels.where(learns)))
    return scored.select(
        F.col("doc.doc_id").alias("doc_id"),
        held_out("doc.doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_restored",
    )


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learns = ~held_out("doc_id", 5, 1)
    model = pitman_yor.train(docs, learns)
    return pitman_yor.scored(docs, model, learns).select(
        "doc_id",
        (~F.col("learned")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.fixed.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


#: Fixed values of the contract: verdict, host, path.
URL_RULES = tuple(
    url_filter.Rule(*x)
    for x in (
        ("allow", "org", "/"),
        ("block", "example.org", "/es/"),
        ("block", "example.org", "/en/1"),
        ("allow", "com", "/fr/"),
        ("block", "com", "/de/"),
    )
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judged(pages, URL_RULES)
    return judged.select(F.col("page.page_id").alias("page_id"), "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), packing.default_tokenizer())


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of their host: licence headers in the HTML, the host's folders as directories."""
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.host_and_path(F.col("url"))
    files = pages.select("page_id", F.concat(host, path).alias("path"), F.col("html").alias("text"))
    found = licences.licences(files)
    return found.select(
        F.col("file.page_id").alias("page_id"), F.col("file.path").alias("path"), "licence", F.round("score", 9).alias("score"), "origin", "source_folder"
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_qda.train(docs, labels.where(~held_out("doc_id", 4, 2)))
    scored = quality_qda.scored(docs.select("doc_id", "text"), model)
    return scored.select(
        F.col("doc.doc_id").alias("doc_id"),
        held_out("doc.doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


OP9_SQL = r"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), starts AS (
    SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split
), win AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times FROM starts
), again AS (
    SELECT doc_id, count(DISTINCT place) AS n_repeat_words
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM win WHERE times > 1) GROUP BY doc_id
), base AS (
    SELECT doc_id, body, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM split LEFT JOIN again USING (doc_id)
), checked AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 10 * n_symbols > n_words
            OR 10 * (length(body) - length(replace(body, '!!', ''))) > 2 * n_words
            OR 2 * (length(body) - length(regexp_replace(body, '\p{Lu}', '', 'g'))) > word_chars
            OR (n_repeat_words > 0 AND 10 * (SELECT count(*) FROM range(2, len(words) + 1) AS r(k) WHERE words[k] = words[k - 1]) > 3 * n_words)
            OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)) AS kept
FROM checked
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_packing": op5_packing,
    "op6_licences": op6_licences,
    "op7_decontamination": op7_decontamination,
    "op8_sharding": op8_sharding,
    "op9_quality_cascade": op9_quality_cascade,
    "op10_quality_qda": op10_quality_qda,
    **queries_corpus.QUERIES,
}
SQL: dict[str, str] = {"op9_quality_cascade": OP9_SQL, **queries_corpus.SQL}
