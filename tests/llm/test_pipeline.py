"""The pipeline, stage by stage, and the registered queries."""

import random

import corpus_pipeline
import pytest

from barloom.llm import queries
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "packing"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tables with planted cases in a folder of their own."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(1)
    clean = {k: cases.prose(k, rng.randint(70, 160), 2000) for k in range(80)}
    copies = {100 + k: clean[k] + " tail" for k in range(10)} | {120 + k: clean[k] for k in range(5)}
    junk = {200 + k: " ".join(w + "%%%" for w in clean[k].split()) for k in range(30)}
    item = cases.prose(999, 30, 2000)
    leaks = {300 + k: clean[40] [:0] + cases.prose(700 + k, 60, 2000) + " " + item for k in range(4)}
    texts = clean | copies | junk | leaks | {400: "short", 401: None, 402: ""}
    cases.frame(spark, list(texts.items())).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k not in junk), 0) for k in texts if k < 300 and k % 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, clean, copies, junk, leaks


def test_every_stage_on_its_own_input(spark, corpus):
    folder, clean, copies, junk, leaks = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        kept[name] = {r.doc_id for r in rows}
    prose = set(clean) | set(copies) | set(leaks)
    assert kept["quality rules"] == prose
    assert kept["quality classifier"] == prose
    assert kept["n-gram Jaccard join"] == set(clean) | set(leaks)
    assert kept["benchmark decontamination"] == set(clean) == kept["packing"]


def test_run_gives_the_last_stage(spark, corpus):
    folder, clean, *_ = corpus
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(clean)


def test_repeated_rows_and_unnamed_rows(spark):
    from barloom.llm import jaccard_join

    base = cases.prose(3, 60)
    docs = cases.frame(spark, [(1, base), (1, base), (2, base), (None, base), (5, None), (6, ""), (7, cases.prose(4, 60))])
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in jaccard_join.representatives(docs).collect())
    # One document of each group stays, so the unnamed copy of document 1 goes as well.
    assert got == [(False, 1), (False, 5), (False, 6), (False, 7)]


def test_given_tables(spark):
    for name in ("op1_toxicity", "op2_pitman_yor", "op6_licences", "op8_sharding"):
        assert queries.QUERIES[name](spark, FOLDER).count() > 0
