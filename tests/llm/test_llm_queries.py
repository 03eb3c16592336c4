"""Registered queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import pytest
from oracle_harness import compare, duck

import corpus_pipeline
from arealens.llm import jaccard_join, substring_dedup
from arealens.llm.common import written
from arealens.llm.oracles import SQL
from arealens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    result = compare(spark, duck(SMALL), name, QUERIES[name], SQL[name], SMALL)
    assert result["status"] == "ok", result


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name == "language_id":
            assert all(after[d]["lang"] is not None and after[d][c] == before[d][c] for d in after
                       for c in corpus_pipeline.COLUMNS if c != "lang" or before[d]["lang"] is not None)
        elif name != "line_dedup":
            assert all(after[d] == before[d] for d in after)
        else:
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {p["doc_id"] for p in pieces} == set(before)


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    data = [(None, text[0]), (None, text[1]), (None, text[0] + " end"), (7, text[2]), (7, text[3]), (8, text[3]), (7, text[1])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    docs = written(docs, "test-rows")
    stages = dict(corpus_pipeline.STAGES)
    for stage in ("line_dedup", "jaccard_join"):
        docs = written(stages[stage](spark, docs, SMALL), "test-stage")
    assert {(r["doc_id"], r["text"]) for r in docs.collect()} == {(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3])}
    rows = spark.createDataFrame(data, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(rows).collect())
    assert kept == [(0, 40, 0), (0, 40, 0), (0, 41, 40), (7, 40, 0), (7, 40, 0), (7, 40, 40), (8, 40, 40)]
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_join.join(rows).collect())
    assert found == [(0, 36, 0), (0, 36, 0), (0, 37, 0), (7, 36, 0), (7, 36, 7), (7, 36, 7), (8, 36, 7)]
    assert [(r["a"], r["b"], r["both"], r["either"]) for r in jaccard_join.links(rows).collect()] == [(None, None, 36, 37)]


def test_pipeline_edge_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_2 string"
    for data in ([], [(1, None, None, None, None, ""), (None, "", "en", "s", 0, ""), (None, "", "en", "s", 0, "")]):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, SMALL)
            docs.count()
        assert corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(data, schema), SMALL).count() == 0
