"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import corpus_pipeline
from skyecho.llm import queries
from tests.llm.test_joins import brute_components, brute_lines

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables")


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(corpus_pipeline.STAGES) == 5


def test_queries_on_the_smallest_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for name in ("op1_language", "op2_quality", "op4_fingerprint", "op6_line_dedup", "op8_bpe", "op9_pii"):
        assert sorted(r.doc_id for r in queries.QUERIES[name](spark, DATA).select("doc_id").collect()) == sorted(docs), name
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op10_ngram_join"](spark, DATA).collect()}
    assert got == brute_components(list(docs.items()))
    lines = {r.doc_id: r.n_removed for r in queries.QUERIES["op6_line_dedup"](spark, DATA).collect() if r.n_removed}
    assert lines == {i: len(x) for i, x in brute_lines(list(docs.items())).items()}


def test_every_stage_against_its_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        columns = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, DATA), name)
        if name == "packing":
            break
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "line_dedup":
            gone = brute_lines(list(before.items()))
            assert after == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in before.items()}
        if name == "ngram_join":
            assert set(after) == {i for i, (_, c) in brute_components(list(before.items())).items() if c == i}
        if name == "pii":
            assert not re.search(r"@mail\d\.example\.com", " ".join(after.values()))
    assert {r.doc_id for r in docs.collect()} == set(before) and docs.count() >= len(before)
