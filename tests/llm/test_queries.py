"""Registered queries on the smallest tables, twins where there are any, and the pipeline."""

import hashlib

import pytest

import corpus_pipeline
from orebook.llm import bpe
from orebook.llm.queries import QUERIES, TWINS
from tests.llm.test_text_scans import plain_spans
from tests.oracle import compare, connect


@pytest.mark.parametrize("key", sorted(TWINS))
def test_query_equals_its_twin(spark, sf_dir, key):
    assert compare(QUERIES[key](spark, sf_dir), connect(sf_dir), TWINS[key]) == ""


def test_all_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    named = QUERIES["op5_cross_parsing_language"](spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in named) >= 0.95 * len(named) > 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf_dir))
    assert all(s.columns == docs.columns for s in steps[1:-1])
    counts = [s.count() for s in steps]
    assert counts == sorted(counts, reverse=True) and counts[-1] >= 0.6 * counts[0]
    clean = {r.doc_id: r for r in steps[4].collect()}
    assert not any(any(plain_spans(r.text).values()) for r in clean.values())
    assert all(r.n_chars == len(r.text) for r in clean.values())
    last = steps[5].collect()
    assert all(r.text == clean[r.doc_id].text and len(r.ids) == 4 * r.n_tokens for r in last)


def test_pipeline_survives_odd_rows(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "the thing of the other and there was", None, None, None), (3, "", "en", "s", 0),
            (4, "x y z", "en", None, 5), (4, "x y z", "en", None, 5)] + [(10 + i, f"a plain text number {i} with words in it", "en", "s", 30) for i in range(9)]
    folder = tmp_path / "odd"
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert 2 <= len(got) <= len(rows) - 2
    assert [r.doc_id for r in got].count(4) == 1
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_encoded_digest_is_that_of_the_packed_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 20")
    packed = {r.doc_id: r.ids for r in bpe.encode(docs, corpus_pipeline.RANKS, corpus_pipeline.PATTERN).collect()}
    got = {r.doc_id: r.ids_sha256 for r in QUERIES["op2_byte_bpe"](spark, sf_dir).collect()}
    assert all(got[i] == hashlib.sha256(x).hexdigest() for i, x in packed.items())
