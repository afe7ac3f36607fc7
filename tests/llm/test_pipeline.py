"""The pipeline's stages over the fixture and over a small table, and the queries against their SQL."""

import re

import pytest

import corpus_pipeline
from auditlake.llm.oracles import ORACLES
from auditlake.llm.queries import QUERIES
from tests.check import compare, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, small, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], small) is None


def test_stages_pass_columns_and_effects(spark, docs):
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, kept, "")
        if name != "pack_sequences":
            assert after.columns == docs.columns
        seen.append(after.count())
        path = corpus_pipeline.stored(after, "test-stage")
        kept = path
    assert seen[0] < docs.count() and seen[1] < seen[0] and seen[2] <= seen[1]
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(kept.columns)


def test_empty(spark, none):
    kept = none
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stored(stage(spark, kept, ""), "test-stage")
        assert kept.count() == 0


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small).collect()
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.SEQUENCE


def test_every_operator_has_a_query():
    numbers = sorted(int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 11)) and "pipeline" in QUERIES
