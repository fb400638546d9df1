"""The pipeline's stages on the smallest tables, each against a plain check of its own input."""

import os
from hashlib import sha256

import pytest

import corpus_pipeline
from umbra.llm.common import stored

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES][3] == "benchmark decontamination"
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stored(stage(spark, docs, TABLES), "test")
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert len(ids) == len(rows) and ids <= set(before)
        if k < 4:
            assert out.columns == docs.columns
        if k in (0, 2, 3):
            assert all(r.text == before[r.doc_id] for r in rows)
        if k == 1:
            lines = [x.strip(" \t\r").lower() for r in sorted(rows, key=lambda r: r.doc_id) for x in r.text.split("\n")]
            lines = [x for x in lines if len(x) >= 20]
            assert len(lines) == len(set(lines))
        if k == 3:
            assert ids == {i for i, t in before.items() if not any(b in t for b in benchmark)}
        if k == 4:
            assert ids == set(before) and all(r.decoded_sha256 == sha256(before[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in rows)
        docs = out
