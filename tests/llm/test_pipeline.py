"""The corpus pipeline against a plain run of its stages."""

from __future__ import annotations

import corpus_pipeline
from tests.conftest import SMALL
from lodestone.llm import common, quality, toxicity
from tests.llm.conftest import ODD, documents
from tests.llm.test_neardup import brute_force
from tests.llm.test_operators import check_packing


def test_same_as_the_plain_version(spark):
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    good = quality.fit(spark, docs, labels)
    rows = docs.select("doc_id", "text").collect()
    import pyarrow as pa

    kept = [r for r, s in zip(rows, good.scores(pa.array([r["text"] for r in rows], pa.string())), strict=True) if s >= 0.5]
    left = documents(spark, [(r["doc_id"], r["text"]) for r in kept])
    bad = toxicity.fit(spark, left, labels)
    kept = [r for r, s in zip(kept, bad.scores(pa.array([r["text"] for r in kept], pa.string())), strict=True) if s < 0.5]
    kept = [i for i, _, _, k in brute_force([(r["doc_id"], r["text"]) for r in kept], 5, 80) if k]
    found = corpus_pipeline.run(spark, SMALL).collect()
    check_packing(found, 16384, kept)
    assert 0 < len(found) < len(rows)


def test_stages_on_odd_rows(spark, odd):
    """Null, empty, very long and repeated rows, and columns whose names the stages use themselves."""
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SMALL)
        assert found.schema == docs.schema
        rows = found.collect()
        assert {(r["doc_id"], r["text"]) for r in rows} <= {(r["doc_id"], r["text"]) for r in docs.collect()}
    found = corpus_pipeline.STAGES[2][1](spark, odd, SMALL).collect()
    assert sorted(str(r["doc_id"]) for r in found if r["text"] != "the same row twice over and over") == sorted(str(i) for i, t in ODD if t != "the same row twice over and over")
    assert all(r["doc_id"] != 11 for r in found)  # equal to id 7, and the larger one
    assert len(corpus_pipeline.STAGES[3][1](spark, odd, SMALL).collect()) == len(ODD)


def test_stages_return_the_columns_of_documents(spark, empty):
    docs = common.table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).schema == docs.schema
        assert stage(spark, empty, SMALL).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "packing"]
