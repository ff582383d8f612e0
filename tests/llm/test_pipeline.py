"""The pipeline's stages against their operators, and the registered queries."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from handful.llm.queries import ORACLES, QUERIES
from handful.llm import exact_dedup, mixing, near_copies, pieces, quality
from tests import oracle
from tests.llm import cases

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name, monkeypatch):
    monkeypatch.setattr(oracle, "QUERIES", QUERIES)
    monkeypatch.setattr(oracle, "ORACLES", ORACLES)
    assert oracle.difference(spark, con, name, SF) == ""


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_on_a_folder(spark, tmp_path):
    rows = cases.documents()
    cases.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    cases.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))

    good = {r["id"] for r in quality.classify(docs, labels, threshold=0.3).collect() if r["predicted"]}
    left = docs.where(docs.doc_id.isin([i for i in good if i is not None]) | docs.doc_id.isNull())
    left = left if None in good else left.where("doc_id is not null")
    left = exact_dedup.drop_exact_copies(left)
    left = near_copies.keep_one_near(left)
    left = mixing.take_mixture(left)
    want = pieces.encode(left)
    found = Counter((r["doc_id"], tuple(r["token_ids"])) for r in got.collect())
    assert found == Counter((r["id"], tuple(r["token_ids"])) for r in want.collect())
    assert found


def test_stages_take_empty_tables(spark, tmp_path):
    docs = cases.table(spark, [])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    cases.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == []
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
