"""The pipeline's stages on small tables, and the registered queries."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from phenoscope.llm.queries import QUERIES

from .fixtures import documents, labels, rows, with_clashes
from .test_corpus import components_of, n_words, sets_of


@pytest.fixture()
def folder(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "mix_sources", "best_fit_packing"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_any_table(spark, folder, stage, empty):
    docs = with_clashes(documents(spark, [] if empty else None))
    out = stage[1](spark, docs, folder)
    n = out.count()
    assert (n == 0) == empty
    if stage[0] != "best_fit_packing":
        assert out.columns == docs.columns


def test_dedup_keeps_one_of_each_group(spark, folder):
    left = Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark), folder).collect())
    want = components_of(sets_of(rows(), 5), 80)
    assert left == Counter({i for i, c in want.items() if i == c})


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert got
    clean = {d[0] for d in rows() if n_words(d[1]) >= 10}
    assert {r.doc_id for r in got} <= clean
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.length for r in s) <= 1024 for s in by.values())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
