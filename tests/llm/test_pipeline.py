"""Each stage of the pipeline, row by row, against plain versions of what it decides."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from marginalia.llm import pii, quality_classifier
from tests.llm import test_decontamination, test_simhash


@pytest.fixture(scope="module")
def stages(spark, data):
    """The rows before the first stage and after each of the first four."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        out.append(docs.collect())
    return out


def keyed(rows) -> dict:
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: tuple(r) for r in rows}


def test_rejected_documents_go(spark, data, stages):
    good = {r["doc_id"] for r in quality_classifier.op10_quality_classifier(spark, data).where("predicted = 1").collect()}
    assert keyed(stages[1]) == {d: r for d, r in keyed(stages[0]).items() if d in good} and len(stages[1]) < len(stages[0])


def test_the_smallest_of_each_group_stays(stages):
    fps = {r["doc_id"]: test_simhash.brute_fingerprint(r["text"]) for r in stages[1]}
    root = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if root[a] > root[b] and (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[a], changed = root[b], True
    assert keyed(stages[2]) == {d: r for d, r in keyed(stages[1]).items() if root[d] == d}


def test_documents_with_an_item_go(spark, data, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    bad = {doc for doc, *_ in test_decontamination.brute([(r["doc_id"], r["text"]) for r in stages[2]], items)}
    assert keyed(stages[3]) == {d: r for d, r in keyed(stages[2]).items() if d not in bad}


def test_only_personal_data_changes(stages):
    before, after = keyed(stages[3]), keyed(stages[4])
    assert before.keys() == after.keys()
    changed = 0
    for d, (doc_id, text, lang, source, _) in before.items():
        new = after[d]
        assert (new[0], new[2], new[3], new[4]) == (doc_id, lang, source, len(new[1]))
        at = 0
        for piece in re.split(pii.PATTERN, text):
            at = new[1].index(piece, at) + len(piece)
        changed += new[1] != text
        if not re.search(pii.PATTERN, text):
            assert new[1] == text
    assert changed > 0
