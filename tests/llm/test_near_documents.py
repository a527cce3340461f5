"""The pipeline's near-duplicate stage against brute force on pairs between the two thresholds."""

from __future__ import annotations

import random

import corpus_pipeline
from wavefield.llm import ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rng, rows = random.Random(4), []
    for n, changed in ((100, (30, 60)), (200, (30, 70, 110, 150)), (100, (10, 30, 50, 70))):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
        other = ["changed" if i in changed else x for i, x in enumerate(words)]
        rows += [(len(rows) + k, " ".join(x), "en", "s", 0) for k, x in enumerate((words, other))]
    return rows


def _kept(rows, length, least):
    """Smallest ids of the components of texts linked by Jaccard."""
    sets = {r[0]: {tuple(w[k : k + length]) for k in range(len(w) - length + 1)} for r in rows for w in [r[1].split()]}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    return {i for i, v in root.items() if i == v}


def test_stage_between_thresholds(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"] for r in ngram_join.stage(spark, docs, "").collect()} == _kept(rows, 5, 80) == {0, 2, 4, 5}
    same = ngram_join.link_documents(docs).where("doc_id = component_id").collect()
    assert {r["doc_id"] for r in same} == _kept(rows, 3, 90) == set(range(6))


def test_pipeline_uses_the_stage():
    assert dict(corpus_pipeline.STAGES)["ngram_join"] is ngram_join.stage
