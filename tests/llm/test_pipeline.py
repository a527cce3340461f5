"""The pipeline on the smallest tables, stage by stage against plain Python."""

from __future__ import annotations

import corpus_pipeline
from wavefield.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == names
        rows = docs.collect()
        if name == "quality_rules":
            kept = {r["doc_id"] for r in rows}
            good = [i for i in before if labels.get(i) == 1 and len(before[i].split()) >= 25]
            assert sum(i in kept for i in good) >= 0.98 * len(good)
            assert not [i for i in kept if labels.get(i) == 0]
        if name == "line_dedup":
            lines = [x for r in rows for x in r["text"].lower().split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
        assert {r["doc_id"] for r in rows} <= set(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(packed)
