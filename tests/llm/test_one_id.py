"""Very many rows of one id, or of null: work grows with the rows, and tasks share it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wavefield.llm import language_id, ngram_join, quality_crf, token_files
from wavefield.llm.common import work_dir

N = 2_000


@pytest.fixture(scope="module")
def rows():
    """Texts in threes that link (one word of 40 differs, or none), all of one id."""
    rng = random.Random(2)
    out = []
    for i in range(N // 4):
        w = [f"w{rng.randrange(5_000)}" for _ in range(80)]
        near = [*w[:-1], "other"]
        out += [" ".join(w), " ".join(near), " ".join(w), f"alone {i} " + " ".join(rng.choice("abcdefgh") * 3 for _ in range(30))]
    return out


@pytest.mark.parametrize("doc_id", [7, None])
def test_ngram_join_reads_each_class_once(spark, rows, doc_id, monkeypatch):
    docs = spark.createDataFrame([(doc_id, t) for t in rows], "doc_id long, text string")
    seen = []
    plain = ngram_join.with_texts

    def counted(*args):
        df = plain(*args)
        seen.append(df.count())
        return df

    monkeypatch.setattr(ngram_join, "with_texts", counted)
    got = ngram_join.link_documents(docs).collect()
    assert seen[0] <= N
    assert len(got) == N
    assert all(r["component_id"] == doc_id for r in got)
    # two equal texts and a near one of each three
    assert sum(r["n_links"] == 2 for r in got) == 3 * N // 4
    assert len({r["class_id"] for r in got}) == 3 * N // 4


def test_token_files_deal_one_id_to_many_tasks(spark, rows):
    docs = spark.createDataFrame([(7, t) for t in rows] + [(8, "the same text")] * N, "doc_id long, text string").repartition(8)
    path = work_dir(spark)
    token_files.write_tokens(docs, path)
    files = spark.read.schema(token_files.SCHEMA).parquet(path)
    by_shard = [r["count"] for r in files.groupBy("shard").count().collect()]
    assert len(by_shard) >= 6 and max(by_shard) < N
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == [7] * N + [8] * N


def test_labels_and_rows_that_repeat_an_id_keep_the_fit_bounded(spark, rows, monkeypatch):
    monkeypatch.setattr(quality_crf, "SAMPLE", 20)
    docs = spark.createDataFrame([(i % 300, t) for i, t in enumerate(rows * 5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 300, i % 7 % 2) for i in range(N)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_crf, "fit", lambda x, lengths, *rest: seen.append(len(lengths)))
    quality_crf.train(docs, labels)
    assert 0 < seen[0] <= 60


def test_every_language_is_learned(spark):
    rng = random.Random(4)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(4)] for _ in range(260)]
    rows = [(i, " ".join(rng.choice(words[i % 260]) for _ in range(30)), f"l{i % 260:03}") for i in range(260 * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = language_id.predict(docs.select("doc_id", "text", F.lit(False).alias("held_out")), model).collect()
    right = sum(r["lang_pred"] == f"l{r['doc_id'] % 260:03}" for r in got)
    assert len(set(model["names"])) >= 255 and right > 0.95 * len(got)
