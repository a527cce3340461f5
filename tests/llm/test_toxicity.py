"""The toxicity scorer: exact neighbours, plain twins of its parts, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wavefield.llm import toxicity
from wavefield.llm.toxicity import Index, Vocabulary, curve, share, terms, vectors

SF = "/root/testdata/sf0.01"


def _random_examples(rng, n=700, n_terms=90):
    rows = [(i, t, float(w)) for i in range(n) for t, w in zip(np.sort(rng.choice(n_terms, int(rng.integers(0, 9)), replace=False)), rng.random(9), strict=False)]
    example, term, weight = (np.array(x) for x in zip(*rows, strict=True))
    return example, term, weight / np.sqrt(np.bincount(example, weights=weight * weight))[example]


@pytest.mark.parametrize("size", [8, 64])
def test_blocks_give_what_comparing_all_gives(size):
    rng = np.random.default_rng(4)
    example, term, weight = _random_examples(rng)
    index = Index(example, term, weight, 90, size)
    opened = 0
    for k in (1, 5, 40):
        for _ in range(60):
            t = np.sort(rng.choice(90, int(rng.integers(1, 7)), replace=False))
            q = rng.random(len(t))
            without = int(rng.integers(-1, 700))
            ids, cosines = index.nearest(t, q, k, without)
            scores = np.zeros(index.n)
            for a, w in zip(t, q, strict=True):
                some = term == a
                scores[example[some]] += w * weight[some]
            if 0 <= without < index.n:
                scores[without] = 0
            best = np.lexsort((np.arange(index.n), -scores))[:k]
            best = best[scores[best] > 0]
            assert ids.tolist() == best.tolist() and np.array_equal(cosines, scores[best])
    opened = index.opened
    assert opened < 180 * -(-index.n // size)  # some blocks were left out


def test_terms_and_counts_equal_plain_ones():
    texts = ["Idiot, idiot IDIOTIC! d\u00e9j\u00e0-vu", "", "a1b2c3d4e5 x", "w" * 5_000, "\u65e5\u672c\u8a9e \u65e5\u672c", "abcdefgh abcdefghi"]
    run = [t.encode() for t in texts]

    def plain(t):
        w = re.findall(rb"[A-Za-z0-9\x80-\xff]+", t)
        w = [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in w]
        return Counter(w) + Counter(b"^" + x[:k] for x in w for k in range(4, 9) if len(x) > k)

    text, h = terms(run)
    got = [Counter(h[text == i].tolist()) for i in range(len(run))]
    names: dict[bytes, set] = {}
    for i, t in enumerate(run):
        assert sorted(got[i].values()) == sorted(plain(t).values())
    # equal terms have equal hashes, different ones different
    assert len(set(h.tolist())) == len(set().union(*map(plain, run)))
    some = np.array(sorted(set(h.tolist()))[::2], np.uint64)
    vocabulary = Vocabulary(some)
    t, v, n = vocabulary.counts(run)
    assert {(a, int(vocabulary.hashes[b])): c for a, b, c in zip(t.tolist(), v.tolist(), n.tolist(), strict=True)} == {
        (i, x): c for i, g in enumerate(got) for x, c in g.items() if x in set(some.tolist())
    }
    assert Vocabulary(np.zeros(0, np.uint64)).counts(run)[0].size == 0


def test_vectors_votes_and_curve():
    idf = np.array([1.0, 2.0, 3.0])
    w = vectors(np.array([0, 0, 2]), np.array([0, 2, 1]), np.array([1, 3, 2]), idf)
    x = np.array([1.0, (1 + np.log(3)) * 3])
    assert np.allclose(w, [*(x / np.sqrt((x * x).sum())), 1])
    assert np.isclose(share(np.array([1, 0]), np.array([0.8, 0.4]), np.array([1.0, 2.0]), 0.1), (0.64 + 0.005) / (0.64 + 0.32 + 0.05))
    assert share(np.zeros(0), np.zeros(0), np.zeros(0), 0.1) == pytest.approx(0.1)
    rng = np.random.default_rng(0)
    z = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(1 + 2 * z)))).astype(float)
    a, b = curve(z, y, np.ones(len(z)))
    assert abs(a - 1) < 0.15 and abs(b - 2) < 0.2


def test_held_out_accuracy(spark):
    got = toxicity.op12_toxicity(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    share_right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    always_clean = sum(r["toxic"] == 0 for r in held) / len(held)
    assert share_right > max(0.9, always_clean)
    fit = [r for r in rows if not r["held_out"] and r["toxic"] == 1]
    assert sum(r["predicted"] for r in fit) > 0.6 * len(fit)
    assert all(len(r["evidence"]) <= 5 and list(r["evidence"]) == sorted(r["evidence"], key=lambda e: -e["cosine"]) for r in rows)


def _rows(rng):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words) for _ in range(40))
        rows.append((i, text + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0)))
    return rows


def test_odd_rows(spark):
    rows = _rows(random.Random(1))
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, evidence string, score double")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(1, None, "x"), (None, 1, "x"), (10**9, 1, "x"), (3, 0, "x"), (4, 7, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    odd = [(1, None), (2, ""), (None, "so vile"), (4, "vile " * 50_000), (5, "\n"), (5, "Vile"), (5, "Vile"), (6, "w3 w4 w5")]
    more = spark.createDataFrame([(i, t, i == 5) for i, t in odd], "doc_id long, text string, held_out boolean")
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["score"], r["predicted"], len(r["evidence"])) for r in toxicity.score_documents(more, model).collect()), key=str)
    by_id = {}
    for _, i, score, predicted, n in got:
        by_id.setdefault(i, []).append((round(score, 6), predicted, n > 0))
    assert by_id[None][0][1] == 1 and by_id[4][0][1] == 1
    assert by_id[1] == by_id[2] == by_id[6] and by_id[1][0][1:] == (0, False)
    assert sorted(x[1] for x in by_id[5]) == [0, 1, 1] and len(set(by_id[5])) == 2
    assert toxicity.score_documents(more.limit(0), model).count() == 0


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for rows, score in (([], 0.0), ([(1, 0), (2, 0), (3, 0)], 0.0), ([(1, 1), (2, 1), (3, 1)], 1.0)):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r["score"] for r in toxicity.score_documents(docs.withColumn("held_out", toxicity.held_out()), model).collect()} == {score}
    # labels of both kinds, but documents of one
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert "index" not in toxicity.train(docs.where("doc_id = 1"), labels)
    assert "index" not in toxicity.train(docs.limit(0), labels)


def test_repeated_ids_and_texts_keep_the_sample_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    docs = spark.createDataFrame([(i % 3 + 1, f"t{i % 500}") for i in range(1_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 3 + 1, i % 2) for i in range(300)], "doc_id long, toxic int")
    examples, _ = toxicity._examples(docs, labels)
    assert examples.count() <= 30
