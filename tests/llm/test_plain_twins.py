"""Scores of the two classifiers against plain loops over lines, words and bytes."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from wavefield.llm import language_id, quality_crf

SF = "/root/testdata/sf0.001"
ODD = ["", "\n\n", "one\n\nTWO three three!!! #*$\n", "  a a a b\r\nc", "ÄÖ ß 12\nx" * 3, "\x0b \t"]


@pytest.fixture(scope="module")
def texts():
    found = pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()
    return [x for x in found if x is not None and len(x) < 3_000][:60] + ODD


def _own(line: bytes) -> list[float]:
    kinds = [0] * 8
    for b in line:
        kinds[int(quality_crf._CLASS[b])] += 1
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", line) if w]
    n, size = max(1, len(words)), max(1, len(line))
    shares = [k / size for k in kinds]
    shares[3:5] = [min(1.0, kinds[k] / n) for k in (3, 4)]
    again = sum(w in words[max(0, i - 2) : i] for i, w in enumerate(words)) / n
    ended = bool(line) and line[-1] in b".!?:;\"')"
    return [*shares, math.sqrt(shares[3]), math.sqrt(shares[4]), again, math.sqrt(again), float(ended), math.log1p(len(words)) / 5, float(not line)]


def _score(text: str, model: dict) -> float:
    lines = text.encode().split(b"\n")
    own = [_own(x) for x in lines]
    none = [0.0] * len(own[0])
    odds = [float(np.dot([*own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), 1.0], model["lines"])) for i in range(len(own))]
    t = model["transitions"]
    node = [(1.0, math.exp(min(40, max(-40, o)))) for o in odds]
    forward, backward = [node[0]], [(1.0, 1.0)]
    scaled = lambda x: tuple(y / sum(x) for y in x)
    for i in range(1, len(node)):
        forward.append(scaled([sum(forward[-1][a] * math.exp(t[a][b]) for a in (0, 1)) * node[i][b] for b in (0, 1)]))
    for i in range(len(node) - 1, 0, -1):
        backward.insert(0, scaled([sum(math.exp(t[a][b]) * node[i][b] * backward[0][b] for b in (0, 1)) for a in (0, 1)]))
    good = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward, strict=True)]
    length = [len(x) + 1 for x in lines]
    return sum(g * n for g, n in zip(good, length, strict=True)) / sum(length) if text else 0.0


def test_quality_scores(texts):
    rng = np.random.default_rng(3)
    model = {"lines": rng.normal(size=quality_crf.FEATURES), "transitions": rng.normal(size=(2, 2))}
    got = quality_crf.score_run([x.encode() for x in texts], model)
    assert np.allclose(got, [_score(x, model) for x in texts], atol=1e-5)


def test_quality_fit_separates_what_it_has_seen():
    good, bad = "A plain line of text that ends well.\nAnd another one follows here.", "BUY NOW!!! $$$ ###\nclick *** click *** click"
    runs = [x.encode() for x in (good, bad) * 20]
    x, _, per_text = quality_crf.line_features(runs)
    model = quality_crf.fit(x, per_text, np.array([1, 0] * 20), np.ones(40))
    score = quality_crf.score_run(runs, model)
    assert score[::2].min() > 0.9 and score[1::2].max() < 0.1


def _vector(text: str) -> np.ndarray:
    out, word = [0] * language_id.DIMENSIONS, 0xFFFFFFFF
    data = [b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in text.lower().encode()]
    place = lambda x: ((x ^ (x >> 15)) * 0x2C1B3C6D & word) >> 20
    for i in range(len(data) - 1):
        two = (data[i] * 0x9E3779B1 + data[i + 1] * 0x85EBCA6B) & word
        out[place((two + 1) & word)] += 1
        if i + 2 < len(data):
            out[place((two + data[i + 2] * 0xC2B2AE35) & word)] += 1
    return np.sqrt(np.array(out, float))


def test_language_vectors_and_centroids(texts):
    found = np.concatenate([x for _, x in language_id.counts(texts)])
    plain = np.array([_vector(x) for x in texts])
    assert np.allclose(found, plain, atol=1e-5)
    langs = np.array(["a", "b", "c"] * 22)
    model = language_id.fit(found, langs, 2)
    idf = np.array([math.log((1 + len(plain)) / (1 + (plain[:, j] > 0).sum())) + 1 for j in range(plain.shape[1])])
    assert np.allclose(model["idf"], idf, rtol=1e-5) and model["names"] == ["a", "a", "b", "b", "c", "c"]
    for lang in "abc":
        mine = [v * idf / max(1e-12, np.linalg.norm(v * idf)) for v, x in zip(plain, langs, strict=True) if x == lang]
        centres = model["centres"][[i for i, x in enumerate(model["names"]) if x == lang]].astype(float)
        own = [int(np.argmax(centres @ v)) for v in mine]
        for j in range(2):  # each is the direction of the mean of those nearest to it
            members = [v for v, k in zip(mine, own, strict=True) if k == j]
            if members:
                mean = np.mean(members, axis=0)
                assert float(centres[j] @ mean) >= 0.98 * np.linalg.norm(mean) - 1e-9


def test_language_predictions(spark, texts):
    found = np.concatenate([x for _, x in language_id.counts(texts)])
    model = language_id.fit(found, np.array(["a", "b", "c"] * 22), 2)
    docs = spark.createDataFrame([(i, x, False) for i, x in enumerate(texts)], "doc_id long, text string, held_out boolean")
    for r in language_id.predict(docs, model).collect():
        text = texts[r["doc_id"]]
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        v = _vector(text) * model["idf"]
        cosine = model["centres"] @ (v / np.linalg.norm(v))
        assert r["score"] == pytest.approx(min(1, max(0, cosine.max())), abs=1e-4)
        assert cosine.max() - cosine[[i for i, x in enumerate(model["names"]) if x == r["lang_pred"]]].max() < 1e-4
