"""Runs of words against brute force: random and built sequences, any portions, odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from wavefield.llm import periodic_runs
from wavefield.llm.periodic_runs import Catchers


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """Every run by comparing words at each distance."""
    found, n = [], len(w)
    for p in range(1, n // 3 + 1):
        i = p
        while i < n:
            j = i
            while j < n and w[j] == w[j - p]:
                j += 1
            start, length = i - p, j - i + p
            if j > i and length >= max(24, 3 * p) and not any(w[start + q : j] == w[start : j - q] for q in range(1, p)):
                found.append((start, length, p))
            i = max(j, i) + 1
    return sorted(found, key=lambda x: (x[0], x[2]))


def _caught(w: list, cuts: list[int]) -> list[tuple[int, int, int]]:
    h = periodic_runs.mixed(np.array([x + 1 for x in w], np.uint64))
    catchers = Catchers()
    for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True):
        catchers.append(h[a:b])
    return catchers.runs()


def _sequences(rng: np.random.Generator):
    for _ in range(250):
        kind, n = rng.integers(6), int(rng.integers(1, 260))
        if kind == 0:
            w = rng.integers(0, 2, n)
        elif kind == 1:
            w = (rng.random(n) < 0.03).astype(int)
        elif kind == 2:
            w = np.tile(rng.integers(0, 3, int(rng.integers(1, 30))), 12)[:n]
        elif kind == 3:  # stretches of one word inside a period
            unit = np.concatenate([np.full(rng.integers(1, 40), 0), rng.integers(0, 3, int(rng.integers(1, 4))), np.full(rng.integers(0, 30), 1)])
            w = np.concatenate([rng.integers(0, 4, 5), np.tile(unit, int(rng.integers(2, 6))), rng.integers(0, 4, 5)])
        elif kind == 4:  # runs of runs
            x, y = np.tile(rng.integers(0, 2, 3), int(rng.integers(1, 9))), np.tile(rng.integers(0, 2, 2), int(rng.integers(1, 9)))
            w = np.tile(np.concatenate([x, y]), 5)
            w[rng.integers(0, len(w), 2)] = 7
        else:
            w = np.tile(rng.integers(0, 50, int(rng.integers(1, 80))), 4)
            w = w[int(rng.integers(0, 20)) :]
        yield w.tolist()


def test_runs_equal_brute_force_in_any_portions():
    rng = np.random.default_rng(5)
    some = 0
    for w in _sequences(rng):
        expected = plain_runs(w)
        some += len(expected)
        assert _caught(w, []) == expected
        cuts = np.unique(rng.integers(0, len(w) + 1, 5)).tolist()
        assert _caught(w, cuts) == expected
    assert some > 200


def test_word_by_word():
    rng = np.random.default_rng(6)
    for w in list(_sequences(rng))[:25]:
        assert _caught(w, list(range(1, len(w)))) == plain_runs(w)


def test_repeated_words_set_few_catchers():
    catchers = Catchers()
    w = np.full(200_000, 3, np.uint64)
    w[100_000] = 4
    catchers.append(w)
    assert catchers.runs() == [(0, 100_000, 1), (100_001, 99_999, 1)]
    assert len(catchers.latest) < 200


def plain(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


@pytest.fixture(scope="module")
def odd_rows():
    planted = [i for i in range(3_000) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    texts = ["a b " * 40, "x" * 5_000, "", None, " \n\t ", "é ü ß " * 30, "one two three four five six seven eight nine ten eleven " * 9, "w\x0bw\x0cw\rw " * 20]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(i, " ".join(f"w{j % 37}" for j in range(100 + i % 50))) for i in planted]
    rows += [(None, "a b c d " * 10), (None, None), (None, "a b c d " * 10), (planted[0], ""), (planted[0], None), (planted[1], "one")]
    return rows + [(9, "q r s " * 20)] * 3


def test_query_on_odd_rows(spark, tmp_path, odd_rows):
    rows = [(*x, "en", 1) for x in odd_rows]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain(*x) for x in odd_rows), key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert periodic_runs.op11_periodic_runs(spark, str(tmp_path)).count() == 0
