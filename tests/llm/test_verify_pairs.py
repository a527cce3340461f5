"""Verdicts on many pairs of lines at once: letters, shingles and batch distances against the plain dynamic program."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.test_edits import _distance, _pairs
from wavefield.llm import edits, line_dedup
from wavefield.llm.textbytes import mixed, words


def _lines(rng, n, sizes):
    near = list(_pairs(rng, n, sizes))
    apart = [(x[0], y[1]) for x, y in zip(near, near[1:], strict=False)]
    return near + apart


def test_batch_distances_equal_the_dynamic_program():
    pairs = [(a, b) for a, b in _lines(random.Random(8), 300, [1, 2, 7, 8, 9, 16, 17, 32, 33, 63, 64]) if 0 < len(a) <= 64]
    assert edits.distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [_distance(a, b) for a, b in pairs]


@pytest.mark.parametrize("sizes", [[0, 1, 3, 4, 5, 6, 9], [20, 40, 64, 65], [90, 150, 260]])
def test_filters_lose_no_similar_pair(sizes):
    pairs = _lines(random.Random(9), 200, sizes)
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    expected = [_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in pairs]
    assert line_dedup.similar_pairs(a, b).tolist() == expected
    limit, every = np.array([_distance(x, y) for x, y in pairs]), np.arange(len(pairs))
    assert edits.letters_allow(edits.letter_counts(a), every, edits.letter_counts(b), every, limit).all()
    assert edits.grams_allow(a, b, limit).all()


def test_pairs_that_letters_settle_are_not_compared(monkeypatch):
    """Most pairs of a hot key of short lines have too few letters in common."""
    seen = []
    monkeypatch.setattr(edits, "word_bounds", lambda a, b: seen.extend(a) or np.full(len(a), 1 << 28))
    monkeypatch.setattr(line_dedup, "edit_distance", lambda a, b, limit: seen.append(a) or limit + 1)
    assert not line_dedup.similar_pairs(["threou and"] * 50, ["thesnt big"] * 50).any()
    assert not line_dedup.similar_pairs(["abcd efgh " * 20] * 5, ["hgfe dcba " * 20] * 5).any()
    assert seen == []


def test_word_hashes_are_as_by_single_bytes():
    rng = random.Random(10)
    for sizes in ([1, 2, 5], [15, 16, 17, 40], [4_095, 4_096, 4_097, 5_000]):
        raw = " ".join("".join(rng.choices("abcxyz", k=rng.choice(sizes))) for _ in range(20)).encode()
        buf = np.frombuffer(raw, np.uint8)
        starts, ends, hashes = words(buf, buf == 32)
        assert [raw[i:j] for i, j in zip(starts, ends, strict=True)] == raw.split()
        for word, h in zip(raw.split(), hashes.tolist(), strict=True):
            place = np.arange(len(word), dtype=np.uint64)
            power = mixed(np.where(place < 4_096, place + np.uint64(1), place)) | np.uint64(1)
            total = (power * (np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1))).sum()
            assert mixed(np.array([int(total) + len(word) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0] == h


def test_lines_too_short_for_an_edit_have_no_links(spark):
    """A class of three characters meets none, one of four may meet one of five."""
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(["abc", "abd", "abc", "abcd", "abcde", "abce"])], "doc_id long, text string")
    rows = {(r["doc_id"]): r for r in line_dedup.line_groups(docs, word_parts=True).collect()}
    assert rows[0]["group_id"] == rows[2]["group_id"] != rows[1]["group_id"]
    assert rows[3]["group_id"] == rows[4]["group_id"] == rows[5]["group_id"]
    assert sorted(i for i in rows if not rows[i]["kept"]) == [2, 4, 5]
