"""Batch edit distances against the plain dynamic program."""

from __future__ import annotations

import random

import numpy as np

from wavefield.llm import edits, line_dedup


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def _pairs(rng, n, sizes, letters="abcé日 "):
    for _ in range(n):
        a = [rng.choice(letters) for _ in range(rng.choice(sizes))]
        b = list(a)
        for _ in range(rng.randint(0, 2 + len(a) // 4)):
            kind, at = rng.randrange(3), rng.randint(0, len(b))
            if kind == 0:
                b.insert(at, rng.choice("abz\U0001f600"))
            elif at < len(b):
                b[at : at + 1] = [] if kind == 1 else [rng.choice("abx")]
        yield "".join(a), "".join(b)


def _bound(a, b):
    """Least cost of whole-word edits, by the plain dynamic program."""
    row = [0]
    for y in b:
        row.append(row[-1] + len(y) + 1)
    for x in a:
        new = [row[0] + len(x) + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (0 if x == y else max(len(x), len(y))), row[j + 1] + len(x) + 1, new[j] + len(y) + 1))
        row = new
    return row[-1]


def test_word_bounds(monkeypatch):
    rng, lines = random.Random(1), []
    for _ in range(200):
        a = [rng.choice(["a", "bcd", "efghij", "kl"]) for _ in range(rng.randint(1, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.choice(["a", "xyz", "kl"])] * rng.randint(0, 2)
        lines.append((a, b or ["q"]))
    lines += [(["a"] * 30, ["a"]), (["a"], ["b"]), (["a"], ["a"])]
    for size in (7, 1_024):
        monkeypatch.setattr(edits, "PAIRS", size)
        got = edits.word_bounds([a for a, _ in lines], [b for _, b in lines])
        for (a, b), bound in zip(lines, got, strict=True):
            if abs(len(a) - len(b)) <= 4:  # then the best way stays near the diagonal
                assert bound == _bound(a, b)
            assert bound >= _distance(" ".join(a), " ".join(b))
    assert len(edits.word_bounds([], [])) == 0


def test_similar_pairs():
    rng = random.Random(2)
    pairs = list(_pairs(rng, 200, [1, 4, 5, 9, 30, 80]))
    expected = [_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9 for x, y in pairs]
    assert line_dedup.similar_pairs([x for x, _ in pairs], [y for _, y in pairs]).tolist() == expected
    assert [line_dedup.similar(x, y) for x, y in pairs] == expected
