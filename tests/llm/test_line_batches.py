"""Long lines are compared many at once, keys are dealt to buckets and cells are verified together, with the same results."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_edits import _distance
from wavefield.llm import edits, line_dedup


def _lines(rng, letters, sizes, n):
    for _ in range(n):
        size = rng.choice(sizes)
        a = [rng.choice(letters) for _ in range(size)]
        b = list(a)
        for _ in range(rng.randrange(0, max(2, int(0.35 * size)))):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
        if rng.random() < 0.2:  # a passage in common, at different places
            cut = rng.randrange(size)
            b = rng.choices(letters, k=rng.randrange(size)) + a[cut:]
        yield "".join(a), "".join(b)


@pytest.mark.parametrize("letters", ["ab ", "abcdefghijklmnop ", [chr(0x4E00 + i) for i in range(900)]])
def test_verdicts_of_long_lines_equal_the_dynamic_program(letters):
    pairs = list(_lines(random.Random(3), letters, [1, 5, 63, 64, 65, 100, 127, 128, 129, 200, 330], 150)) + [("", "ab"), ("", "")]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    exact = np.array([_distance(x, y) for x, y in pairs])
    for limit in (exact, np.maximum(exact - 1, 0), exact + 3, line_dedup._limits(np.array([len(x) for x in a]), np.array([len(x) for x in b]))):
        assert edits.within(a, b, limit).tolist() == (exact <= limit).tolist()
        assert edits.within(b[:1], a[:1], limit[:1]).tolist() == (exact[:1] <= limit[:1]).tolist()


def test_long_lines_are_not_compared_one_by_one(monkeypatch):
    pairs = [x for x in _lines(random.Random(4), "abcdefghijklmnop ", [90, 200, 330], 100) if min(map(len, x)) > 64]
    expected = [line_dedup.similar(a, b) for a, b in pairs]
    assert 10 < sum(expected) < len(pairs) - 10
    monkeypatch.setattr(line_dedup, "edit_distance", lambda a, b, limit: 1 / 0)
    assert line_dedup.similar_pairs([a for a, _ in pairs], [b for _, b in pairs]).tolist() == expected


def test_buckets_find_every_key_that_comes_again():
    rng = np.random.default_rng(5)
    for _ in range(20):
        size, batches, entries = 60, [], set()
        for first in range(0, 4 * size, size):
            parts = [[int(x) for x in rng.integers(-40, 40, rng.integers(0, 4)) << 57] + [7 << 50] * 2 for _ in range(size)]
            entries |= {(first + i, key) for i, part in enumerate(parts) for key in part}
            columns = [pa.array(range(first, first + size), pa.int64()), pa.array(np.zeros(size, np.int64)), pa.array(np.ones(size, np.int32)), pa.array(parts, pa.list_(pa.int64()))]
            batches.append(pa.record_batch(columns, ["no", "simhash", "n_words", "parts"]))
        dealt = [row for batch in line_dedup._dealt(True, 6)(iter(batches)) for row in batch.to_pylist()]
        # of a key that all classes have a stand-in a batch goes to the bucket
        assert sum(row["key"].count(7 << 50) for row in dealt if not row["sure"]) == len(batches)
        met = []
        for bucket in range(6):
            rows = pa.RecordBatch.from_pylist([x for x in dealt if x["bucket"] == bucket], schema=pa.schema([("bucket", pa.int32()), ("sure", pa.bool_()), ("no", pa.list_(pa.int64())), ("key", pa.list_(pa.int64()))]))
            met += [(r["no"], r["key"]) for batch in line_dedup._met(iter([rows])) for r in batch.to_pylist()]
        count = {key: sum(k == key for _, k in entries) for _, key in entries}
        assert len(met) == len(set(met))
        assert {x for x in met if count[x[1]] > 1} == {x for x in entries if count[x[1]] > 1}
        assert set(met) <= entries


def test_sorted_rows_fall_into_groups_over_batches():
    rng = np.random.default_rng(6)
    key = np.sort(rng.integers(0, 9, 50))
    batches = [pa.record_batch([pa.array(key[a:b]), pa.array(np.arange(a, b))], ["key", "x"]) for a, b in ((0, 13), (13, 13), (13, 14), (14, 50))]
    groups = [(set(g["key"].to_pylist()), g["x"].to_pylist()) for g in line_dedup._groups(iter(batches), ["key"])]
    assert groups == [({k}, np.flatnonzero(key == k).tolist()) for k in np.unique(key).tolist()]
