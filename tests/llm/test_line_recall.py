"""Line deduplication finds what a search over all pairs by edit similarity alone finds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wavefield.llm import line_dedup

SF = "/root/testdata/sf0.001"


def _forms(texts):
    table = line_dedup._NORMAL.tobytes()
    lines = (x for t in texts for x in (t or "").lower().encode().split(b"\n"))
    return sorted({b" ".join(filter(None, x.translate(table).split(b" "))).decode() for x in lines} - {""}, key=len)


def _all_pairs(forms):
    """Pairs of edit similarity 0.8 or more; only counts of characters rule pairs out beforehand."""
    size = np.array([len(x) for x in forms])
    count = np.array([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % 64, minlength=64) for x in forms])
    for i in range(len(forms)):
        limit, first = int(0.2 * size[i] + 1e-9), int(np.searchsorted(size, 0.8 * size[i] - 1e-6))
        more = count[first:i] - count[i]
        able = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1)) <= limit
        for j in np.flatnonzero(able) + first:
            if line_dedup.edit_distance(forms[j], forms[i], limit) <= limit:
                yield j, i


def test_recall_over_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forms = _forms(r["text"] for r in docs.collect())
    alone = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    group = {r["doc_id"]: r["group_id"] for r in line_dedup.line_groups(alone, word_parts=True).collect()}
    pairs = list(_all_pairs(forms))
    assert len(pairs) > 20
    assert sum(group[i] == group[j] for i, j in pairs) >= 0.9 * len(pairs)
    # nothing else is linked: groups are no larger than the components of all pairs
    root = list(range(len(forms)))
    for i, j in pairs:
        old, new = max(root[i], root[j]), min(root[i], root[j])
        root = [new if x == old else x for x in root]
    first = {}
    assert all(first.setdefault(group[i], root[i]) == root[i] for i in range(len(forms)))


def test_short_lines_meet(spark):
    rows = [(1, "home page"), (2, "home pace"), (3, "contact us now"), (4, "contacts us now"), (5, "ab cd"), (6, "ax cd"), (7, "ab"), (8, "ac")]
    got = {r["doc_id"]: r["kept"] for r in line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string"), word_parts=True).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: True}


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    same = "a line that stands in both of the documents"
    rows = [(7, f"seven gamma text one\n{same}"), (7, "seven delta text two\nanother unique line that must stay in place"), (8, f"eight epsilon text three\n{same}")]
    rows += [(None, f"no id at all here\n{same}"), (None, "another text without an id\nwhose second line is its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["text"] for r in line_dedup.stage(spark, docs, "").collect()}
    assert got == {"seven gamma text one", rows[1][1], "eight epsilon text three", rows[3][1], rows[4][1]}


def test_hot_keys_give_the_same_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = lambda *limits: {(r["doc_id"], r["line_no"]): (r["group_id"], r["kept"]) for r in line_dedup.line_groups(docs, *limits, word_parts=True).collect()}
    assert groups() == groups(1, 2)


def test_very_long_lines(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(6_000)]
    other = list(words)
    other[3_000] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))]
    got = {r["doc_id"]: r["kept"] for r in line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string"), word_parts=True).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_repeated_keys_over_batches():
    rng = np.random.default_rng(0)
    for _ in range(50):
        key = np.sort(rng.integers(0, 30, rng.integers(1, 40)))
        cuts = np.sort(rng.integers(0, len(key), 4))
        batches = [pa.record_batch([pa.array(np.arange(a, b)), pa.array(key[a:b])], ["no", "key"]) for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True)]
        got = [x for batch in line_dedup._repeated(iter(batches)) for x in batch.column("no").to_pylist()]
        assert got == [i for i in range(len(key)) if i in (0, len(key) - 1) or (key == key[i]).sum() > 1]
    assert not list(line_dedup._repeated(iter([])))
