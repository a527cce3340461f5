"""Lines with typos meet and link, however many SimHash bits they turn."""

from __future__ import annotations

import random

from wavefield.llm import line_dedup


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 8)))


def test_one_letter_changed_at_any_place(spark):
    rng, rows = random.Random(8), []
    for n in (5, 6, 9, 10, 11, 12, 13, 20, 41):
        for at in range(n):
            line = [_word(rng) for _ in range(n)]
            other = list(line)
            other[at] = "z" + other[at][1:]
            rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(other))]
    got = line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string"), word_parts=True).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == {i for i, _ in rows if i % 2 == 0}


def test_word_lost_or_split(spark):
    rng, rows = random.Random(9), []
    for n in (9, 12, 13, 14, 30, 31):
        for at in range(n):
            line = [_word(rng) for _ in range(n)]
            other = line[:at] + line[at + 1 :] if at % 2 or n < 12 else [*line[:at], line[at][:2], line[at][2:], *line[at + 1 :]]
            rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(other))]
    got = line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string"), word_parts=True).collect()
    forms = dict(rows)
    similar = {i for i in range(0, len(rows), 2) if line_dedup.similar(forms[i], forms[i + 1])}
    assert len(similar) > len(rows) / 2 - 20
    assert {r["doc_id"] for r in got if not r["kept"]} == {i + 1 for i in similar}
