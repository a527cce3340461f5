"""The source audit against plain counting, on odd rows, and its pair sums against all terms one by one."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from wavefield.llm import source_divergence
from wavefield.llm.source_divergence import corrections

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def f(p, q):
    return (p - q) ** 2 // (p + q)


def plain(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((x or "", y or "", z or "") for x, y, z in rows):
        found = TERM.findall(text.translate(UPPER))
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 10]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, of: 1 + 10**9 * (n + 2) // (of + 2 * len(kept))  # noqa: E731, B023
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", x.decode(), -v, i) for i, (v, x) in enumerate(pairs, 1)]
            out += [(lang, s, "term", x.decode(), -v, i) for i, (v, x) in enumerate(terms[:10], 1)]
    return sorted(out)


def _odd_rows():
    rng = np.random.default_rng(3)
    vocabulary = ["The", "the", "of", "ÉTÉ", "été", "x_y", "a1b", "ß", "naïve", "日本", "w" * 300, *[f"t{chr(97 + i)}" for i in range(20)]]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(vocabulary, int(rng.integers(0, 30)), p=np.linspace(2, 0.1, len(vocabulary)) / np.linspace(2, 0.1, len(vocabulary)).sum()))
        rows.append((["en", "fr", None, ""][i % 4], ["s1", "s2", "s10", None, "é"][int(rng.integers(5))], text))
    rows += [("en", s, "copies of one text, THE same") for s in ("s1", "s2", "s1", "s3") for _ in range(40)]
    rows += [("en", "only nulls", None)] * 3 + [("en", "no terms", "1 2 3")] + [("de", "few", "kurz und gut")] * 4 + [("de", "others", None), ("nl", "alone", "een")]
    return rows + [("it", "long", "parola " * 60_000 + "fine")] * 11 + [("it", "short", "parola")]


def _write(spark, path, rows):
    rows = [(i, *x, 1) for i, x in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, term int").write.parquet(f"{path}/documents.parquet")


def test_query_on_odd_rows(spark, tmp_path):
    rows = _odd_rows()
    _write(spark, tmp_path, rows)
    got = source_divergence.op13_source_divergence(spark, str(tmp_path))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    expected = plain(rows)
    assert sorted(map(tuple, got.collect())) == expected
    # many blocks of sources and slices of terms, many flushes
    assert sorted(map(tuple, source_divergence.audit(spark.read.parquet(f"{tmp_path}/documents.parquet"), block=2, slice_size=3, buffer=1 << 12).collect())) == expected


def test_empty_table(spark, tmp_path):
    _write(spark, tmp_path, [])
    assert source_divergence.op13_source_divergence(spark, str(tmp_path)).count() == 0


def test_corrections_equal_sums_over_all_terms():
    rng = np.random.default_rng(1)
    k, v = 7, 40
    base = rng.integers(1, 10**7, k)
    p = np.where(rng.random((v, k)) < 0.3, rng.integers(1, 10**9, (v, k)), 0)
    term, owner = np.nonzero(p)
    full = np.where(p > 0, p, base)
    got = corrections(owner, term, p[term, owner], base, volume=50)
    for i in range(k):
        for j in range(k):
            if i != j:
                assert v * f(int(base[i]), int(base[j])) + got[i, j] == sum(f(int(a), int(b)) for a, b in zip(full[:, i], full[:, j], strict=True))


def test_equal_texts_are_counted_once(spark):
    """However many copies and sources, a text reaches the counting once."""
    rows = [("en", f"s{i % 3}", "one two three") for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    collapsed = docs.mapInArrow(lambda x: source_divergence._collapse(x, 1 << 20), source_divergence.COLLAPSED).collect()
    assert len(collapsed) <= 8 and sum(sum(x["counts"]) for x in collapsed) == 300
