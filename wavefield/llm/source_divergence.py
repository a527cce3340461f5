"""Source divergence audit (operator 13): duplicate-text collapse and sparse pair evaluation.

Which sources of a language differ in their words, and by which words. Identical texts of a language become
one row with the number of its rows by source: first within a task's buffer, before anything is
shuffled, then over the whole table, so that a text is tokenized once and a group of very many copies sends a
row per buffer. The text's terms are counted once and enter the counts of each of its sources as often as
the source has the text; numbers of documents likewise. Counts go on as one row per term, language and
task, with lists of sources.

With count c of a term in a group of N occurrences of the language's V kept terms, p = 1 + floor(UNIT (c + 2) / (N + 2 V)); two
values differ by f(p, q) = floor((p - q)^2 / (p + q)). The sum of f over all V terms is V f(b, b') for the bases b, b' (of
count 0), plus corrections for the terms that occur in one group or in both. Corrections are summed in
cells: terms are cut into slices and a language's sources into blocks of BLOCK; a task gets the entries of two blocks in one
slice, so that neither a frequent term nor a language with very many sources lands in one task. All is
integer arithmetic: quotients in decimals, sums in 64 bits.

Defined results: a null text, lang or source is ''; a group without terms has its pairs, with count 0 for all terms; a
language without kept terms has pairs of value 0 and no terms; an only source has no pairs; repeated rows all
count; an empty table gives no rows; extra columns are ignored. Terms of a task's counts are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavefield.functions.shared import if_small
from wavefield.llm.common import stored, table
from wavefield.llm.textbytes import BLOCK as TEXT_BYTES
from wavefield.llm.textbytes import LOWER, joined, mixed, words

#: A term is kept in a language where so many of its documents have it; terms listed per group; what p is a share of.
LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Bytes of texts collapsed before the shuffle; entries counted before they are sent on.
COLLAPSE_BYTES, ENTRIES = 32 << 20, 1 << 20
#: Sources in a block, entries of a block in a slice (about), pairs looked at together.
BLOCK, SLICE, PAIRS = 128, 100_000, 1 << 20

#: Bytes of no term: \x00-\x40, \x5B-\x60, \x7B-\x7F.
_BETWEEN = np.ones(256, bool)
_BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)

COLLAPSED = "lang string, text string, sources array<string>, counts array<long>"
COUNTED = "lang string, term string, docs long, sources array<string>, counts array<long>"


def _collapse(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """One row per language and text of a buffer of limit bytes."""
    seen: dict[tuple[str, str], dict[str, int]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        each = list(seen.values())
        return pa.record_batch(
            [pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.string()), pa.array([list(x) for x in each], pa.list_(pa.string())), pa.array([list(x.values()) for x in each], pa.list_(pa.int64()))],
            ["lang", "text", "sources", "counts"],
        )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            mine = seen.get((lang, text))
            if mine is None:
                mine = seen[lang, text] = {}
                size += len(text) + 200
            mine[source] = mine.get(source, 0) + 1
            if size > limit:
                yield flush()
                seen.clear()
                size = 0
    if seen:
        yield flush()


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place of the first of each key, and the values' sums by key."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order[at], *(np.add.reduceat(x[order], at) if len(at) else x for x in values)


class Counts:
    """Occurrences and documents by language, source and term of weighted texts."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.terms: dict[int, bytes] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.entries = 0

    def add(self, langs: list[str], texts: list[bytes], sources: list[dict[str, int]]) -> None:
        buf, at = joined(texts)
        buf = LOWER[buf]
        starts, ends, h = words(buf, _BETWEEN[buf])
        text_of = np.searchsorted(at, starts, "right") - 1
        first, n = _summed(mixed(h + text_of.astype(np.uint64) * _STEP), np.ones(len(h), np.int64))
        text_of, h = text_of[first], h[first]
        own, place = np.unique(h, return_index=True)
        for x, i in zip(own.tolist(), first[place].tolist(), strict=True):
            if x not in self.terms:
                self.terms[x] = buf[starts[i] : ends[i]].tobytes()
        # a row per source of the text
        number = np.array([self.groups.setdefault((lang, s), len(self.groups)) for lang, x in zip(langs, sources, strict=True) for s in x], np.int64)
        times = np.array([k for x in sources for k in x.values()], np.int64)
        many = np.array([len(x) for x in sources], np.int64)
        begin = np.cumsum(many) - many
        repeat = many[text_of]
        which = np.repeat(begin[text_of] - (np.cumsum(repeat) - repeat), repeat) + np.arange(repeat.sum())
        self._put(number[which], np.repeat(h, repeat), np.repeat(n, repeat) * times[which], times[which])

    def _put(self, group: np.ndarray, h: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        first, n, docs = _summed(mixed(h + group.astype(np.uint64) * _STEP), n, docs)
        self.parts.append((group[first], h[first], n, docs))
        self.entries += len(first)
        if self.entries > ENTRIES and len(self.parts) > 1:
            whole = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.entries = [], 0
            self._put(*whole)

    def batch(self) -> pa.RecordBatch:
        """A row per language and term."""
        group, h, n, docs = (np.concatenate([x[i] for x in self.parts]) if self.parts else np.zeros(0, np.int64) for i in range(4))
        if len(self.parts) > 1:
            first, n, docs = _summed(mixed(h + group.astype(np.uint64) * _STEP), n, docs)
            group, h = group[first], h[first]
        names = list(self.groups)
        langs: dict[str, int] = {}
        lang_of = np.array([langs.setdefault(lang, len(langs)) for lang, _ in names], np.int64)
        lang = lang_of[group] if len(group) else group
        order = np.lexsort((h, lang))
        group, h, n, docs, lang = group[order], h[order], n[order], docs[order], lang[order]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])])) if len(h) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(at, len(h)), pa.int32())
        lists = [pa.array([x for _, x in names], pa.string()).take(pa.array(group)), pa.array(n)]
        columns = [
            pa.array(list(langs), pa.string()).take(pa.array(lang[at])), pa.array([self.terms[x].decode() for x in h[at].tolist()], pa.string()),
            pa.array(np.add.reduceat(docs, at) if len(at) else docs), *[pa.ListArray.from_arrays(offsets, x) for x in lists],
        ]
        return pa.record_batch(columns, ["lang", "term", "docs", "sources", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of texts that arrive in order, equal ones one after the other."""
    counts, size, last = Counts(), 0, None
    langs: list[str] = []
    texts: list[bytes] = []
    sources: list[dict[str, int]] = []
    for batch in batches:
        for lang, text, names, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "sources", "counts")), strict=True):
            if (lang, text) != last:
                if size > TEXT_BYTES:
                    counts.add(langs, texts, sources)
                    langs, texts, sources, size = [], [], [], 0
                    if counts.entries > ENTRIES:
                        yield counts.batch()
                        counts.clear()
                last = lang, text
                langs.append(lang)
                texts.append(text.encode("utf-8", "surrogatepass"))
                sources.append({})
                size += len(texts[-1])
            for name, k in zip(names, times, strict=True):
                sources[-1][name] = sources[-1].get(name, 0) + k
    if texts:
        counts.add(langs, texts, sources)
        yield counts.batch()


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, of any size."""
    wide = lambda x: x.cast("decimal(19,0)")
    return (1 + F.call_function("div", wide(count + 2) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + 2 * kept))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    square = (p - q) * (p - q)
    return F.when(p == q, F.lit(0)).otherwise(F.call_function("div", square, p + q)).cast("long")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def corrections(owner: np.ndarray, term: np.ndarray, p: np.ndarray, base: np.ndarray, volume: int = PAIRS) -> np.ndarray:
    """For all pairs of sources (numbers into base): what the sum of f differs from that of the bases alone, by the
    terms given: entries of owner, term and p. Symmetric but for the diagonal, which has no meaning."""
    k = len(base)
    rest = _f(base[:, None], base[None, :])
    one = np.zeros((k, k), np.int64)
    pairs, times = np.unique(np.stack([owner, p], axis=1), axis=0, return_counts=True)
    step = max(1, volume // max(k, 1))
    for a in range(0, len(pairs), step):
        mine, value, n = pairs[a : a + step, 0], pairs[a : a + step, 1], times[a : a + step]
        at = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        one[mine[at]] += np.add.reduceat((_f(value[:, None], base[None, :]) - rest[mine]) * n[:, None], at, axis=0)
    order = np.argsort(term, kind="stable")
    owner, term, p = owner[order], term[order], p[order]
    at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(term)))
    both, done = np.zeros(k * k, np.int64), 0
    so_far = np.cumsum(size * size)
    while done < len(at):  # some terms with all pairs of their sources
        end = max(done + 1, int(np.searchsorted(so_far, (so_far[done - 1] if done else 0) + volume, "right")))
        many = np.repeat(size[done:end], size[done:end])
        x = np.repeat(np.arange(at[done], at[done] + len(many)), many)
        y = np.repeat(np.repeat(at[done:end], size[done:end]) - (np.cumsum(many) - many), many) + np.arange(many.sum())
        i, j = owner[x], owner[y]
        value = _f(p[x], p[y]) - _f(p[x], base[j]) - _f(base[i], p[y]) + rest[i, j]
        # below 2**53 in all: exact in doubles
        both += np.bincount(i * k + j, weights=value, minlength=k * k).astype(np.int64)
        done = end
    return one + one.T + both.reshape(k, k)


def _cell(key: tuple, sources: pa.Table, entries: pa.Table, block: int) -> pa.Table:
    """Corrections of the pairs of two blocks of sources by one slice of terms."""
    lang, _, a, b = (x.as_py() for x in key)
    number = sources["number"].to_numpy()
    order = np.argsort(number)
    number, base = number[order], sources["base"].to_numpy()[order]
    owner = np.searchsorted(number, entries["number"].to_numpy())
    _, term = np.unique(entries["term_id"].to_numpy(), return_inverse=True)
    sums = corrections(owner, term, entries["p"].to_numpy(), base)
    i, j = np.nonzero(np.triu(np.ones(sums.shape, bool), 1) & ((number[:, None] // block == a) & (number[None, :] // block == b)))
    return pa.table([pa.array([lang] * len(i), pa.string()), pa.array(number[i]), pa.array(number[j]), pa.array(sums[i, j])], ["lang", "i", "j", "more"])


def count_terms(docs: DataFrame, buffer: int = COLLAPSE_BYTES) -> DataFrame:
    """lang, term, source, n of the kept terms, with total (the language's count) and first (true once a term)."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    collapsed = docs.select(text("lang"), text("source"), text("text")).mapInArrow(lambda batches: _collapse(batches, buffer), COLLAPSED)
    key = F.xxhash64("lang", "text")
    together = collapsed.withColumn("key", key).repartition("key").sortWithinPartitions("key", "lang", "text").drop("key")
    term = Window.partitionBy("lang", "term")
    counted = together.mapInArrow(_count, COUNTED).repartition("lang", "term").withColumn("docs", F.sum("docs").over(term)).where(F.col("docs") >= LEAST_DOCS)
    flat = counted.select("lang", "term", F.inline(F.arrays_zip("sources", "counts")).alias("source", "n")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return flat.withColumn("total", F.sum("n").over(term)).withColumn("first", F.col("source") == F.min("source").over(term))


def _pairs(kept: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """lang, source, item, value of all pairs of sources of a language."""
    others = lambda: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cell = lambda df: df.withColumn("other", others()).withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
    numbered = groups.where("kept > 0").select("lang", "source", "number", "base", "blocks", "slices", F.expr(f"number div {block}").alias("block"))
    entries = kept.select("lang", "source", "p", F.xxhash64("term").alias("term_id")).join(if_small(numbered), ["lang", "source"])
    entries = cell(entries.withColumn("slice", F.pmod("term_id", "slices"))).select("lang", "slice", "a", "b", "number", "term_id", "p")
    sources = cell(numbered.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))).select("lang", "slice", "a", "b", "number", "base")
    by = ["lang", "slice", "a", "b"]
    cells = sources.groupBy(*by).cogroup(entries.groupBy(*by)).applyInArrow(lambda key, x, y: _cell(key, x, y, block), "lang string, i long, j long, more long")
    more = cells.groupBy("lang", "i", "j").agg(F.sum("more").alias("more"))
    x = groups.select("lang", "source", "kept", F.col("number").alias("number_x"), F.col("base").alias("base_x"))
    y = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("number_y"), F.col("base").alias("base_y"))
    both = x.join(y, (x["lang"] == y["lang"]) & (F.col("number_x") != F.col("number_y"))).drop(y["lang"])
    both = both.withColumn("i", F.least("number_x", "number_y")).withColumn("j", F.greatest("number_x", "number_y")).join(more, ["lang", "i", "j"], "left")
    value = F.when(F.col("kept") > 0, F.col("kept") * divergence(F.col("base_x"), F.col("base_y")) + F.coalesce("more", F.lit(0))).otherwise(F.lit(0))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))


def audit(docs: DataFrame, block: int = BLOCK, slice_size: int = SLICE, buffer: int = COLLAPSE_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has a source's divergence from each other one of its language,
    part `term` the TOP terms that are more frequent in the source than in its language."""
    kept = stored(count_terms(docs, buffer), "terms")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("kept"), F.sum("n").alias("lang_total"), F.count("*").alias("entries"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", none("group_total"), none("kept"), none("lang_total"), none("entries"))
    in_lang = Window.partitionBy("lang")
    groups = groups.withColumn("number", (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long"))
    groups = groups.withColumn("blocks", F.expr(f"(count(*) over (partition by lang) + {block - 1}) div {block}"))
    groups = groups.withColumn("slices", F.expr(f"entries div ({slice_size} * blocks) + 1"))
    groups = stored(groups.withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0), F.col("group_total"), F.col("kept"))).otherwise(F.lit(1).cast("long"))), "groups")

    with_p = kept.join(if_small(groups.select("lang", "source", "group_total", "lang_total", "kept")), ["lang", "source"])
    with_p = with_p.withColumn("p", share(F.col("n"), F.col("group_total"), F.col("kept"))).withColumn("q", share(F.col("total"), F.col("lang_total"), F.col("kept")))
    terms = with_p.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = _pairs(with_p, groups, block).withColumn("rank", rank)
    return pairs.unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= TOP))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_P = "1 + 1000000000::HUGEINT * ({} + 2) // ({} + 2 * v)"
_F = "(({0}) - ({1})) * (({0}) - ({1})) // (({0}) + ({1}))"
QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {
    "op13_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM lt GROUP BY lang),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, v FROM l) USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format("coalesce(c.n, 0)", "g.total")} AS p
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lt.lang, lt.term, {_P.format("lt.n", "l.total")} AS q FROM lt JOIN l ON l.lang = lt.lang),
s AS (SELECT x.lang, x.source, y.source AS item, sum({_F.format("x.p", "y.p")}) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ({_F.format("p", "q")})::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
}
