"""Periodic runs of words (operator 11): online dyadic square catching.

A run is a stretch of words with smallest period q, of at least LEAST words and EXPONENT periods, that no
neighbouring word extends. Words are appended in portions of any size. Whenever a block of s words (s = BLOCK,
2 BLOCK, 4 BLOCK, ..., at multiples of s) is complete, its earlier occurrences at distances p in [s, 2s) (from 1
on for the smallest s) are looked up by hash: a run of period p has a whole block past its first p words.
An occurrence sets a catcher of period p, which compares words p apart: backwards once, and forwards as words
are appended, until they differ. What it has caught is a run of squares; a later block inside it
meets the same catcher and sets no other.

Three or more occurrences of a block lie in steps of the block's own period q. If the stretch between is of
period q too, they say nothing new. If it is not, two of the distances at most can be a new period: the one
at which both q-periodic stretches begin, or the one at which both end; for the latter a waiting catcher follows
the end of the second stretch. So repeated words do not multiply catchers.

The texts of a few megabytes are one sequence with a border (a word of its own) after each text; a longer text is
a sequence alone. Nothing is shuffled: the operator is one map over the table.

Defined results: a null text, or one without words, has no runs and collapses to an empty text; equal rows give
equal results row by row; an empty table gives no rows; extra columns are ignored. Words
`[^\\x20\\x09-\\x0D]+` are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefield.llm.common import WORD, let, table
from wavefield.llm.textbytes import IS_SPACE, blocks, joined, mixed, words

#: A run has at least so many words, and so many periods.
LEAST, EXPONENT = 24, 3
#: The smallest block: a run of period up to BLOCK keeps 2 BLOCK - 1 words or more past its first period.
BLOCK = LEAST // 3
#: Hashes compared at a time.
AT_ONCE = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)


def first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements the two have in common at their beginnings."""
    size = min(len(a), len(b))
    at, step = 0, 64
    while at < size:
        end = min(size, at + step)
        differ = a[at:end] != b[at:end]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = end, step * 4
    return size


class Catchers:
    """The runs of a sequence of words (64-bit hashes) that grows by append()."""

    def __init__(self) -> None:
        self.words = np.zeros(0, np.uint64)
        #: by level: hash of the BLOCK << level words from each place on, and the place of the first that is kept
        self.hashes: list[np.ndarray] = []
        self.base: list[int] = []
        #: by period: begin and end of the latest stretch; open ones reach the end of the words
        self.latest: dict[int, list[int]] = {}
        self.open: set[int] = set()
        #: second stretches whose end is not seen yet: (block, size, step, end of the first stretch, distances)
        self.waiting: list[tuple[int, int, int, int, set[int]]] = []
        self.caught: dict[tuple[int, int], int] = {}

    def append(self, more: np.ndarray, begins: np.ndarray | None = None) -> None:
        """begins: places of words, from the first one appended on, before which nothing repeats (begins of texts)."""
        old = len(self.words)
        self.words = np.concatenate([self.words, more])
        for p in sorted(self.open):
            self._advance(p)
        waiting, self.waiting = self.waiting, []
        for x in waiting:
            self._follow(*x, seen=old)
        level = 0
        while BLOCK << level <= len(self.words):
            self._hash(level)
            self._look_up(level, old, begins)
            if level:
                self._forget(level - 1)
            level += 1
        if level:
            self._forget(level - 1)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs so far, by start, then period."""
        for p in sorted(self.open):
            self._keep(p)
        found = [(start, end - start, p) for (start, p), end in self.caught.items() if self._is_smallest(start, end, p)]
        return sorted(found, key=lambda x: (x[0], x[2]))

    def _hash(self, level: int) -> None:
        """Hashes from the first place that has none on."""
        size = BLOCK << level
        done = self.base[level] + len(self.hashes[level]) if level < len(self.hashes) else 0
        if level:
            half, below = size >> 1, self.hashes[level - 1][done - self.base[level - 1] :]
            new = mixed(below[: len(below) - half] * _STEP + below[half:])
        else:
            new = np.zeros(len(self.words) - size + 1 - done, np.uint64)
            for i in range(size):
                new *= _STEP
                new += self.words[done + i : done + i + len(new)]
            new = mixed(new)
        if done:
            self.hashes[level] = np.concatenate([self.hashes[level], new])
        else:
            self.hashes.append(new)
            self.base.append(0)

    def _forget(self, level: int) -> None:
        """Keeps what later blocks can ask for: the last three blocks' places."""
        gone = len(self.words) - 3 * (BLOCK << level) - self.base[level]
        if gone > 0:
            self.hashes[level] = self.hashes[level][gone:].copy()
            self.base[level] += gone

    def _look_up(self, level: int, old: int, begins: np.ndarray | None) -> None:
        """Sets catchers for the blocks of a level that the words from old on complete."""
        size, h, base = BLOCK << level, self.hashes[level], self.base[level]
        first = -(-max(0, old - size + 1) // size) * size
        at = np.arange(first, len(self.words) - size + 1, size)
        nearest = 1 if level == 0 else size
        past = at if begins is None else at - begins[np.maximum(np.searchsorted(begins, at, "right") - 1, 0)]
        at = at[(past >= nearest) | (past < 0)]
        width = 2 * size - nearest
        rows = max(1, AT_ONCE // width)
        for k in range(0, len(at), rows):
            some = at[k : k + rows]
            # column j: distance 2 size - 1 - j
            before = some[:, None] - 2 * size + 1 + np.arange(width) if len(some) > 1 else np.arange(some[0] - 2 * size + 1, some[0] - nearest + 1)[None, :]
            same = (h[np.maximum(before - base, 0)] == h[some - base][:, None]) & (before >= 0)
            if not same.any():
                continue
            same = same[:, ::-1]  # by rising distance
            if level == 0:
                same = _without_multiples(same)
            row, column = np.nonzero(same)
            ends = np.searchsorted(row, np.arange(len(some) + 1))
            for i in np.flatnonzero(np.diff(ends)):
                distances = column[ends[i] : ends[i + 1]] + nearest
                if level == 0 or len(distances) < 3:
                    for p in distances.tolist():
                        self._catch(int(some[i]), size, p)
                else:
                    self._catch_many(int(some[i]), size, distances, level)

    def _catch(self, at: int, size: int, p: int) -> None:
        """The words of the block at `at` are the same p words before: finds how far that holds."""
        known = self.latest.get(p)
        if known and known[0] <= at - p and at + size <= known[1]:
            return
        if known:
            self._keep(p)
        w = self.words
        back = first_difference(w[:at][::-1], w[: at - p][::-1])
        self.latest[p] = [at - back - p, at + size]
        self.open.add(p)
        self._advance(p)

    def _advance(self, p: int) -> None:
        stretch, w = self.latest[p], self.words
        stretch[1] += first_difference(w[stretch[1] :], w[stretch[1] - p :])
        if stretch[1] < len(w):
            self.open.discard(p)
            self._keep(p)

    def _keep(self, p: int) -> None:
        start, end = self.latest[p]
        if end - start >= max(LEAST, EXPONENT * p):
            self.caught[start, p] = end

    def _catch_many(self, at: int, size: int, distances: np.ndarray, level: int) -> None:
        near, step = int(distances[0]), int(distances[1] - distances[0])
        h, there = self.hashes[level], at - self.base[level]
        if near < size + step and h[there - near + step] == h[there - near] and h[there - step] == h[there]:
            return  # one stretch of the smaller period
        w, here = self.words, at - near
        begin = at - first_difference(w[:at][::-1], w[step : at + step][::-1])
        begin_before = here - first_difference(w[:here][::-1], w[step : here + step][::-1])
        end_before = here + step + first_difference(w[here + step :], w[here:])
        able = set(distances.tolist())
        if begin - begin_before in able:
            self._catch(at, size, begin - begin_before)
        self._follow(at, size, step, end_before, able, seen=at + size)

    def _follow(self, at: int, size: int, step: int, end_before: int, able: set[int], seen: int) -> None:
        """Looks for the end of the stretch around a block from seen on; the catcher of the distance to
        end_before is set there."""
        end = seen + first_difference(self.words[seen:], self.words[seen - step :])
        if end == len(self.words):
            self.waiting.append((at, size, step, end_before, able))
        elif end - end_before in able:
            self._catch(at, size, end - end_before)

    def _is_smallest(self, start: int, end: int, p: int) -> bool:
        """No smaller period: it would divide p, as there are two periods of p at least."""
        left, factor = p, 2
        while left > 1:
            if factor * factor > left:
                factor = left
            if left % factor == 0:
                q = p // factor
                if first_difference(self.words[start + q : end], self.words[start : end - q]) == end - start - q:
                    return False
                while left % factor == 0:
                    left //= factor
            factor += 1
        return True


def _without_multiples(same: np.ndarray) -> np.ndarray:
    """same: whether a block of BLOCK words is found at distance 1, 2, ...; leaves out j q where q, 2q, ..., j q all
    are there: the stretch is of period q."""
    out = same.copy()
    for q in range(1, BLOCK):
        chain = same[:, q - 1].copy()
        for p in range(2 * q, same.shape[1] + 1, q):
            chain &= same[:, p - 1]
            out[:, p - 1] &= ~chain
    return out


def find_runs(run: list[bytes]) -> Iterator[tuple[bytes, int, list[tuple[int, int, int]]]]:
    """(text, number of words, runs as (start, length, period)) of a few texts."""
    buf, at = joined(run)
    starts, _, h = words(buf, IS_SPACE[buf])
    first = np.searchsorted(starts, at)
    count = np.diff(first)
    # a border after each text
    begins = first[:-1] + np.arange(len(run))
    sequence = np.empty(len(h) + len(run), np.uint64)
    border = begins + count
    is_word = np.ones(len(sequence), bool)
    is_word[border] = False
    sequence[is_word] = h
    sequence[border] = mixed(np.arange(1, len(run) + 1, dtype=np.uint64) * _STEP)
    catchers = Catchers()
    catchers.append(sequence, begins)
    mine: list[list[tuple[int, int, int]]] = [[] for _ in run]
    for start, length, period in catchers.runs():
        i = int(np.searchsorted(begins, start, "right")) - 1
        mine[i].append((start - int(begins[i]), length, period))
    yield from zip(run, count.tolist(), mine, strict=True)


def collapse(text: bytes, n: int, runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by blanks, without those that any run holds past its first period."""
    parts = text.split()  # of bytes: at just the six white-space characters
    if runs:
        drop = np.zeros(n, bool)
        for start, length, period in runs:
            drop[start + period : start + length] = True
        parts = [parts[i] for i in np.flatnonzero(~drop).tolist()]
    return b" ".join(parts)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, run in blocks(batch.column("text").to_pylist()):
            n, found, collapsed = [], [], []
            for text, count, runs in find_runs(run):
                n.append(count)
                found.append([{"start": a, "length": b, "period": c} for a, b, c in runs])
                collapsed.append(collapse(text, count, runs).decode())
            yield pa.record_batch(
                [batch.column("doc_id").slice(first, len(run)), pa.array(n, pa.int64()), pa.array(found, _RUNS), pa.array(collapsed, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start, then period) and the collapsed text."""
    return docs.select("doc_id", "text").mapInArrow(_map, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of a tenth of the texts are made periodic from some word on, as the crc32
    of doc_id tells (a null id counts as the text '')."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    w = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    changed = F.when((h % 10 == 0) & (F.length("text") > 0), let(w, lambda x: F.when(F.size(x) > 0, planted(x)).otherwise(F.lit(""))))
    return docs.select("doc_id", F.coalesce(changed, F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # runs are in order: the first of those with the greatest exponent stays
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")])), "\n")
    found = found.withColumn("best", best).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: SQL for the unsigned crc32 of a text of ASCII characters: bit by bit, by the reflected polynomial 0xEDB88320.
def crc32_sql(text: str) -> str:
    bits = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(acc, x))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda y: ascii(y)::BIGINT), lambda acc, x: {bits}, 4294967295::BIGINT), 4294967295)"


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES = {
    # runs: stretches of places i whose eight words are those from i - q on, of any q
    "op11_periodic_runs": f"""
WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    CASE WHEN doc_id IS NULL THEN 0 ELSE {crc32_sql("doc_id::VARCHAR")} END AS h FROM documents),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM d1),
d3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d2),
d AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM d3),
k AS (SELECT rid, i, array_to_string(w[i + 1:i + 8], ' ') AS s FROM (SELECT rid, w, unnest(range(n - 7)) AS i FROM d WHERE n >= {LEAST})),
m AS (SELECT x.rid AS rid, x.i - y.i AS q, x.i AS i FROM k x JOIN k y ON x.rid = y.rid AND x.s = y.s AND y.i < x.i),
t AS (SELECT rid, q, min(i) - q AS start, max(i) + 8 AS stop FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m) GROUP BY rid, q, island),
c AS (SELECT * FROM t WHERE stop - start >= greatest({LEAST}, {EXPONENT} * q)),
r AS (SELECT rid, start, stop - start AS length, q AS period FROM c x
      WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.rid = x.rid AND y.q < x.q AND y.start <= x.start AND y.stop >= x.stop)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM r) WHERE place = 1),
o AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
left_ AS (SELECT d.rid, string_agg(x.word, ' ' ORDER BY x.i) AS text FROM d, LATERAL (SELECT unnest(d.w) AS word, unnest(range(d.n)) AS i) x
          WHERE d.rid IN (SELECT rid FROM r) AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = d.rid AND gone.i = x.i) GROUP BY d.rid)
SELECT d.doc_id, coalesce(o.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
       (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(o.lines, '')) AS runs_sha256,
       sha256(CASE WHEN o.rid IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(left_.text, '') END) AS collapsed_sha256
FROM d LEFT JOIN o USING (rid) LEFT JOIN b USING (rid) LEFT JOIN left_ USING (rid)"""
}
