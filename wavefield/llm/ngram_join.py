"""N-gram Jaccard self-join (operator 4): rare-first prefix filtering.

Texts with equal sets of word shingles (three words in the query, five in the stage) form one class, found by a digest. All shingles have one
order, rare ones first: by their total count in a hashed table of fixed size (2**ORDER_BITS numbers,
counted over all documents), then by hash. Two sets that link share a shingle among the first
n - ceil(t n) + 1 (t the threshold, 0.9 for the query) of each (the prefix). Prefix shingles of two or more classes give posting lists:

- A list of at most SMALL classes gives pairs, under length and position filters. A pair is
  brought together once over all lists, passes a suffix filter (counts of shingles by hash segment
  bound the overlap) and is verified once on the full sets.
- A longer list is cut into blocks of about BLOCK classes; each pair of blocks is one task's group
  and carries the sets, and overlaps of a whole group come from one matrix product. A pair
  is verified in the list of its first common prefix shingle only, and not at all if a small list has
  it. What comes out is one row per class: its links' number and one link of a spanning forest.

So no list emits all its pairs, no link is lost, and links are counted exactly.

Words are `[^\\x20\\x09-\\x0D]+` after lowering A-Z. Defined results: a text without words (or null)
has an empty set, is linked with nothing and is a component of its own; fewer words than a shingle make one
shingle; rows with equal texts are linked; rows of one doc_id are rows of their own, and a component
takes the smallest id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefield.llm.common import WORD, discard, stored, table
from wavefield.llm.graph import components
from wavefield.llm.textbytes import IS_SPACE, LOWER, blocks, joined, mixed, words

N = 3
#: Texts link when LINK[1] * overlap >= LINK[0] * union.
LINK = (90, 100)
#: The pipeline's stage: shingles of five words, Jaccard 0.8.
STAGE_N, STAGE_LINK = 5, (80, 100)
ORDER_BITS, SLICES, SEGMENTS = 20, 64, 64
SMALL, BLOCK = 64, 256

#: Factors by place in a shingle, of at most 15 words.
_POWERS = mixed(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def shingles(run: list[bytes], length: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of length words of a run of texts, and where each text's begin (one more at the end)."""
    raw, at = joined(run)
    buf = LOWER[raw]
    starts, _, h = words(buf, IS_SPACE[buf])
    first = np.searchsorted(starts, at)  # first word of each text
    n = np.diff(first)
    padded = np.concatenate([h, np.zeros(length, np.uint64)])
    each = sum(padded[i : i + len(h)] * _POWERS[i] for i in range(length)) if len(h) else h
    each = mixed(each)
    count = np.where(n >= length, n - length + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    # positions of first words of shingles
    index = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    out = each[index]
    for i in np.flatnonzero((n > 0) & (n < length)):
        few = h[first[i] : first[i + 1]] * _POWERS[: n[i]]
        out[begin[i]] = mixed(few.sum(keepdims=True) + np.array([n[i]], np.uint64) * _POWERS[length])[0]
    return out, begin


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def count_buckets(docs: DataFrame, length: int = N) -> np.ndarray:
    """How often shingles of each bucket occur in all documents: a table of fixed size."""
    width = (1 << ORDER_BITS) // SLICES

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for _, run in blocks(batch.column("text").to_pylist()):
                total += np.bincount(bucket(shingles(run, length)[0]), minlength=len(total))
        if total.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(SLICES, width)]
            yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                found = np.frombuffer(zlib.decompress(part), np.int64)
                sums[k] = sums[k] + found if k in sums else found
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    parts = docs.select("text").mapInArrow(partial, schema).repartition("slice").mapInArrow(whole, schema).collect()
    out = np.zeros((SLICES, width), np.int64)
    for x in parts:
        out[x["slice"]] = np.frombuffer(x["counts"], np.int64)
    return out.ravel()


def prefix_size(n: int, link: tuple[int, int] = LINK) -> int:
    return n - -(-link[0] * n // link[1]) + 1


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, link: tuple[int, int] = LINK) -> np.ndarray:
    return link[1] * overlap >= link[0] * (a + b - overlap)


def _digest(unique: np.ndarray) -> bytes:
    """16 bytes that stand for a set (its sorted hashes)."""
    place = np.arange(1, len(unique) + 1, dtype=np.uint64)
    two = [np.add.reduce(mixed(unique * p + place)) for p in _POWERS[:2]]
    return np.array(two, ">u8").tobytes()


def _sets(run: list[bytes], length: int) -> Iterator[np.ndarray]:
    hashes, at = shingles(run, length)
    for a, b in zip(at, at[1:], strict=False):
        yield np.unique(hashes[a:b])


def _prefixes(order, length: int, link: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in batches:
            for first, part in blocks(batch.column("text").to_pylist()):
                n, cid, prefix, segments = [], [], [], []
                for s in _sets(part, length):
                    n.append(len(s))
                    segments.append(np.bincount((s >> np.uint64(8)).astype(np.int64) % SEGMENTS, minlength=SEGMENTS).astype(np.uint32).tobytes())
                    cid.append(_digest(s))
                    keep = np.lexsort((s, counts[bucket(s)]))[: prefix_size(len(s), link)] if len(s) else []
                    prefix.append(s[keep].view(np.int64))
                yield pa.record_batch(
                    [batch.column("doc_id").slice(first, len(part)), batch.column("row_key").slice(first, len(part)), batch.column("row_check").slice(first, len(part)), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(segments, pa.binary())],
                    ["doc_id", "row_key", "row_check", "n", "cid", "prefix", "segments"],
                )

    return run


PAYLOAD = "no long, n long, w long, shared array<long>, df array<long>, grams binary"


def _payload(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The sets of candidate classes; a row whose text is not the class's own (keys that collide) goes."""
    for batch in batches:
        cids = batch.column("cid").to_pylist()
        for first, run in blocks(batch.column("text").to_pylist()):
            keep, grams = [], []
            for i, s in enumerate(_sets(run, length)):
                if _digest(s) == cids[first + i]:
                    keep.append(first + i)
                    grams.append(s.tobytes())
            part = batch.take(pa.array(keep, pa.int32()))
            yield pa.record_batch([*[part.column(c) for c in ("no", "n", "w", "shared", "df")], pa.array(grams, pa.binary())], [x.split()[0] for x in PAYLOAD.split(", ")])


def _suffix_filter(batches: Iterator[pa.RecordBatch], link: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SEGMENTS) for c in ("segments_x", "segments_y"))
        most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
        able = linked(most, batch.column("n_x").to_numpy(), batch.column("n_y").to_numpy(), link)
        yield batch.filter(pa.array(able)).select(["x", "y"])


def _verify(batches: Iterator[pa.RecordBatch], link: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("grams_x"), batch.column("grams_y")
        keep = []
        for i in range(batch.num_rows):
            a, b = np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)
            overlap = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(bool(linked(overlap, len(a), len(b), link)))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y", "w_x", "w_y"])


def overlaps(sets: list[np.ndarray], columns: int = 4_096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    flat, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    some = shared[column]
    column, owner = rank[column[some]], owner[some]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    for a in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(column, [a, a + columns])
        matrix = np.zeros((m, columns), np.float32)
        matrix[owner[lo:hi], column[lo:hi] - a] = 1
        out += matrix @ matrix.T
    return np.rint(out).astype(np.int64)


def _cell(key: tuple, group: pa.Table, small: int, limit: tuple[int, int]) -> pa.Table:
    """Links within one pair of blocks of a long list: per class its links' weight, and one link."""
    token = np.int64(key[0].as_py())
    rows = {c: i for i, c in enumerate(group["no"].to_pylist())}  # a class once
    keep = sorted(rows.values())
    no = group["no"].to_numpy()[keep]
    n, w = group["n"].to_numpy()[keep], group["w"].to_numpy()[keep]
    block = group["block"].to_numpy()[keep]
    sets = [np.frombuffer(group["grams"][i].as_py(), np.uint64) for i in keep]
    earlier = []
    for i in keep:
        shared, df = np.array(group["shared"][i].as_py(), np.int64), np.array(group["df"][i].as_py(), np.int64)
        at = int(np.flatnonzero(shared == token)[0])
        earlier.append(shared[(df <= small) | (np.arange(len(shared)) < at)].view(np.uint64))
    link = linked(overlaps(sets), n[:, None], n[None, :], limit) & (overlaps(earlier) == 0)
    np.fill_diagonal(link, False)
    if key[1] != key[2]:
        link &= block[:, None] != block[None, :]
    root = np.arange(len(no))
    while True:  # every row takes the smallest root among its links
        new = np.minimum(root, np.where(link, root[None, :], len(no)).min(axis=1, initial=len(no)))
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(link.any(axis=1))
    return pa.table([pa.array(no[some]), pa.array(no[root[some]]), pa.array((link @ w)[some].astype(np.int64))], ["x", "y", "weight"])


def with_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The text of each chosen class, one row a class: texts meet by key and not by id, and equal rows are one after
    partial aggregation, before they are shuffled."""
    key = ["row_key", "row_check"]
    return docs.groupBy(*key).agg(F.first("text").alias("text")).join(chosen, key).select("no", "cid", "n", "w", "shared", "df", "text")


def link_documents(docs: DataFrame, small: int = SMALL, block: int = BLOCK, length: int = N, link: tuple[int, int] = LINK) -> DataFrame:
    """Texts whose sets of shingles of length words have a Jaccard of link[0] / link[1] or more: doc_id, n_shingles, component_id, class_id (equal sets) and n_links of every row."""
    spark = docs.sparkSession
    # rows of one id and text are the same to what follows; an id alone may have very many texts
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"), F.hash("text").alias("row_check"))
    order = spark.sparkContext.broadcast(count_buckets(docs, length))
    each = stored(docs.mapInArrow(_prefixes(order, length, link), "doc_id long, row_key long, row_check int, n long, cid binary, prefix array<long>, segments binary"), "prefixes")
    classes = each.where("n > 0").groupBy("cid", "n").agg(F.min("doc_id").alias("rep"), F.min(F.struct("row_key", "row_check")).alias("row"), F.count("*").alias("w"), F.first("prefix").alias("prefix"), F.first("segments").alias("segments"))
    # a number for each class, written down with it: short in every table below
    classes = stored(classes.withColumn("no", F.monotonically_increasing_id()), "classes")

    entries = classes.select("no", F.posexplode("prefix").alias("pos", "token"))
    long_enough = entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    lists = stored(entries.join(long_enough, "token"), "lists")
    shared = lists.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "df"))).alias("s"))
    shared = shared.select("no", F.col("s.token").alias("shared"), F.col("s.df").alias("df"), F.size(F.filter("s", lambda x: x["df"] > small)).alias("hot"))
    shared = stored(classes.select("no", "n").join(shared, "no"), "shared")

    # short lists: pairs
    entry = lists.where(F.col("df") <= small).join(shared.select("no", "n", "hot"), "no")
    x = entry.select("token", *[F.col(c).alias(f"{c}_x") for c in ("no", "n", "pos", "hot")])
    y = entry.select("token", *[F.col(c).alias(f"{c}_y") for c in ("no", "n", "pos", "hot")])
    lengths = link[1] * F.least("n_x", "n_y") >= link[0] * F.greatest("n_x", "n_y")
    pairs = x.join(y, (x["token"] == y["token"]) & (F.col("no_x") < F.col("no_y")) & lengths)
    # the first of the short-list shingles in common: long-list ones may come before it
    pairs = pairs.groupBy(F.col("no_x").alias("x"), F.col("no_y").alias("y"), "n_x", "n_y", "hot_x", "hot_y").agg(F.min("pos_x").alias("pos_x"), F.min("pos_y").alias("pos_y"))
    most = F.least("hot_x", "hot_y") + F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    pairs = pairs.where((link[0] + link[1]) * most >= link[0] * (F.col("n_x") + F.col("n_y"))).select("x", "y", "n_x", "n_y")
    side = lambda df, s, *names: df.select(F.col("no").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in names])
    able = pairs.join(side(classes, "x", "segments"), "x").join(side(classes, "y", "segments"), "y")
    able = stored(able.mapInArrow(lambda batches: _suffix_filter(batches, link), "x long, y long"), "pairs")

    # the sets of the classes that are still in play
    hot = lists.where(F.col("df") > small)
    wanted = able.select(F.col("x").alias("no")).unionByName(able.select(F.col("y").alias("no"))).unionByName(hot.select("no")).distinct()
    chosen = classes.select("no", "cid", "w", "row.*").join(wanted, "no").join(shared.drop("hot"), "no")
    payload = stored(with_texts(docs, chosen).mapInArrow(lambda batches: _payload(batches, length), PAYLOAD), "sets")

    verified = able.join(side(payload, "x", "grams", "w"), "x").join(side(payload, "y", "grams", "w"), "y").mapInArrow(lambda batches: _verify(batches, link), "x long, y long, w_x long, w_y long")
    links = stored(verified, "verified")
    discard(able, shared)

    # long lists: pairs of blocks
    number = F.ceil(F.col("df") / block).cast("int")
    in_blocks = hot.select("no", "token", number.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    cells = in_blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("no", "token", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    members = cells.join(payload.select("no", "n", "w", "shared", "df", "grams"), "no")
    in_cells = stored(members.groupBy("token", "a", "b").applyInArrow(lambda key, group: _cell(key, group, small, link), "x long, y long, weight long"), "cells")
    discard(lists, payload)

    roots = components(links.select("x", "y").unionByName(in_cells.select("x", "y")), "x", "y")
    degree = links.select(F.col("x").alias("no"), F.col("w_y").alias("weight")).unionByName(links.select(F.col("y").alias("no"), F.col("w_x").alias("weight")))
    degree = degree.unionByName(in_cells.select(F.col("x").alias("no"), "weight")).groupBy("no").agg(F.sum("weight").alias("degree"))
    reps = classes.select("no", "cid", "rep", "w")
    smallest = roots.join(reps, roots["id"] == reps["no"]).groupBy("root").agg(F.min("rep").alias("smallest"))
    named = roots.join(smallest, "root").select(F.col("id").alias("no"), "smallest").join(degree, "no", "left")
    known = stored(reps.join(named, "no", "left").select("cid", F.coalesce("smallest", "rep").alias("component"), (F.coalesce("degree", F.lit(0)) + F.col("w") - 1).alias("n_links")), "components")
    discard(classes, links, in_cells)
    rows = each.select("doc_id", "n", "cid").join(known, "cid", "left")
    alone = F.col("n") == 0
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(~alone, F.lower(F.hex("cid"))).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents")).drop("class_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each group of linked documents the one with the smallest id stays; rows of
    one id (null ids too) stay or go together."""
    keep = link_documents(docs, length=STAGE_N, link=STAGE_LINK).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id_")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("kept_id_")), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op4_ngram_join": op4_ngram_join}
ORACLES = {
    "op4_ngram_join": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
o AS (SELECT a.rid AS a, b.rid AS b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT a, b FROM o JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE {LINK[1]} * o >= {LINK[0]} * (x.n + y.n - o)),
r(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a),
k AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)"""
}
