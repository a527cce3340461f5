"""Exact top-k search by integer inner product (operator 5): MaxScore.

Components are the query's terms. A shard's candidates are dealt to chunks of similar vectors (the
same nearest pivot); a term's posting list in a chunk is the column of that component, its bound the most
it can add to a score there, from the column's largest and smallest value. A query goes to the chunks
in falling order of the sum of its bounds. With the k-th best score so far as threshold, the terms whose bounds together
cannot reach it are non-essential: only the other lists are traversed for all candidates of the chunk, and
non-essential lists are probed one by one, largest bound first, for the candidates that can still
compete. From the first chunk whose bounds cannot reach the threshold at all, none is opened. Results of shards are merged.

The stated query set meets all rows in blocks: candidates are dealt to shards by hash, queries to
blocks of QUERY_BLOCK, and each (block, shard) pair is one task's group of bounded size.

Defined results: rows with a null id or vector, or with a null or non-finite component, take no
part; missing components of shorter vectors count as 0; a query's own row is any row of its id; of
repeated rows each is a candidate; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavefield.llm.common import table

K, SCALE, EVERY = 10, 1024, 100
#: Candidates in a shard and queries in a block, about; candidates in a chunk at most, and on average.
SHARD, QUERY_BLOCK, CHUNK, NEAR = 16_384, 8_192, 2_048, 512
SCHEMA = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as floor(SCALE * x), of the rows that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    return vectors.where(F.col("vec_id").isNotNull() & finite).select("vec_id", whole.alias("v"))


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(rows.offsets.to_numpy())
    flat, width = rows.flatten().to_numpy(zero_copy_only=False), max(width, int(sizes.max(initial=0)))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(int)] = flat
    return out


class TopK:
    """The k best of a query so far: higher scores first, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def threshold(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]


class Chunk:
    """Candidates with their posting lists (one row per term) and the ends of each list's values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.postings = ids, np.ascontiguousarray(vectors.T)
        self.high, self.low = self.postings.max(axis=1), self.postings.min(axis=1)


def chunks(ids: np.ndarray, vectors: np.ndarray, size: int = CHUNK, near: int = NEAR) -> list[Chunk]:
    """The candidates by nearest pivot (every near-th one is a pivot), in parts of at most size rows."""
    pivots = vectors[::near].astype(np.float64)
    middle = (pivots * pivots).sum(axis=1) / 2
    nearest = np.concatenate([np.argmax(vectors[at : at + 1_024] @ pivots.T - middle, axis=1) for at in range(0, len(ids), 1_024)])
    order = np.argsort(nearest, kind="stable")
    ends = np.flatnonzero(np.diff(nearest[order])) + 1
    groups = np.split(order, ends)
    return [Chunk(ids[g[at : at + size]], vectors[g[at : at + size]]) for g in groups for at in range(0, len(g), size)]


def search(query: np.ndarray, query_id: int, chunk: Chunk, bounds: np.ndarray, top: TopK) -> int:
    """Adds to top what a chunk has; gives the number of products. bounds: the most that each term adds
    to a score in this chunk."""
    order = np.argsort(-bounds, kind="stable")
    left = np.concatenate([[0], np.cumsum(bounds[order][::-1])])[::-1]  # left[i]: bound of order[i:]
    threshold = top.threshold()
    # essential: as many terms as it takes for the rest to stay below the threshold
    below = np.flatnonzero(left < threshold) if threshold is not None else []
    essential = int(below[0]) if len(below) else len(order)
    if not essential:
        return 0
    alive = np.flatnonzero(chunk.ids != query_id)
    scores = (query[order[:essential]] @ chunk.postings[order[:essential]])[alive]
    products = essential * len(chunk.ids)
    for i in range(essential, len(order)):
        able = scores + left[i] >= threshold
        if not able.all():
            alive, scores = alive[able], scores[able]
            if not len(alive):
                return products
        scores = scores + query[order[i]] * chunk.postings[order[i], alive]
        products += len(alive)
    if threshold is not None:
        able = scores >= threshold
        alive, scores = alive[able], scores[able]
    top.add(scores.astype(np.int64), chunk.ids[alive])
    return products


def search_all(query: np.ndarray, query_id: int, parts: list[Chunk], bounds: np.ndarray, top: TopK) -> int:
    """Adds to top what all chunks have; bounds: a row per chunk. Gives the number of products."""
    most, products = bounds.sum(axis=1), 0
    for k in np.argsort(-most, kind="stable"):
        threshold = top.threshold()
        if threshold is not None and most[k] < threshold:
            break  # so are all that follow
        products += search(query, query_id, parts[k], bounds[k], top)
    return products


def _shard_search(k: int):
    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])
        if not queries.num_rows or not candidates.num_rows:
            return none
        q = _matrix(queries["v"])
        c = _matrix(candidates["v"], q.shape[1])
        q = np.pad(q, ((0, 0), (0, c.shape[1] - q.shape[1])))
        if c.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**52:
            q, c = q.astype(np.float64), c.astype(np.float64)  # exact, and faster
        query_ids, ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
        tops, parts = [TopK(k) for _ in query_ids], chunks(ids, c)
        high, low = (np.array([getattr(x, end) for x in parts]) for end in ("high", "low"))
        for i, top in enumerate(tops):
            search_all(q[i], query_ids[i], parts, np.maximum(q[i] * high, q[i] * low), top)
        return pa.table(
            [pa.array(np.repeat(query_ids, [len(t.ids) for t in tops])), pa.array(np.concatenate([t.ids for t in tops])), pa.array(np.concatenate([t.scores for t in tops]))],
            ["query_id", "vec_id", "score"],
        )

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """The k best candidates (vec_id, v) of each query (vec_id, v), own ids left out: query_id, rank,
    vec_id, score."""
    shards = max(1, math.ceil(candidates.count() / SHARD))
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", numbers(shards))
    all_rows = candidates.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("block", numbers(blocks))
    found = mine.groupBy("block", "shard").cogroup(all_rows.groupBy("block", "shard")).applyInArrow(_shard_search(k), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


QUERIES = {"op5_top_k": op5_top_k}
ORACLES = {
    "op5_top_k": f"""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM u q JOIN u c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
}
