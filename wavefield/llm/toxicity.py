"""Toxicity (operator 12): nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are words (runs of bytes of letters, digits or not ASCII; A-Z lowered) and the beginnings of PREFIXES bytes of
longer words, by 64-bit hash. The vocabulary has the terms that go with a label: those whose number of toxic examples lies
Z standard deviations or more from what their number of examples lets expect. A text is the vector of (1 + log count) idf
of its vocabulary terms, to length 1. Its K nearest examples vote with the square of their cosine, times
what undoes the sampling; a logistic curve, fitted to the examples' own votes without themselves, turns the
share of toxic votes into the score. Neighbours are given as evidence. A text without any vocabulary term has no
neighbours: its score is the share of toxic ones among the examples without any.

The index: examples with like vectors are neighbours in blocks of BLOCK; a term's posting list has its largest
weight in each block. The weights times the query's, summed over its terms, bound all scores of a block. Blocks are visited
in falling bound until a bound is below the K-th best cosine so far; so results are those of comparing all.

Learned from: at most SAMPLE documents per label, chosen by hash among labelled rows outside the held-out
fifth, one of equal texts; VOCABULARY terms at most, those furthest from what is expected. Counting the
examples' terms is an aggregation on Spark; only vectors over the vocabulary reach the driver. Scoring is one
map over the table, without a shuffle.

Defined results: a null or empty text has no terms; without examples of both labels every text scores the share of toxic
labels (0 without labels); several labels of one document each count; examples of equal cosine are taken by
place in the index; repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefield.llm.common import discard, stored, table
from wavefield.llm.textbytes import LOWER, blocks, joined, mixed, words

#: Bounds of what is learned from: examples per label, terms.
SAMPLE, VOCABULARY = 3_000, 20_000
Z, LEAST_EXAMPLES = 4.0, 5
PREFIXES = range(4, 9)
K, BLOCK, EVIDENCE = 32, 64, 5
#: What a share of votes starts from, in votes.
PRIOR = 0.05
#: Rounding that a bound may lack.
SLACK = 1e-9
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"

_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False
_FACTORS = mixed(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the rows that no label is learned from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def terms(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text (by place in the run) and hash of every term of a run of texts."""
    buf, at = joined(run)
    buf = LOWER[buf]
    starts, ends, h = words(buf, _BETWEEN[buf])
    text = np.searchsorted(at, starts, "right") - 1
    texts, hashes = [text], [h]
    total, size = np.zeros(len(starts), np.uint64), ends - starts
    for j in range(PREFIXES[-1]):
        longer = size > j
        starts, size, total, text = starts[longer], size[longer], total[longer], text[longer]
        total = total + (buf[starts + j].astype(np.uint64) + np.uint64(1)) * _FACTORS[j]
        if j + 1 in PREFIXES:
            more = size > j + 1
            texts.append(text[more])
            hashes.append(mixed(total[more] + np.uint64(j + 1)))
    return np.concatenate(texts), np.concatenate(hashes)


class Vocabulary:
    """The terms that vectors have, in order of hash."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.able = np.zeros(1 << 16, bool)
        self.able[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def counts(self, run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the vocabulary's terms in a run of texts, by text, then term."""
        text, h = terms(run)
        some = self.able[(h >> np.uint64(48)).astype(np.int64)]
        text, h = text[some], h[some]
        place = np.searchsorted(self.hashes, h)
        place[place == len(self.hashes)] = 0
        known = self.hashes[place] == h if len(self.hashes) else np.zeros(len(h), bool)
        key, n = np.unique(text[known] * max(1, len(self.hashes)) + place[known], return_counts=True)
        return *np.divmod(key, max(1, len(self.hashes))), n


class Index:
    """Posting lists over examples in blocks, with each list's largest weight by block."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, size: int = BLOCK) -> None:
        order = np.lexsort((example, term))
        self.ids, self.weights, term = example[order], weight[order], term[order]
        self.n = int(self.ids.max(initial=-1)) + 1
        n_blocks = -(-self.n // size) if self.n else 0
        self.size = size
        # where the postings of a term in a block begin
        self.begin = np.searchsorted(term * (n_blocks * size + 1) + self.ids, (np.arange(n_terms) * (n_blocks * size + 1))[:, None] + np.arange(n_blocks + 1) * size)
        self.most = np.zeros((n_terms, n_blocks))
        np.maximum.at(self.most, (term, self.ids // size), self.weights)
        self.opened = 0

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = K, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the k highest positive cosines, ties by number, and the cosines."""
        bounds, begin = weight @ self.most[term], self.begin[term]
        ids, cosines = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-bounds, kind="stable")
        order, at, step = order[bounds[order] > 0], 0, 4
        while at < len(order):  # some blocks at a time
            some = order[at : at + step]
            if len(ids) == k:
                some = some[bounds[some] >= cosines[-1] - SLACK]
                if not len(some):
                    break  # so are all that follow
            self.opened += len(some)
            first, size = begin[:, some], begin[:, some + 1] - begin[:, some]
            n = size.ravel()
            posting = np.repeat(first.ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
            slot = np.repeat(np.tile(np.arange(len(some)), len(term)), n)
            place = self.ids[posting] + (slot - some[slot]) * self.size
            score = np.bincount(place, weights=np.repeat(weight, size.sum(axis=1)) * self.weights[posting], minlength=len(some) * self.size)
            score[np.flatnonzero(some == without // self.size) * self.size + without % self.size] = 0
            found = np.flatnonzero(score > 0)
            ids, cosines = np.concatenate([ids, some[found // self.size] * self.size + found % self.size]), np.concatenate([cosines, score[found]])
            best = np.lexsort((ids, -cosines))[:k]
            ids, cosines = ids[best], cosines[best]
            at, step = at + step, 2 * step
        return ids, cosines


def vectors(text: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of (text, term, count) rows, each text's to length 1."""
    w = (1 + np.log(n)) * idf[term]
    return w / np.sqrt(np.bincount(text, weights=w * w))[text] if len(text) else w


def share(toxic: np.ndarray, cosines: np.ndarray, times: np.ndarray, base: float) -> float:
    """Toxic votes by all votes."""
    votes = cosines**2 * times
    return float(((votes * toxic).sum() + PRIOR * base) / (votes.sum() + PRIOR))


def _logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic curve through y (0 or 1) over x, weighted by w; b is kept positive."""
    a, b, w = 0.0, 1.0, w / w.sum()
    for _ in range(60):  # Newton's steps, with a small ridge towards (0, 1)
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        v = w * p * (1 - p)
        grad = np.array([(w * (y - p)).sum() - 1e-3 * a, (w * (y - p) * x).sum() - 1e-3 * (b - 1)])
        inner = (v * x).sum()
        step = np.linalg.solve(np.array([[v.sum() + 1e-3, inner], [inner, (v * x * x).sum() + 1e-3]]), grad)
        a, b = a + float(np.clip(step[0], -2, 2)), max(0.1, b + float(np.clip(step[1], -0.5, 0.5)))
    return a, b


def _examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic and text of the sample, and how many labels of each kind there are."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {x["toxic"]: x["count"] for x in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 30)) / float(1 << 30)
    limit = F.when(F.col("toxic") == 1, F.lit(min(1.0, SAMPLE / totals.get(1, 1)))).otherwise(F.lit(min(1.0, SAMPLE / totals.get(0, 1))))
    picked = known.where(draw < limit).distinct().orderBy(draw, "toxic").limit(3 * SAMPLE)  # so bounded, it may be broadcast
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.xxhash64("text"))
    return met.dropDuplicates(["key", "toxic"]).orderBy("key", "toxic").limit(3 * SAMPLE).drop("key"), totals


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for first, run in blocks(batch.column("text").to_pylist()):
            text, h = terms(run)
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
            own, place = np.unique(h[new], return_inverse=True)
            mine = toxic[first : first + len(run)][text[new]]
            yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(np.bincount(place, minlength=len(own))), pa.array(np.bincount(place, weights=mine, minlength=len(own)).astype(np.int64))], ["term", "n", "toxic"])


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Vocabulary, index and curve, of bounded size."""
    chosen, totals = _examples(docs, labels)
    base = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return {"base": base}
    examples = stored(chosen, "examples")
    sizes = {x["toxic"]: x["count"] for x in examples.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return {"base": base}
    n, rate = sum(sizes.values()), sizes[1] / sum(sizes.values())
    counted = examples.mapInArrow(_term_counts, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    far = F.abs(F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    rows = counted.where((F.col("n") >= LEAST_EXAMPLES) & (far >= Z)).orderBy(far.desc(), "term").limit(VOCABULARY).collect()
    hashes = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    vocabulary = Vocabulary(hashes)
    idf = np.log(n / np.array([r["n"] for r in rows], float)[order]) + 1

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in blocks(batch.column("text").to_pylist()):
                text, term, count = vocabulary.counts(run)
                ends = np.searchsorted(text, np.arange(len(run) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int64))) for x in (term, count)]
                yield pa.record_batch([*[batch.column(c).slice(first, len(run)) for c in ("doc_id", "toxic")], *lists], ["doc_id", "toxic", "terms", "counts"])

    found = examples.mapInArrow(vector, "doc_id long, toxic int, terms array<long>, counts array<long>").collect()
    discard(examples)
    # like vectors side by side: by the heaviest terms
    weighed = [np.array(r["terms"], np.int64)[np.argsort(-(1 + np.log(np.array(r["counts"], float))) * idf[np.array(r["terms"], np.int64)], kind="stable")] for r in found]
    place = sorted(range(len(found)), key=lambda i: (weighed[i][:3].tolist(), found[i]["toxic"], found[i]["doc_id"]))
    found = [found[i] for i in place]
    toxic = np.array([r["toxic"] for r in found])
    times = np.array([totals[k] / sizes[k] for k in (0, 1)])[toxic]
    example = np.repeat(np.arange(len(found)), [len(r["terms"]) for r in found])
    term, count = (np.array([x for r in found for x in r[c]], np.int64) for c in ("terms", "counts"))
    weight = vectors(example, term, count, idf)
    index = Index(example, term, weight, len(idf))
    bare = np.bincount(example, minlength=len(found)) == 0
    without = float(((times * toxic)[bare].sum() + base) / (times[bare].sum() + 1))
    shares = np.full(len(found), np.nan)
    ends = np.searchsorted(example, np.arange(len(found) + 1))
    for i in np.flatnonzero(~bare):
        mine = slice(ends[i], ends[i + 1])
        ids, cosines = index.nearest(term[mine], weight[mine], without=int(i))
        shares[i] = share(toxic[ids], cosines, times[ids], base)
    full = ~bare
    a, b = curve(_logit(shares[full]), toxic[full].astype(float), times[full]) if full.any() else (0.0, 1.0)
    return {"base": base, "vocabulary": vocabulary, "idf": idf, "index": index, "toxic": toxic, "times": times, "ids": np.array([r["doc_id"] for r in found]), "without": without, "curve": (a, b)}


def score_run(run: list[bytes], model: dict) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores and evidence of a run of texts."""
    text, term, n = model["vocabulary"].counts(run)
    weight = vectors(text, term, n, model["idf"])
    ends = np.searchsorted(text, np.arange(len(run) + 1))
    scores, evidence = np.full(len(run), model["without"]), [[] for _ in run]
    a, b = model["curve"]
    for i in np.flatnonzero(np.diff(ends)):
        mine = slice(ends[i], ends[i + 1])
        ids, cosines = model["index"].nearest(term[mine], weight[mine])
        x = _logit(share(model["toxic"][ids], cosines, model["times"][ids], model["base"]))
        scores[i] = 1 / (1 + np.exp(-(a + b * x)))
        evidence[i] = [{"doc_id": int(model["ids"][k]), "cosine": float(c), "toxic": int(model["toxic"][k])} for k, c in zip(ids[:EVIDENCE], cosines[:EVIDENCE], strict=True)]
    return scores, evidence


_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """docs must have doc_id, text and a boolean held_out."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores, evidence = np.full(len(texts), sent.value["base"]), [[] for _ in texts]
            for first, part in blocks(texts) if "index" in sent.value else ():
                scores[first : first + len(part)], evidence[first : first + len(part)] = score_run(part, sent.value)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(evidence, _EVIDENCE)],
                ["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    return docs.mapInArrow(run, SCHEMA)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs.withColumn("held_out", held_out()), model)


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
