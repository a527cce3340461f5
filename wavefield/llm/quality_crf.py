"""Quality classifier (operator 1): a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features are shares of character classes,
repetition of words and shape, of the line itself and of the lines before and after it; transition
weights tie neighbouring labels. Forward-backward gives each line's marginal, and the mean of the
good marginals, weighted by line length, is the document's score. Only documents carry labels, so in
the fit each line of a labelled document takes that document's label.

Learned from: at most SAMPLE documents per label value, chosen by hash among labelled rows outside
the held-out third, 3 SAMPLE at most where ids repeat; of a longer document FIT_LINES lines in a row, from a place chosen by hash. Weights undo the sampling. Scoring is one map
over the table, without a shuffle, in blocks of a few megabytes of text.

Defined results: a null or empty text scores 0; a text of line feeds alone is scored by its empty
lines; without labelled rows of both values every text scores 0.5; several labels of one document
each count; repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefield.llm.common import held_out, table
from wavefield.llm.textbytes import IS_SPACE, blocks, joined, words

SAMPLE, FIT_LINES = 1_500, 200
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

#: Character classes by byte: upper, lower, digit, symbol, exclamation, other punctuation, space, not ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[list(b"#*$%&|<>")] = 3
_CLASS[ord("!")] = 4
_CLASS[IS_SPACE] = 6
_CLASS[128:] = 7
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:;\"')")] = True
OWN = 15
FEATURES = 3 * OWN + 1


def line_features(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of a run of texts, each line's length in bytes, each text's line count."""
    buf, at = joined(run)
    feeds = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], feeds[:-1] + 1])
    size = feeds - starts
    per_text = np.diff(np.searchsorted(feeds, at))
    kinds = _CLASS[buf]
    shares = []
    for k in range(8):
        total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
        shares.append((total[feeds] - total[starts]) / np.maximum(size, 1))
    first, last, hashes = words(buf, IS_SPACE[buf])
    line_of = np.searchsorted(feeds, first)
    n_words = np.bincount(line_of, minlength=len(feeds)).astype(float)
    again = np.zeros(len(hashes), bool)
    for step in (1, 2):
        again[step:] |= (hashes[step:] == hashes[:-step]) & (line_of[step:] == line_of[:-step])
    repeats = np.bincount(line_of, weights=again, minlength=len(feeds)) / np.maximum(n_words, 1)
    ended = _ENDS[buf[np.maximum(feeds - 1, 0)]] & (size > 0)
    shares[3:5] = [np.minimum(1.0, x * size / np.maximum(n_words, 1)) for x in shares[3:5]]  # by word
    own = np.stack(
        [*shares, np.sqrt(shares[3]), np.sqrt(shares[4]), repeats, np.sqrt(repeats), ended, np.log1p(n_words) / 5, size == 0], axis=1
    ).astype(np.float32)
    x = np.zeros((len(feeds), FEATURES), np.float32)
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN], x[:-1, 2 * OWN : 3 * OWN] = own[:-1], own[1:]
    begins = np.concatenate([[0], np.cumsum(per_text)])
    x[begins[:-1], OWN : 2 * OWN] = 0
    x[begins[1:] - 1, 2 * OWN : 3 * OWN] = 0
    x[:, -1] = 1
    return x, size, per_text


class Chain:
    """Forward-backward over many sequences of two labels at once, longest first."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][self.order]
        ordered = lengths[self.order]
        active = len(ordered) - np.searchsorted(ordered[::-1], np.arange(1, (ordered[0] if len(ordered) else 0) + 1))
        self.steps = [starts[:n] + t for t, n in enumerate(active)]

    def marginals(self, log_odds: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability that each line is good, and the expected counts of label pairs (per pair of lines)."""
        good = 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))
        node = np.stack([1 - good, good], axis=1)
        link = np.exp(transitions)
        forward, backward = np.empty_like(node), np.ones_like(node)
        for t, rows in enumerate(self.steps):
            a = node[rows] if t == 0 else (forward[self.steps[t - 1][: len(rows)]] @ link) * node[rows]
            forward[rows] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((len(node), 2, 2))
        for t in range(len(self.steps) - 1, 0, -1):
            rows = self.steps[t]
            before = self.steps[t - 1][: len(rows)]
            ahead = node[rows] * backward[rows]
            b = ahead @ link.T
            backward[before] = b / b.sum(axis=1, keepdims=True)
            both = forward[before][:, :, None] * link * ahead[:, None, :]
            pairs[rows] = both / both.sum(axis=(1, 2), keepdims=True)
        joint = forward * backward
        return joint[:, 1] / joint.sum(axis=1), pairs


def fit(x: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
    """Weights of the field by Adam on the conditional log likelihood; labels and weights by document."""
    y, w = np.repeat(labels, lengths).astype(float), np.repeat(weights / np.maximum(lengths, 1), lengths)
    w /= w.sum()
    inner = np.ones(len(y), bool)
    inner[np.concatenate([[0], np.cumsum(lengths)])[:-1]] = False
    seen = np.zeros((len(y), 2, 2))
    seen[inner, y[inner].astype(int), y[inner].astype(int)] = 1
    chain, scale = Chain(lengths), np.maximum(x.std(axis=0), 1e-3)
    scale[-1] = 1
    z = x / scale
    theta = np.zeros(x.shape[1] + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        p, pairs = chain.marginals(z @ theta[:-4], theta[-4:].reshape(2, 2))
        grad = np.concatenate([z.T @ (w * (y - p)), (w[:, None, None] * (seen - pairs)).sum(axis=0).ravel()]) - RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return {"lines": theta[:-4] / scale, "transitions": theta[-4:].reshape(2, 2)}


def score_run(run: list[bytes], model: dict) -> np.ndarray:
    x, size, per_text = line_features(run)
    p, _ = Chain(per_text).marginals(x @ model["lines"], model["transitions"])
    text_of = np.repeat(np.arange(len(run)), per_text)
    length = size + 1.0
    score = np.bincount(text_of, weights=p * length, minlength=len(run)) / np.bincount(text_of, weights=length, minlength=len(run))
    return np.where([len(t) > 0 for t in run], np.clip(score, 0, 1), 0.0)


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").alias("good_"))
    totals = {x["good_"]: x["count"] for x in known.groupBy("good_").count().collect()}
    if len(totals) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("good_") == 1, F.lit(min(1.0, SAMPLE / totals[1]))).otherwise(F.lit(min(1.0, SAMPLE / totals[0])))
    # bounded, so it may be broadcast; only labels that repeat an id make it reach the bound
    picked = known.where(draw < share).distinct().orderBy(draw, "good_").limit(3 * SAMPLE)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, run in blocks(texts):
                x, _, per_text = line_features(run)
                at = np.concatenate([[0], np.cumsum(per_text)])
                keep = [i for i in range(len(run)) if run[i]]
                begin = {i: at[i] + zlib.crc32(run[i]) % max(1, per_text[i] - FIT_LINES + 1) for i in keep}
                part = batch.slice(first, len(run)).take(pa.array(keep, pa.int32()))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("good_"), pa.array([x[begin[i] : min(begin[i] + FIT_LINES, at[i + 1])].tobytes() for i in keep], pa.binary())], ["doc_id", "good_", "x"]
                )

    # rows may share an id: of all that are met, those of the least hashes
    met = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "good_", "text").orderBy(F.xxhash64("doc_id", "text"), "good_").limit(3 * SAMPLE)
    rows = met.mapInArrow(features, "doc_id long, good_ int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["good_"], bytes(r["x"])))
    if len({r["good_"] for r in rows}) < 2:
        return None
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    good = np.array([r["good_"] for r in rows])
    sampled = {k: (good == k).sum() for k in (0, 1)}
    weights = np.array([totals[k] / sampled[k] for k in good])
    return fit(np.concatenate(parts), np.array([len(p) for p in parts]), good, weights)


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs must have doc_id, text and a boolean held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = np.full(len(texts), 0.5)
            for first, part in blocks(texts) if model is not None else ():
                score[first : first + len(part)] = score_run(part, model)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return docs.mapInArrow(run, SCHEMA)


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs.withColumn("held_out", held_out()), model)


QUERIES = {"op1_quality_crf": op1_quality_crf}
ORACLES: dict[str, str] = {}
