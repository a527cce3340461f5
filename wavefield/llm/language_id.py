"""Language identification (operator 2): nearest centroid over normalised TF-IDF n-gram vectors.

A text becomes the hashed counts of its byte bi- and trigrams (letters lowered, ASCII that is no
letter as one blank), square-rooted, times idf, to length 1. Each language has several centroids,
found by spherical k-means over a bounded sample of labelled rows; a text gets the language of the
centroid of the highest cosine, and is rejected (`accepted` false) where it lies further from it
than nearly all rows that formed it. Prediction is one map over the table, without a shuffle.

Learned from: about SAMPLE rows in all, SAMPLE_LANG at most and one at least per language, chosen by hash among rows
with text and lang outside the held-out third; every value of lang is learned; idf comes from the same sample.

Defined results: a null text, or one without any letter, is `und` with score 0; an empty table of
labelled rows makes every text `und`; repeated rows are predicted one by one; extra columns are
ignored; ties go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefield.functions.shared import if_small
from wavefield.llm.common import held_out, table
from wavefield.llm.textbytes import blocks, joined

DIMENSIONS, CENTROIDS = 4096, 4
SAMPLE, SAMPLE_LANG = 4_000, 400
#: A text is rejected beyond this many standard deviations from its centroid's mean distance.
REJECT_SIGMAS = 6.0
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"

_FOLDED = np.full(256, 0x20, np.uint8)
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)


def counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(first index, square-rooted counts of hashed n-grams) of runs of texts."""
    lowered = pc.utf8_lower(pa.array([x or "" for x in texts], pa.string())).to_pylist()
    for first, run in blocks(lowered, 1 << 20, 512):
        buf, at = joined(run)
        b = _FOLDED[buf].astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] + b[2:] * np.uint32(0xC2B2AE35)
        top = np.uint32(32 - DIMENSIONS.bit_length() + 1)
        two, three = ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> top for x in (two + np.uint32(1), three))
        out = np.empty((len(run), DIMENSIONS), np.float32)
        for i in range(len(run)):
            a, z = at[i], at[i + 1]
            out[i] = np.bincount(two[a : max(a, z - 2)], minlength=DIMENSIONS)
            out[i] += np.bincount(three[a : max(a, z - 3)], minlength=DIMENSIONS)
        yield first, np.sqrt(out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit vectors by cosine, and each row's centroid; starts from far-apart rows."""
    seeds = [int(np.argmin(x @ x.mean(axis=0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    centres = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        centres = unit(np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    return centres, np.argmax(x @ centres.T, axis=1)


def fit(vectors: np.ndarray, langs: np.ndarray, k: int = CENTROIDS) -> dict:
    idf = np.log((1 + len(vectors)) / (1 + (vectors > 0).sum(axis=0))).astype(np.float32) + 1
    x = unit(vectors * idf)
    names, centres, limits = [], [], []
    for lang in sorted(set(langs)):
        mine = x[langs == lang]
        found, own = clusters(mine, k)
        cosine = np.einsum("ij,ij->i", mine, found[own])
        for j, centre in enumerate(found):
            far = 1 - cosine[own == j]
            names.append(lang)
            centres.append(centre)
            limits.append(min(1.0, far.mean() + REJECT_SIGMAS * far.std() + 0.05) if len(far) else 0.0)
    return {"idf": idf, "names": names, "centres": np.array(centres, np.float32), "limits": np.array(limits)}


def _sample(docs: DataFrame) -> DataFrame:
    usable = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n_"))
    n = sizes.count()
    each = min(SAMPLE_LANG, max(1, SAMPLE // max(n, 1)))
    # enough more than each that no language is missed by chance
    wanted = each + 3 * each**0.5 + 3
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # one row a language: sent to every task if there are few
    picked = usable.join(if_small(sizes), "lang").withColumn("draw_", draw).where(F.col("draw_") < F.lit(wanted) / F.col("n_"))
    return picked.dropDuplicates(["lang", "draw_"]).select(*usable.columns)


def train(docs: DataFrame) -> dict | None:
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in counts(batch.column("text").to_pylist()):
                part = batch.slice(first, len(x))
                yield pa.record_batch([part.column("doc_id"), part.column("lang"), pa.array([y.tobytes() for y in x])], ["doc_id", "lang", "v"])

    rows = _sample(docs).select("doc_id", "lang", "text").mapInArrow(vectors, "doc_id long, lang string, v binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] is not None, r["doc_id"], bytes(r["v"])))
    return fit(np.stack([np.frombuffer(r["v"], np.float32) for r in rows]), np.array([r["lang"] for r in rows]))


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs must have doc_id, text and a boolean held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = len(letters)
            lang, score, accepted = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            if model is not None:
                names = np.array(model["names"], object)
                for first, x in counts(texts.to_pylist()):
                    cosine = unit(x * model["idf"]) @ model["centres"].T
                    best = np.argmax(cosine, axis=1)
                    top, rows = cosine[np.arange(len(x)), best], np.arange(first, first + len(x))
                    some = letters[rows]
                    lang[rows[some]] = names[best[some]]
                    score[rows[some]] = np.clip(top[some], 0, 1)
                    accepted[rows[some]] = 1 - top[some] <= model["limits"][best[some]]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    return docs.mapInArrow(run, SCHEMA)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
