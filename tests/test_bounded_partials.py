"""Tasks that meet very many windows send what they hold on: results do not depend on how often."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefield.operators import linalg, preprocess

WINDOWS, PIXELS, FRAMES = 10_000, 4, 6


@pytest.fixture(scope="module")
def series(spark):
    """Pixels of 10,000 windows, all mixed, in one task."""
    rows = spark.range(WINDOWS * PIXELS).withColumn("window_id", F.col("id") % WINDOWS).withColumn("pixel", F.floor(F.col("id") / WINDOWS))
    v = F.array(*[F.sin(F.col("id") * (k + 1) * 0.37) for k in range(FRAMES)])
    return rows.select(F.lit("v").alias("video_id"), "window_id", "pixel", v.alias("v")).coalesce(1)


def _matrices():
    x = np.sin(np.arange(WINDOWS * PIXELS)[:, None] * np.arange(1, FRAMES + 1) * 0.37)
    return x.reshape(PIXELS, WINDOWS, FRAMES).transpose(1, 0, 2)


def test_factors_flushed_a_hundred_times(series):
    partial = linalg.triangular(series, 100)
    rows = {r["window_id"]: r for r in partial.collect()}
    assert len(rows) == WINDOWS
    for w, x in enumerate(_matrices()):
        r = np.array(rows[w]["re"]).reshape(-1, FRAMES) + 1j * np.array(rows[w]["im"]).reshape(-1, FRAMES)
        assert np.allclose(r.conj().T @ r, x.T @ x, atol=1e-9)


def test_gram_flushed(series):
    got = linalg.gram(series.where("window_id < 500"), 7).where("i = 1 AND j = 2").collect()
    x = _matrices()
    assert len(got) == 500 and all(np.isclose(r["re"], x[r["window_id"], :, 1] @ x[r["window_id"], :, 2]) for r in got)


def test_spectra_flushed(series):
    few = series.where("window_id < 500")
    one, many = ({(r["window_id"], r["bin"]): r["amplitude"] for r in preprocess.amplitude_spectrum(few, 0.5, n).collect()} for n in (10_000, 3))
    assert one.keys() == many.keys() and all(np.isclose(one[k], many[k]) for k in one)
