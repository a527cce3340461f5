"""Wavenumbers between the bins of a tile, and a map whose depth hangs on them."""

from __future__ import annotations

import numpy as np
import pytest

from wavefield.functions.signal import autocorrelation, hann2
from wavefield.operators import tiles
from wavefield.plans.registry import QUERIES


@pytest.mark.parametrize(("rows", "cols"), [(2.4, -3.5), (0.0, 2.3), (-1.6, 0.4)])
def test_peaks_lie_between_bins(rows, cols):
    m, n, dx = 30, 32, 3.0
    wave = np.exp(2j * np.pi * (rows / m * np.arange(m)[:, None] + cols / n * np.arange(n)))
    kx, ky, kept = tiles.fft_peak(autocorrelation(wave) * hann2(m, n), dx, "Fine")
    assert kx[0] == pytest.approx(2 * np.pi * cols / n / dx, abs=0.005) and ky[0] == pytest.approx(2 * np.pi * rows / m / dx, abs=0.005)
    assert tiles.fft_quality(wave * hann2(m, n), kept, hann2(m, n)) < 0.1


def test_no_wave_has_no_wavenumber():
    for x in (np.zeros((24, 24), complex), np.ones((24, 24), complex) * hann2(24, 24)):
        kx, ky, _ = tiles.fft_peak(x, 1.0, "Fine")
        assert kx[0] == 0 and ky[0] == 0


def test_map_of_a_depth_between_bins(spark, tmp_path):
    """Bins alone make the water of this depth 10.8 % too deep."""
    depth = 3.7415
    spark.createDataFrame([(i, (depth - 2.5) * 3000) for i in range(50)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in QUERIES["depth_map_of_waves"](spark, str(tmp_path)).collect()] == [("0", depth, True, True)]
