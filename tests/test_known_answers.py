"""Known answers for the numeric operators: decomposition, frequencies, fits, tiles, neighbours and tracks."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefield.functions.modefit import marchenko_pastur_median, rank_threshold
from wavefield.operators import fit, linalg, modes, neighbours, preprocess, tiles, track, windows
from wavefield.streaming import streams

SERIES = "video_id string, window_id long, pixel long, row int, col int, v array<double>"


def _series(spark, x, window=0, video="a"):
    return spark.createDataFrame([(video, window, i, i % 5, i // 5, [float(y) for y in row]) for i, row in enumerate(x)], SERIES)


def test_singular_values_projection_and_rank(spark):
    rng = np.random.default_rng(1)
    x = {w: rng.normal(size=(60, 3)) @ rng.normal(size=(3, 16)) + 0.05 * rng.normal(size=(60, 16)) for w in (0, 1)}
    series = _series(spark, x[0]).unionByName(_series(spark, x[1], 1)).repartition(5)
    factors = linalg.triangular(series)
    for rank in (16, 5):
        found = {r["window_id"]: r for r in linalg.tall_svd(factors, rank).collect()}
        projected = {r["window_id"]: np.array(r["re"]).reshape(-1, 16) + 1j * np.array(r["im"]).reshape(-1, 16) for r in linalg.project(linalg.tall_svd(factors, rank)).collect()}
        for w, m in x.items():
            u, s, vh = np.linalg.svd(m, full_matrices=False)
            assert np.allclose(found[w]["s"], s[:rank])
            # U^H X up to the sign of each row
            assert np.allclose(np.abs(projected[w]), np.abs(u[:, :rank].T @ m), atol=1e-9)
    values = linalg.singular_values(linalg.tall_svd(factors, 16))
    for sigma in (None, 0.05):
        for r in linalg.optimal_rank(values, 16 / 60, 60, sigma).collect():
            s = np.linalg.svd(x[r["window_id"]], compute_uv=False)
            beta = 16 / 60
            cut = rank_threshold(beta) * (np.median(s) / np.sqrt(marchenko_pastur_median(beta)) if sigma is None else np.sqrt(60) * sigma)
            assert r["rank"] == (s > cut).sum() == 3 and math.isclose(r["cutoff"], cut)


def _waves(spark, rng, omegas, dt, n, windows_):
    rows = []
    for w in range(windows_):
        shape = rng.normal(size=(80, len(omegas))) + 1j * rng.normal(size=(80, len(omegas)))
        z = shape @ np.exp(1j * np.outer(omegas, np.arange(n) * dt))
        rows += [("a", w, i, i % 8, i // 8, z[i].real.tolist(), z[i].imag.tolist()) for i in range(80)]
    return spark.createDataFrame(rows, "video_id string, window_id long, pixel long, row int, col int, re array<double>, im array<double>")


def test_frequencies_of_exponentials(spark):
    dt, omegas = 0.5, np.array([0.6, 0.9, 1.4])
    z = _waves(spark, np.random.default_rng(2), omegas, dt, 40, 3)
    basis = linalg.tall_svd(linalg.triangular(z), 3)
    first = linalg.initial_frequencies(basis, dt).collect()
    assert len(first) == 9 and all(min(abs(r["alpha_im"] - omegas)) < 0.05 for r in first)
    for kind, init in (("standard", "cold"), ("standard", "warm"), ("robust", "warm")):
        found = linalg.fit_modes(basis, dt, kind, init, stacked=False).collect()
        assert len(found) == 9
        for w in range(3):
            mine = sorted(r["alpha_im"] for r in found if r["window_id"] == w)
            assert np.allclose(mine, omegas, atol=1e-5) and all(abs(r["alpha_re"]) < 1e-5 for r in found)
    exact = linalg.exact_modes(linalg.triangular(z), 3, dt).collect()
    assert np.allclose(sorted(r["alpha_im"] for r in exact if r["window_id"] == 1), omegas, atol=1e-8)
    # the images of all modes together make up the signal's energy at each pixel and frame
    drawn = linalg.draw_modes(z, linalg.fit_modes(basis, dt, stacked=False))
    assert drawn.count() == 9 * 80


def test_warm_start_from_windows_before(spark):
    """Windows fitted one at a time, each from what the ones before left, as those of a video walked at once."""
    dt = 0.5
    rng = np.random.default_rng(5)
    z = _waves(spark, rng, np.array([0.6, 0.9, 1.4]), dt, 40, 3)
    noisy = z.withColumns({c: F.transform(c, lambda x, i: x + F.sin(F.col("pixel") * 7.3 + i * i * 1.7 + F.col("window_id")) / 5) for c in ("re", "im")})
    basis = linalg.tall_svd(linalg.triangular(noisy), 3).cache()
    whole = {(r["window_id"], r["mode"]): (r["alpha_re"], r["alpha_im"]) for r in linalg.fit_modes(basis, dt, init="warm", stacked=False).collect()}
    starts, got, cold = None, {}, linalg.fit_modes(basis, dt, stacked=False).collect()
    for w in range(3):
        fitted = linalg.fit_modes(basis.where(F.col("window_id") == w), dt, init="warm", stacked=False, starts=starts)
        got |= {(r["window_id"], r["mode"]): (r["alpha_re"], r["alpha_im"]) for r in fitted.collect()}
        starts = linalg.last_frequencies(fitted)
        assert starts.collect() == [("a", [got[w, i][0] for i in range(3)], [got[w, i][1] for i in range(3)])]
    assert got.keys() == whole.keys() and len(got) == 9
    assert np.allclose([got[k] for k in whole], list(whole.values()), atol=1e-9)
    # starts are where the fit begins: from far off it ends elsewhere
    far = starts.withColumn("first_im", F.transform("first_im", lambda x: x + 2.5))
    elsewhere = linalg.fit_modes(basis.where("window_id = 1"), dt, init="warm", stacked=False, starts=far).collect()
    assert not np.allclose(sorted(r["alpha_im"] for r in elsewhere), sorted(whole[1, i][1] for i in range(3)), atol=1e-2)
    # windows that failed leave no frequencies, and other videos start afresh
    failed = fitted.withColumn("status", F.lit("failed"))
    assert linalg.last_frequencies(failed).count() == 0
    other = linalg.fit_modes(basis.where("window_id = 1"), dt, init="warm", stacked=False, starts=starts.withColumn("video_id", F.lit("b"))).collect()
    assert {(r["alpha_re"], r["alpha_im"]) for r in other} == {(r["alpha_re"], r["alpha_im"]) for r in cold if r["window_id"] == 1}


def test_frames_numbered_over_ranges(spark):
    rng = np.random.default_rng(1)
    at = {v: sorted(rng.choice(10**6, n, replace=False).tolist()) for v, n in (("a", 5000), ("b", 3), (None, 700))}
    rows = [(v, t, i) for v, times in at.items() for i, t in enumerate(times)]
    rng.shuffle(rows)
    feed = spark.createDataFrame([(v if v != "None" else None, int(t), int(i)) for v, t, i in rows], "video_id string, at long, expected int").repartition(5)
    got = preprocess.frame_rank(feed)
    assert got.columns == ["video_id", "at", "expected", "frame"] and dict(got.dtypes)["frame"] == "int"
    assert got.count() == 5703 and got.where("frame <> expected").count() == 0


def test_a_window_that_fails_leaves_the_others(spark):
    dt = 0.5
    z = _waves(spark, np.random.default_rng(3), np.array([0.7, 1.1]), dt, 32, 2)
    nothing = z.where("window_id = 0").withColumns({"window_id": F.lit(7).cast("long"), "re": F.transform("re", lambda x: x * 0.0), "im": F.transform("im", lambda x: x * 0.0)})
    fitted = linalg.fit_modes(linalg.tall_svd(linalg.triangular(z.unionByName(nothing)), 2), dt, stacked=False)
    assert {r["status"] for r in fitted.where("window_id = 7").collect()} <= {"failed"}
    assert {r["window_id"] for r in windows.good_windows(fitted).collect()} == {0, 1}


def test_bad_pixels_do_not_set_the_range(spark):
    x = np.array([[0.0] * 4, [2, 3, 4, 6], [np.nan, 100, 1, 1], [3, 3, 5, 4]])
    got = {r["pixel"]: r for r in preprocess.minmax_normalise(preprocess.flag_bad_pixels(_series(spark, x).withColumn("v", F.transform("v", lambda y: F.nanvl(y, F.lit(None)))))).collect()}
    assert got[1]["v"] == [0, 0.25, 0.5, 1] and got[1]["normfac"] == 4 and got[3]["v"] == [0.25, 0.25, 0.75, 0.5]


def test_tiles_over_masked_borders(spark):
    side, size = 40, 16
    rows = [("a", 0, 0, r, c, math.cos(0.8 * r), math.sin(0.8 * r)) for r in range(side) for c in range(side) if r > 2 and c > 5]
    pixels = spark.createDataFrame(rows, "video_id string, window_id long, mode int, row int, col int, re double, im double")
    at = [(r, c) for r in (8, 20, 32) for c in (8, 20, 32)]
    schema = "video_id string, window_id long, mode int, cell long, omega double, px_row int, px_col int, dx double, size_v int, size_h int, step double"
    some = spark.createDataFrame([("a", 0, 0, r * 100 + c, 0.8, r, c, 1.0, size, size, 1.0) for r, c in at], schema)
    for block in (512, 16):
        got = {r["cell"]: r for r in tiles.tile_estimates(pixels, some, block=block).collect()}
        assert len(got) == 9
        assert abs(got[2020]["ky"][0] - 2 * math.pi * 2 / 16) < 1e-9 and abs(got[2020]["kx"][0]) < 1e-9
        assert abs(got[808]["ky"][0] - got[2020]["ky"][0]) < 1e-9


def test_two_videos_have_the_neighbours_of_each_alone(spark):
    grid = [(r, c, c * 4 + r, not (r == 1 and c == 2)) for r in range(4) for c in range(5)]
    both = spark.createDataFrame([(v, cell, r, c, ok and not (v == "b" and cell == 0)) for v in "ab" for r, c, cell, ok in grid], "video_id string, cell long, cell_row int, cell_col int, usable boolean")
    kernel = neighbours.disc_kernels(spark.createDataFrame([("a", 10.0), ("b", 5.0)], "video_id string, spacing double"), 10.0)
    pairs = lambda df: sorted((r["cell"], r["neighbour"], r["dr"], r["dc"]) for r in df.collect())
    together = neighbours.neighbour_cells(both, kernel)
    for video, spacing in (("a", 10.0), ("b", 5.0)):
        alone = neighbours.neighbour_cells(both.where(F.col("video_id") == video).drop("video_id"), neighbours.disc_kernel(spark, 10.0, spacing))
        assert pairs(together.where(F.col("video_id") == video)) == pairs(alone)
    keys = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "video_id string, window_id long")
    drawn = neighbours.sample_kernels(keys, kernel, 8, 5)
    counts = {(r["video_id"], r["window_id"]): r["count"] for r in drawn.groupBy("video_id", "window_id").count().collect()}
    assert counts == {("a", 1): 4, ("a", 2): 4, ("b", 1): 8}
    plain = neighbours.sample_kernel(keys.where("video_id = 'b'"), neighbours.disc_kernel(spark, 10.0, 5.0), 8, 5)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, drawn.where("video_id = 'b'").collect()))


@pytest.mark.parametrize("mode", ["bounded", "softbound"])
def test_depth_and_current_of_exact_points(spark, mode):
    rng, rows, truth = np.random.default_rng(4), [], {}
    for cell in range(6):
        d, u, v = (float(rng.uniform(*x)) for x in ((1, 12), (-0.4, 0.4), (-0.4, 0.4)))
        truth[cell] = (d, u, v)
        for _ in range(30):
            kx, ky = rng.uniform(-0.6, 0.6, 2).tolist()
            k = math.hypot(kx, ky)
            rows.append(("a", 0, cell, math.sqrt(9.81 * k * math.tanh(k * d)) + u * kx + v * ky, kx, ky, 1.0))
    points = spark.createDataFrame(rows, "video_id string, window_id long, cell long, omega double, kx double, ky double, w double")
    for r in fit.fit_depth_current(points, mode=mode).collect():
        assert np.allclose((r["d"], r["u"], r["v"]), truth[r["cell"]], rtol=2e-3, atol=2e-3) and r["n_points"] == 30
        assert r["r2"] == pytest.approx(1) and 0 <= r["conf_d"] < 0.05
    still = spark.createDataFrame([(*x[:3], math.sqrt(9.81 * math.hypot(x[4], x[5]) * math.tanh(math.hypot(x[4], x[5]) * truth[x[2]][0])), *x[4:]) for x in rows], points.schema)
    for r in fit.fit_depth(still).collect():
        assert r["d"] == pytest.approx(truth[r["cell"]][0], rel=2e-3) and r["u"] == r["v"] == 0


def test_errors_of_a_linear_fit():
    """Half-widths of a plain least-squares fit equal the textbook formula at its optimum."""
    rng = np.random.default_rng(5)
    kx, ky = rng.uniform(-0.6, 0.6, (2, 1, 40))
    p = np.array([[3.0, 0.2, -0.1]])
    omega = fit.model(p, kx, ky)[0] + 0.02 * rng.normal(size=(1, 40))
    w = np.ones((1, 40))
    found, cost = fit.fit_cells(kx, ky, omega, w, p, loss="linear")
    half, rmse, r2 = fit.fit_errors(found, cost, kx, ky, omega, w, "linear")
    r, j = fit.model(found, kx, ky)[0] - omega, fit.model(found, kx, ky)[1][0]
    s2 = (r**2).sum() / 37
    assert np.allclose(half[0], 2.026192 * np.sqrt(np.diag(np.linalg.inv(j.T @ j)) * s2), rtol=1e-4)
    assert rmse[0] == pytest.approx(math.sqrt(s2)) and r2[0] == pytest.approx(1 - (r**2).sum() / ((omega - omega.mean()) ** 2).sum())


def test_track_is_the_end_of_its_history(spark):
    rows = [("a", i % 7, "d", -1, float(i), i, None if i % 5 == 0 else float(i % 11), [1.0, None, float("inf"), 0.0][i % 4]) for i in range(200)]
    obs = spark.createDataFrame(rows, "video_id string, cell long, variable string, period_bin int, t double, seq long, x double, r double")
    last = {r["cell"]: (r["xhat"], r["p"]) for r in track.kalman_track(obs, 0.01).collect()}
    ends = track.kalman_history(obs, 0.01).groupBy("cell").agg(F.max_by(F.struct("xhat", "p"), F.struct("t", "seq")).alias("s"))
    assert last == {r["cell"]: (r["s"]["xhat"], r["s"]["p"]) for r in ends.collect()}
    assert track.kalman_track(obs.limit(0)).count() == 0


def test_on_the_fly_takes_the_newest_window(spark, tmp_path):
    schema = "video_id string, frame long, value double"
    spark.createDataFrame([("a", i, float(i)) for i in range(20)] + [("b", i, 0.0) for i in range(3)], schema).coalesce(1).write.parquet(str(tmp_path / "feed"))
    seen = []
    query = streams.on_the_fly(spark.readStream.schema(schema).parquet(str(tmp_path / "feed")), 8, lambda df, i: seen.append((i, sorted(map(tuple, df.select("video_id", "frame").collect())))), str(tmp_path / "state"), "1 second")
    until = time.time() + 60
    while not seen and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert seen[0] == (0, [("a", i) for i in range(12, 20)])


def test_weak_and_sorted_modes(spark):
    rows = [("a", 0, 0, 0.0, 1.0, 5.0), ("a", 0, 1, 0.0, -0.5, 0.0), ("a", 0, 2, 0.0, 0.5, 2.0)]
    m = spark.createDataFrame(rows, "video_id string, window_id long, mode long, alpha_re double, alpha_im double, b double")
    assert [r["alpha_im"] for r in modes.sort_modes(m).orderBy("mode").collect()] == [0.5, -0.5, 1.0]
    assert modes.drop_weak_modes(m).count() == 2
