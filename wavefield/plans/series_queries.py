"""Queries over pixel series (embeddings): preparation, spectra and decomposition."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wavefield.functions.modefit import marchenko_pastur_median, rank_threshold
from wavefield.functions.shared import if_small
from wavefield.operators import linalg, modes, preprocess, windows
from wavefield.plans.adapters import DT, SERIES_SQL, good_series, pixel_series, rounded

KEYS = ["window_id", "pixel"]


def _sum(c, of=lambda x: x):
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + of(F.coalesce(x, F.lit(0.0))))


def p1_to_series(spark, d):
    frames = pixel_series(spark, d).select("video_id", "window_id", "pixel", "row", "col", F.posexplode("v").alias("frame", "value"))
    s = preprocess.to_series(frames)
    digest = s.select(*KEYS, F.size("v").cast("long").alias("n"), _sum("v").alias("total"), F.col("v")[0].alias("first"), F.col("v")[63].alias("last"))
    return rounded(digest, [*KEYS, "n"], total=5, first=5, last=5)


def p2_flag_bad_pixels(spark, d):
    return preprocess.flag_bad_pixels(pixel_series(spark, d)).select(*KEYS, "bad")


def p3_demean_frames(spark, d):
    s = preprocess.demean_frames(preprocess.flag_bad_pixels(pixel_series(spark, d)))
    return rounded(s.select(*KEYS, _sum("v", F.abs).alias("size")), KEYS, size=4)


def p4_minmax_normalise(spark, d):
    s = preprocess.minmax_normalise(preprocess.flag_bad_pixels(pixel_series(spark, d)))
    return rounded(s.select(*KEYS, "normfac", _sum("v").alias("total")), KEYS, normfac=5, total=4)


def p5_exclude_bad(spark, d):
    s = preprocess.flag_bad_pixels(pixel_series(spark, d))
    kept = preprocess.pixel_count(preprocess.exclude_bad(s))
    filled = preprocess.exclude_bad(s, False).groupBy("window_id").agg(F.count("*").alias("n_all"), F.sum(_sum("v")).alias("total"))
    return rounded(kept.join(filled, "window_id"), ["window_id", "n_pixels", "n_all"], total=4)


def p6_analytic_signal(spark, d):
    z = preprocess.analytic_signal(good_series(spark, d))
    return rounded(z.select(*KEYS, _sum("re", lambda x: x * x).alias("re2"), _sum("im", lambda x: x * x).alias("im2"), F.col("im")[7].alias("im7")), KEYS, re2=4, im2=4, im7=5)


def p7_amplitude_spectrum(spark, d):
    return rounded(preprocess.amplitude_spectrum(good_series(spark, d), DT), ["window_id", "bin"], f=6, amplitude=6)


def p8_coast_detect(spark, d):
    s = preprocess.coast_detect(good_series(spark, d), DT)
    return rounded(s.select(*KEYS, "ratio"), KEYS, ratio=5)


def p9_stack_delay(spark, d):
    s = preprocess.stack_delay(good_series(spark, d))
    return rounded(s.select(*KEYS, "half", F.size("v").cast("long").alias("n"), _sum("v").alias("total")), [*KEYS, "half", "n"], total=5)


def p10_band_filter(spark, d):
    return rounded(preprocess.band_filter(preprocess.amplitude_spectrum(good_series(spark, d), DT)), ["window_id", "bin"], amplitude=6)


def d2_gram(spark, d):
    return rounded(linalg.gram(good_series(spark, d)), ["window_id", "i", "j"], re=5)


def d1_tall_svd(spark, d):
    """Singular values: their squares sum to the trace of the Gram matrix, their fourth powers to that of its square."""
    values = linalg.singular_values(linalg.tall_svd(linalg.triangular(good_series(spark, d)), 64))
    return rounded(values.groupBy("window_id").agg(F.sum(F.pow("sv", F.lit(2))).alias("energy"), F.sum(F.pow("sv", F.lit(4))).alias("energy2")), ["window_id"], energy=4, energy2=2)


def d3_project(spark, d):
    """Energy per frame of the full-rank projection: that of the series."""
    p = linalg.project(linalg.tall_svd(linalg.triangular(good_series(spark, d)), 64))
    long = p.select("window_id", "n", F.posexplode(F.zip_with("re", "im", lambda a, b: a * a + b * b)).alias("i", "e"))
    return rounded(long.groupBy("window_id", (F.col("i") % F.col("n")).cast("long").alias("frame")).agg(F.sum("e").alias("energy")), ["window_id", "frame"], energy=4)


def d4_optimal_rank(spark, d):
    s = good_series(spark, d)
    values = s.select("video_id", "window_id", F.posexplode("v").alias("i", "x")).groupBy("video_id", "window_id", "i").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("sv"))
    order = F.row_number().over(linalg_window())
    return rounded(linalg.optimal_rank(values.withColumn("i", order - 1), 0.5, 64), ["window_id", F.col("rank").cast("long").alias("rank")], cutoff=4)


def d4_rank_of_singular_values(spark, d):
    """The rank that optimal_rank gives for the singular values themselves."""
    values = linalg.singular_values(linalg.tall_svd(linalg.triangular(good_series(spark, d)), 64))
    return rounded(linalg.optimal_rank(values, 0.5, 64), ["window_id", F.col("rank").cast("long").alias("rank")], cutoff=3)


def linalg_window():
    from pyspark.sql import Window

    return Window.partitionBy("video_id", "window_id").orderBy(F.desc("sv"), "i")


def _fitted(spark, d):
    z = preprocess.stack_delay(preprocess.analytic_signal(good_series(spark, d)))
    return z, linalg.fit_modes(linalg.tall_svd(linalg.triangular(z), 8), DT)


def d5_initial_frequencies(spark, d):
    z = preprocess.stack_delay(preprocess.analytic_signal(good_series(spark, d)))
    return rounded(linalg.initial_frequencies(linalg.tall_svd(linalg.triangular(z), 8), DT), ["window_id"], alpha_re=3, alpha_im=3)


def d6_fit_modes(spark, d):
    return rounded(_fitted(spark, d)[1], ["window_id", "mode", "status"], alpha_re=3, alpha_im=3, b=3)


def w4_good_windows(spark, d):
    """Every fourth window has no signal: it fails, and the others come out with all their modes."""
    silent = F.when(F.col("window_id") % 4 == 3, F.transform("v", lambda x: x * 0.0)).otherwise(F.col("v"))
    z = preprocess.stack_delay(preprocess.analytic_signal(good_series(spark, d).withColumn("v", silent)))
    fitted = linalg.fit_modes(linalg.tall_svd(linalg.triangular(z), 8), DT)
    return windows.good_windows(fitted).groupBy("window_id").agg(F.count("*").alias("n"))


def d7_exact_modes(spark, d):
    z = preprocess.analytic_signal(good_series(spark, d))
    return rounded(linalg.exact_modes(linalg.triangular(z), 8, DT), ["window_id", "mode"], alpha_re=3, alpha_im=3, b=3)


def d8_mode_weights(spark, d):
    z, fitted = _fitted(spark, d)
    drawn = linalg.draw_modes(z, fitted)
    return rounded(drawn.groupBy("window_id", "mode").agg(F.count("*").alias("n"), F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("energy")), ["window_id", "mode", "n"], energy=3)


def _pixels(spark, d):
    """Each pair of samples of a pixel as the real and imaginary part of a mode's image."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("v", 2 * k).alias("re"), F.get("v", 2 * k + 1).alias("im")))
    p = pixel_series(spark, d).select("video_id", F.lit(0).cast("long").alias("window_id"), "pixel", "row", "col", F.posexplode(pairs).alias("mode", "z"))
    return p.select("video_id", "window_id", "mode", "pixel", "row", "col", "z.re", "z.im")


def d13_phase_image(spark, d):
    return rounded(modes.phase_image(_pixels(spark, d)), ["pixel", F.col("mode").cast("long").alias("mode")], re=6, im=6)


def d14_unstack_pixels(spark, d):
    return modes.unstack_pixels(pixel_series(spark, d).select("pixel"), 25).select("pixel", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


def d15_smooth_modes(spark, d):
    p = _pixels(spark, d)
    width = pixel_series(spark, d).groupBy("video_id").agg((F.max("col") + 1).alias("width"))
    smooth = modes.smooth_modes(p.join(if_small(width), "video_id"), 25, F.col("width"))
    return rounded(smooth, [F.col("mode").cast("long").alias("mode"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")], re=5, im=5)


_DFT = """
dft AS (SELECT window_id, pixel, k, sqrt(pow(sum(x * cos(2 * pi() * k * frame / 64)), 2) + pow(sum(x * sin(2 * pi() * k * frame / 64)), 2)) * 2 / 64 AS a
        FROM good, (SELECT unnest(range(0, 33)) AS k) GROUP BY window_id, pixel, k)"""
_PAIRS = "max(x) FILTER (WHERE frame % 2 = 0) AS re, max(x) FILTER (WHERE frame % 2 = 1) AS im"
_SMOOTH = """, {out} AS (SELECT t.mode, t.row, t.col, sum(s.re * o.w) AS re, sum(s.im * o.w) AS im
  FROM {src} t, (VALUES (0, 0, 4.0), (-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0)) o(r, c, w), dims
  JOIN {src} s ON true WHERE s.mode = t.mode AND s.row = greatest(0, least(24, t.row + o.r)) AND s.col = greatest(0, least(dims.n - 1, t.col + o.c)) GROUP BY t.mode, t.row, t.col)"""


def _unit(digits):
    return ", ".join(f"round(CASE WHEN re * re + im * im > 0 THEN {c} / sqrt(re * re + im * im) ELSE 0 END, {digits}) + 0.0 AS {c}" for c in ("re", "im"))


ORACLES = {
    "p1_to_series": SERIES_SQL + " SELECT window_id, pixel, count(*) AS n, round(sum(coalesce(x, 0)), 5) + 0.0 AS total, round(max(x) FILTER (WHERE frame = 0), 5) + 0.0 AS first, round(max(x) FILTER (WHERE frame = 63), 5) + 0.0 AS last FROM px GROUP BY window_id, pixel",
    "p2_flag_bad_pixels": SERIES_SQL + " SELECT DISTINCT window_id, pixel, bad FROM px JOIN bad USING (pixel)",
    "p3_demean_frames": SERIES_SQL + ", m AS (SELECT window_id, frame, avg(x) AS m FROM good GROUP BY window_id, frame) SELECT window_id, pixel, round(sum(coalesce(abs(x - m), 0)), 4) + 0.0 AS size FROM px JOIN m USING (window_id, frame) GROUP BY window_id, pixel",
    "p4_minmax_normalise": SERIES_SQL + ", e AS (SELECT window_id, min(x) AS lo, max(x) AS hi FROM good GROUP BY window_id) SELECT window_id, pixel, round(any_value(hi - lo), 5) + 0.0 AS normfac, round(sum(coalesce((x - lo) / (hi - lo), 0)), 4) + 0.0 AS total FROM px JOIN e USING (window_id) GROUP BY window_id, pixel",
    "p5_exclude_bad": SERIES_SQL + " SELECT window_id, count(DISTINCT pixel) FILTER (WHERE NOT bad) AS n_pixels, count(DISTINCT pixel) AS n_all, round(sum(coalesce(x, 0)), 4) + 0.0 AS total FROM px JOIN bad USING (pixel) GROUP BY window_id",
    "p6_analytic_signal": SERIES_SQL + """, f AS (SELECT window_id, pixel, k, sum(x * cos(2 * pi() * k * frame / 64)) AS a, -sum(x * sin(2 * pi() * k * frame / 64)) AS b
        FROM good, (SELECT unnest(range(0, 33)) AS k) GROUP BY window_id, pixel, k),
      z AS (SELECT window_id, pixel, frame, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (a * cos(2 * pi() * k * frame / 64) - b * sin(2 * pi() * k * frame / 64))) / 64 AS re,
        sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (a * sin(2 * pi() * k * frame / 64) + b * cos(2 * pi() * k * frame / 64))) / 64 AS im
        FROM f, (SELECT unnest(range(0, 64)) AS frame) GROUP BY window_id, pixel, frame)
      SELECT window_id, pixel, round(sum(re * re), 4) + 0.0 AS re2, round(sum(im * im), 4) + 0.0 AS im2, round(max(im) FILTER (WHERE frame = 7), 5) + 0.0 AS im7 FROM z GROUP BY window_id, pixel""",
    "p7_amplitude_spectrum": SERIES_SQL + "," + _DFT + f" SELECT window_id, k AS bin, round(k / 64 / {DT}, 6) + 0.0 AS f, round(avg(a), 6) + 0.0 AS amplitude FROM dft GROUP BY window_id, k",
    "p8_coast_detect": SERIES_SQL + "," + _DFT + f""", r AS (SELECT window_id, pixel, sum(a) FILTER (WHERE NOT (k / 64 / {DT} > 1.0::DOUBLE / 20 AND k / 64 / {DT} < 1.0::DOUBLE / 3)) / sum(a) FILTER (WHERE k / 64 / {DT} > 1.0::DOUBLE / 20 AND k / 64 / {DT} < 1.0::DOUBLE / 3) AS raw FROM dft GROUP BY window_id, pixel),
      e AS (SELECT window_id, min(raw) AS lo, max(raw) AS hi FROM r GROUP BY window_id) SELECT window_id, pixel, round((raw - lo) / (hi - lo), 5) + 0.0 AS ratio FROM r JOIN e USING (window_id)""",
    "p9_stack_delay": SERIES_SQL + " SELECT window_id, pixel, half, count(*) AS n, round(sum(x), 5) + 0.0 AS total FROM good, (SELECT unnest([0, 1]) AS half) WHERE frame BETWEEN half AND half + 62 GROUP BY window_id, pixel, half",
    "p10_band_filter": SERIES_SQL + "," + _DFT + f" SELECT window_id, k AS bin, round(avg(a), 6) + 0.0 AS amplitude FROM dft WHERE k / 64 / {DT} > 1.0::DOUBLE / 15 AND k / 64 / {DT} < 1.0::DOUBLE / 3 GROUP BY window_id, k",
    "d1_tall_svd": SERIES_SQL + ", g AS (SELECT a.window_id, a.frame = b.frame AS own, sum(a.x * b.x) AS g FROM good a JOIN good b USING (window_id, pixel) GROUP BY a.window_id, a.frame, b.frame) SELECT window_id, round(sum(g) FILTER (WHERE own), 4) + 0.0 AS energy, round(sum(g * g), 2) + 0.0 AS energy2 FROM g GROUP BY window_id",
    "d2_gram": SERIES_SQL + " SELECT a.window_id, a.frame AS i, b.frame AS j, round(sum(a.x * b.x), 5) + 0.0 AS re FROM good a JOIN good b USING (window_id, pixel) GROUP BY a.window_id, a.frame, b.frame",
    "d3_project": SERIES_SQL + " SELECT window_id, frame, round(sum(x * x), 4) + 0.0 AS energy FROM good GROUP BY window_id, frame",
    "d4_optimal_rank": SERIES_SQL + f", s AS (SELECT window_id, frame, sqrt(sum(x * x)) AS sv FROM good GROUP BY window_id, frame), c AS (SELECT window_id, median(sv) * {rank_threshold(0.5) / math.sqrt(marchenko_pastur_median(0.5))!r}::DOUBLE AS cutoff FROM s GROUP BY window_id) SELECT window_id, count(*) FILTER (WHERE sv > cutoff) AS rank, round(cutoff, 4) + 0.0 AS cutoff FROM s JOIN c USING (window_id) GROUP BY window_id, cutoff",
    "w4_good_windows": SERIES_SQL + " SELECT DISTINCT window_id, 8::BIGINT AS n FROM good WHERE window_id % 4 <> 3",
    "d13_phase_image": SERIES_SQL + f", w AS (SELECT pixel, frame // 2 AS mode, {_PAIRS} FROM px GROUP BY pixel, frame // 2) SELECT pixel, mode, {_unit(6)} FROM w",
    "d14_unstack_pixels": "SELECT vec_id AS pixel, vec_id % 25 AS row, vec_id // 25 AS col FROM embeddings",
    "d15_smooth_modes": SERIES_SQL + f", s0 AS (SELECT frame // 2 AS mode, (pixel % 25)::INTEGER AS row, (pixel // 25)::INTEGER AS col, {_PAIRS} FROM px GROUP BY pixel, frame // 2), dims AS (SELECT max(col) + 1 AS n FROM s0)"
    + _SMOOTH.format(out="s1", src="s0") + _SMOOTH.format(out="s2", src="s1") + f" SELECT mode, row::BIGINT AS row, col::BIGINT AS col, {_unit(5)} FROM s2",
}

QUERIES = {
    q.__name__: q
    for q in (
        p1_to_series, p2_flag_bad_pixels, p3_demean_frames, p4_minmax_normalise, p5_exclude_bad, p6_analytic_signal, p7_amplitude_spectrum, p8_coast_detect, p9_stack_delay, p10_band_filter,
        d1_tall_svd, d2_gram, d3_project, d4_optimal_rank, d4_rank_of_singular_values, d5_initial_frequencies, d6_fit_modes, w4_good_windows, d7_exact_modes, d8_mode_weights, d13_phase_image, d14_unstack_pixels, d15_smooth_modes,
    )
}
