"""Queries over modes and soundings (part), the grid of cells and generated waves."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavefield.functions.shared import shared_dir
from wavefield.operators import grid, modes, tiles, validate
from wavefield.plans.adapters import MODES_SQL, SERIES_SQL, SOUNDINGS_SQL, cells, pixel_series, rounded, soundings, table
from wavefield.plans.adapters import modes as part_modes
from wavefield.sources import frames as frame_source
from wavefield.sources import soundings as survey
from wavefield.sources import synthetic

POLYGON = [(35.0, 15.0), (255.0, 95.0), (305.0, 405.0), (105.0, 215.0)]
M, N, DX = 260, 300, 0.5


def d9_sort_modes(spark, d):
    return rounded(modes.sort_modes(part_modes(spark, d)), ["window_id", F.col("mode").cast("long").alias("mode")], alpha_im=6)


def d10_band_filter_modes(spark, d):
    return rounded(modes.band_filter_modes(part_modes(spark, d), real_signal=True), ["window_id", "mode"], omega=6, f=6, b=4)


def d11_drop_weak_modes(spark, d):
    return modes.drop_weak_modes(part_modes(spark, d)).groupBy("window_id").agg(F.count("*").alias("n"))


def d12_fourier_amplitude(spark, d):
    m = part_modes(spark, d)
    windows = m.groupBy("video_id", "window_id").agg(F.count("*").alias("n_pixels"), (F.max("b") - F.min("b")).alias("normfac"))
    return rounded(modes.fourier_amplitude(m, windows), ["window_id", "mode"], b_fourier=4, b_orig=2)


def g2_tile_size(spark, d):
    m = modes.band_filter_modes(part_modes(spark, d))
    size = lambda n: grid.tile_size(F.col("omega"), F.lit(2.0), F.lit(24), n).cast("long")
    return m.select("window_id", "mode", size(2).alias("wanted"), size(1).alias("least"))


def _meta(spark, d):
    """A video per supplier nation: sizes follow the key."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.concat(F.lit("v"), k.cast("string")).alias("video_id"), (k * 20 + 100).cast("int").alias("m"), (k * 30 + 90).cast("int").alias("n"), (F.lit(0.5) + k % 4 * 0.25).alias("dx"), F.lit(100.0).alias("x0"), F.lit(-50.0).alias("y0"))


def g1_build_grid(spark, d):
    g = grid.build_grid(_meta(spark, d), "fast")
    return rounded(g, ["video_id", "cell", F.col("px_row").cast("long").alias("px_row"), F.col("px_col").cast("long").alias("px_col")], x=4, y=4, cell_dx=4)


def _tiles(spark, d):
    """The grid's cells by the modes of part: one video of M by N pixels."""
    meta = _meta(spark, d).where("video_id = 'v8'").select(F.lit("pa").alias("video_id"), F.lit(M).alias("m"), F.lit(N).alias("n"), F.lit(DX).alias("dx"), "x0", "y0")
    m = modes.band_filter_modes(modes.sort_modes(part_modes(spark, d)))
    return grid.clip_tiles_to_frame(grid.build_grid(meta, "fast"), m, meta), meta


def g3_clip_tiles(spark, d):
    t, _ = _tiles(spark, d)
    return t.groupBy("window_id", "mode").agg(F.count("*").alias("n"), F.sum("size_v").alias("v"), F.sum("size_h").alias("h")).select("window_id", F.col("mode").cast("long").alias("mode"), "n", "v", "h")


def _bad(spark, d):
    """Masked pixels: the columns of soundings shallower than the median, stretched to the image."""
    p = table(spark, d, "part").where(F.col("p_retailprice") < 920)
    return p.select(F.lit("pa").alias("video_id"), (F.col("p_partkey") % M).cast("int").alias("row"), (F.floor(F.col("p_partkey") / 7) % N).cast("int").alias("col")).distinct()


def _fitted(spark, d):
    t, meta = _tiles(spark, d)
    return grid.fit_tiles(t, _bad(spark, d), meta)


def g4_g5_fit_tiles(spark, d):
    t = _fitted(spark, d).groupBy("window_id", F.col("mode").cast("long").alias("mode"))
    return rounded(t.agg(F.sum("size_v").alias("v"), F.sum("size_h").alias("h"), F.sum("step").alias("step"), F.sum("n_wavelengths").alias("waves")), ["window_id", "mode", "v", "h"], step=4, waves=4)


def g6_mask_cells(spark, d):
    return grid.mask_cells(_tiles(spark, d)[0]).select("window_id", "cell", "usable")


def g7_k_tile_estimates(spark, d):
    """Estimates on images drawn from the embeddings: each pair of samples is a mode, and tiles of 16 by 16 lie
    on a grid over all columns of the image."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("v", 2 * k).alias("re"), F.coalesce(F.get("v", 2 * k + 1), F.lit(0.0)).alias("im")))
    s = pixel_series(spark, d).where(F.col("window_id").isNotNull()).select("row", "col", F.posexplode(pairs).alias("mode", "z"))
    p = s.select(F.lit("emb").alias("video_id"), F.lit(0).cast("long").alias("window_id"), "mode", "row", "col", F.coalesce("z.re", F.lit(0.0)).alias("re"), "z.im")
    # centres whose tile lies inside the 25 rows and the columns that there are
    last = p.groupBy("video_id", "window_id", "mode").agg(F.max("col").cast("int").alias("last"))
    col = F.explode(F.expr("CASE WHEN last >= 15 THEN sequence(8, last - 7, 4) ELSE array() END")).alias("px_col")
    t = last.select("video_id", "window_id", "mode", col).select("*", F.explode(F.array(F.lit(8), F.lit(12), F.lit(16))).alias("px_row"))
    t = t.select("*", (F.col("px_row") * 100_000 + F.col("px_col")).cast("long").alias("cell"), (F.lit(0.6) + F.col("mode") / 40).alias("omega"), F.lit(1.0).alias("dx"), F.lit(16).alias("size_v"), F.lit(16).alias("size_h"), F.lit(1.0).alias("step"))
    e = tiles.tile_estimates(p, t)
    return rounded(e.select("cell", "omega", F.col("kx")[0].alias("kx"), "e_fft", "cx", "cy", "e_piv"), ["cell"], omega=4, kx=4, e_fft=3, cx=2, cy=2, e_piv=3)


def s2_crop_stride(spark, d):
    f = pixel_series(spark, d).select("video_id", "pixel", "row", "col", F.lit(0).alias("frame"))
    return frame_source.crop_stride(f, 2, 18, 3, 24, 2).select("pixel", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


def s3_mask_polygon(spark, d):
    return frame_source.inside_polygon(soundings(spark, d), POLYGON).select("x", "y", "inside")


def s4_synthetic_waves(spark, d):
    """The generated stack at the pixel and frame of each part."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 16).cast("int").alias("row"), (F.floor(F.col("p_partkey") / 16) % 16).cast("int").alias("col"), (F.col("p_size") % 8).alias("frame")).distinct()
    w = synthetic.synthetic_waves(spark, 16, 8, 0.5).join(p, ["row", "col", "frame"])
    return rounded(w, [F.col(c).cast("long").alias(c) for c in ("frame", "row", "col")], value=6)


def s7_interpolate_gridded(spark, d):
    s = soundings(spark, d).select("video_id", "x", "y", survey.soundings_to_depth(F.col("z"), 0.077).alias("depth"))
    at = cells(spark, d).select(F.lit("pa").alias("video_id"), "cell", (F.col("cell_row") * 37.0 + 3).alias("x"), (F.col("cell_col") * 11.0 + 8).alias("y"))
    return rounded(survey.interpolate_gridded(s, at, 0.0, 0.0, 10.0), ["cell"], depth=5)


def s7_interpolate_scattered(spark, d):
    s = soundings(spark, d).select("video_id", (F.col("x") + F.col("y") % 7 / 3).alias("x"), (F.col("y") + F.col("x") % 11 / 4).alias("y"), survey.soundings_to_depth(F.col("z"), 0.077).alias("depth"))
    at = cells(spark, d).select(F.lit("pa").alias("video_id"), "cell", (F.col("cell_row") * 37.0 + 30).alias("x"), (F.col("cell_col") * 11.0 + 30).alias("y"))
    return rounded(survey.interpolate_scattered(s, at, 40.0), ["cell"], depth=4)


def s1_read_frames(spark, d):
    """Frames written as Parquet and read back."""
    path = shared_dir(spark)
    f = pixel_series(spark, d).select("video_id", "row", "col", F.posexplode("v").alias("frame", "value"))
    f.where("value IS NOT NULL").write.parquet(path)
    out = frame_source.read_frames(spark, path).groupBy("frame").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(out, [F.col("frame").cast("long").alias("frame"), "n"], total=4)


def s5_read_soundings(spark, d):
    """Soundings written as text and read back."""
    path = shared_dir(spark)
    soundings(spark, d).select(F.concat_ws("  ", "x", "y", F.format_number("z", 4))).write.text(path)
    return rounded(survey.read_soundings(spark, path), ["x", "y"], z=3)


def s8_write_results(spark, d):
    """Results written by video and read back."""
    path = shared_dir(spark)
    frame_source.write_results(grid.build_grid(_meta(spark, d), "fast"), path)
    out = spark.read.parquet(path).groupBy("video_id").agg(F.count("*").alias("n"), F.sum("cell").alias("cells"))
    return out.select(F.col("video_id").cast("string").alias("video_id"), "n", "cells")


def v4_thin_field(spark, d):
    g = grid.build_grid(_meta(spark, d), "fast")
    return validate.thin_vectors(g, 4).select("video_id", "cell")


_OMEGA = "abs(alpha_im) AS omega, abs(alpha_im) / (2 * pi()) AS f"
_BAND = "band AS (SELECT *, " + _OMEGA + " FROM modes WHERE abs(alpha_im) / (2 * pi()) > 1.0::DOUBLE / 15 AND abs(alpha_im) / (2 * pi()) < 1.0::DOUBLE / 3)"
_PX = "(floor(1.56::DOUBLE * pow(2 * pi() / omega, 2) * {n} / {dx})::INTEGER)"
_SIZE = "CASE WHEN {n} * 8 > {p} + {p} % 2 THEN 0 ELSE greatest({p} + {p} % 2, {least}) END"


def _size_sql(n: int, dx: str, least: str) -> str:
    return _SIZE.format(n=n, least=least, p=_PX.format(n=n, dx=dx))


_META = "meta AS (SELECT 'v' || n_nationkey AS video_id, (n_nationkey * 20 + 100)::INTEGER AS m, (n_nationkey * 30 + 90)::INTEGER AS n, 0.5::DOUBLE + n_nationkey % 4 * 0.25::DOUBLE AS dx FROM nation)"


def _grid_sql(meta: str, disc: int) -> str:
    return (
        f"g0 AS (SELECT *, greatest(24, round_even(10 / dx, 0)::INTEGER + round_even(10 / dx, 0)::INTEGER % 2) AS least FROM {meta}), g1 AS (SELECT *, greatest(2, round_even(((m - least) / {disc} + (n - least) / {disc}) / 2, 0)::INTEGER) AS step FROM g0 WHERE m >= least AND n >= least), "
        "g2 AS (SELECT *, unnest(range(0, m - least + 1, step)) AS r0 FROM g1), g3 AS (SELECT *, unnest(range(0, n - least + 1, step)) AS c0 FROM g2), "
        "grid AS (SELECT *, (c0 // step) * ((m - least) // step + 1) + r0 // step AS cell, r0 + least // 2 AS px_row, c0 + least // 2 AS px_col FROM g3)"
    )


def _clip_sql(c: str, length: str) -> str:
    low = f"CASE WHEN {c} - size // 2 >= 0 THEN size WHEN {c} - size_min // 2 < 0 THEN 0 ELSE 2 * {c} END"
    return f"CASE WHEN {c} + size // 2 > {length} THEN CASE WHEN {c} + size_min // 2 > {length} OR ({low}) = 0 THEN 0 ELSE least({low}, 2 * ({length} - {c})) END ELSE {low} END"


_TILES = (
    "WITH " + MODES_SQL + ", s AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY abs(alpha_im), alpha_im DESC, alpha_re, mode) - 1 AS rank FROM modes), "
    "few AS (SELECT window_id, abs(alpha_im) AS omega, rank AS mode FROM s WHERE abs(alpha_im) / (2 * pi()) > 1.0::DOUBLE / 15 AND abs(alpha_im) / (2 * pi()) < 1.0::DOUBLE / 3), "
    f"one AS (SELECT {M} AS m, {N} AS n, {DX}::DOUBLE AS dx), " + _grid_sql("one", 20) + ", "
    f"z AS (SELECT window_id, mode, cell, px_row, px_col, m, n, {_size_sql(2, 'dx', 'least')} AS size, {_size_sql(1, 'dx', 'least')} AS size_min FROM grid, few), "
    f"t0 AS (SELECT *, {_clip_sql('px_row', 'm')} AS v, {_clip_sql('px_col', 'n')} AS h FROM z), "
    "tiles AS (SELECT window_id, mode, cell, CASE WHEN size = 0 OR v = 0 OR h = 0 THEN 0 ELSE v END AS v, CASE WHEN size = 0 OR v = 0 OR h = 0 THEN 0 ELSE h END AS h FROM t0)"
)
_EDGES = " + ".join(
    f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < (y - {y1}) * ({(x2 - x1) / (y2 - y1)!r}::DOUBLE) + {x1} THEN 1 ELSE 0 END"
    for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True) if y1 != y2
)
_WAVES = " + ".join(f"{a}::DOUBLE * cos({w}::DOUBLE * 0.5::DOUBLE * frame + 2 * pi() / 16 * (row * {r} + col * {c}))" for w, a, r, c in synthetic.SIX_WAVES)

ORACLES = {
    "d9_sort_modes": "WITH " + MODES_SQL + " SELECT window_id, row_number() OVER (PARTITION BY window_id ORDER BY abs(alpha_im), alpha_im DESC, alpha_re, mode) - 1 AS mode, round(alpha_im, 6) + 0.0 AS alpha_im FROM modes",
    "d10_band_filter_modes": "WITH " + MODES_SQL + ", " + _BAND + ", r AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY omega, alpha_im DESC, mode) AS rn FROM band) SELECT window_id, mode, round(omega, 6) AS omega, round(f, 6) AS f, round(b * 2, 4) + 0.0 AS b FROM r WHERE rn % 2 = 1",
    "d11_drop_weak_modes": "WITH " + MODES_SQL + " SELECT window_id, count(*) AS n FROM modes WHERE b <> 0 GROUP BY window_id",
    "d12_fourier_amplitude": "WITH " + MODES_SQL + ", w AS (SELECT window_id, count(*) AS n, max(b) - min(b) AS f FROM modes GROUP BY window_id) SELECT window_id, mode, round(b / sqrt(n), 4) + 0.0 AS b_fourier, round(b / sqrt(n) * f, 2) + 0.0 AS b_orig FROM modes JOIN w USING (window_id)",
    "g1_build_grid": "WITH " + _META + ", " + _grid_sql("meta", 20) + " SELECT video_id, cell::BIGINT AS cell, px_row::BIGINT AS px_row, px_col::BIGINT AS px_col, round(100 + px_col * dx, 4) AS x, round(-50 + px_row * dx, 4) + 0.0 AS y, round(step * dx, 4) AS cell_dx FROM grid",
    "g2_tile_size": "WITH " + MODES_SQL + ", " + _BAND + f" SELECT window_id, mode, ({_size_sql(2, '2', '24')})::BIGINT AS wanted, ({_size_sql(1, '2', '24')})::BIGINT AS least FROM band",
    "g3_clip_tiles": _TILES + " SELECT window_id, mode, count(*) AS n, sum(v)::BIGINT AS v, sum(h)::BIGINT AS h FROM tiles GROUP BY window_id, mode",
    "g6_mask_cells": _TILES + " SELECT window_id, cell::BIGINT AS cell, NOT bool_and(v = 0 OR h = 0) AS usable FROM tiles GROUP BY window_id, cell",
    "s2_crop_stride": "SELECT vec_id AS pixel, (vec_id % 25 - 3) // 2 AS row, (vec_id // 25 - 2) // 2 AS col FROM embeddings WHERE vec_id % 25 BETWEEN 3 AND 23 AND vec_id // 25 BETWEEN 2 AND 17 AND (vec_id % 25 - 3) % 2 = 0 AND (vec_id // 25 - 2) % 2 = 0",
    "s3_mask_polygon": "WITH " + SOUNDINGS_SQL + f" SELECT x, y, ({_EDGES}) % 2 = 1 AS inside FROM snd",
    "s4_synthetic_waves": f"WITH p AS (SELECT DISTINCT p_size % 8 AS frame, p_partkey % 16 AS row, p_partkey // 16 % 16 AS col FROM part) SELECT frame::BIGINT AS frame, row, col, round({_WAVES}, 6) + 0.0 AS value FROM p",
    "s7_interpolate_gridded": """WITH n AS (SELECT p_partkey % 40 AS nx, p_partkey // 40 AS ny, p_retailprice / 100 + 0.077::DOUBLE AS d FROM part),
      c AS (SELECT s_suppkey AS cell, (s_suppkey % 10 * 37.0::DOUBLE + 3) / 10 AS x, (s_suppkey // 10 * 11.0::DOUBLE + 8) / 10 AS y FROM supplier), i AS (SELECT *, floor(x)::BIGINT AS ix, floor(y)::BIGINT AS iy, x - floor(x) AS fx, y - floor(y) AS fy FROM c),
      k AS (SELECT cell, ix AS nx, iy AS ny, 1 - greatest(fx, fy) AS s FROM i UNION ALL SELECT cell, ix + 1, iy + 1, least(fx, fy) FROM i UNION ALL SELECT cell, CASE WHEN fy > fx THEN ix ELSE ix + 1 END, CASE WHEN fy > fx THEN iy + 1 ELSE iy END, abs(fx - fy) FROM i)
      SELECT cell, CASE WHEN count(d) = count(*) THEN round(sum(s * d), 5) END AS depth FROM k LEFT JOIN n USING (nx, ny) WHERE s > 0 GROUP BY cell""",
    "s1_read_frames": SERIES_SQL + " SELECT frame, count(x) AS n, round(sum(x), 4) + 0.0 AS total FROM px GROUP BY frame",
    "s5_read_soundings": "WITH " + SOUNDINGS_SQL + " SELECT x, y, round(round(z, 4), 3) + 0.0 AS z FROM snd",
    "s8_write_results": "WITH " + _META + ", " + _grid_sql("meta", 20) + " SELECT video_id, count(*) AS n, sum(cell)::BIGINT AS cells FROM grid GROUP BY video_id",
    "v4_thin_field": "WITH " + _META + ", " + _grid_sql("meta", 20) + " SELECT video_id, cell::BIGINT AS cell FROM grid WHERE (r0 // step) % 4 = 0 AND (c0 // step) % 4 = 0",
}

QUERIES = {
    q.__name__: q
    for q in (
        d9_sort_modes, d10_band_filter_modes, d11_drop_weak_modes, d12_fourier_amplitude, g1_build_grid, g2_tile_size, g3_clip_tiles, g4_g5_fit_tiles, g6_mask_cells, g7_k_tile_estimates,
        s2_crop_stride, s3_mask_polygon, s4_synthetic_waves, s7_interpolate_gridded, s7_interpolate_scattered, v4_thin_field, s1_read_frames, s5_read_soundings, s8_write_results,
    )
}
