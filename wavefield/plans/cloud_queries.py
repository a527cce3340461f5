"""Queries over spectral points (lineitem) and the grid of cells (supplier)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavefield.operators import cloud, fit, neighbours, validate
from wavefield.plans.adapters import CELLS_SQL, POINTS_SQL, cells, points, rounded, table

CELL = ["window_id", "cell"]
RADIUS, SPACING = 25.0, 10.0


def _rep(kind):
    def query(spark, d):
        return rounded(cloud.layer_representative(points(spark, d), kind), CELL, omega=4, kx=8, ky=8, w=8)

    return query


def c2_phase_velocity(spark, d):
    p = cloud.phase_velocity(points(spark, d)).groupBy("window_id", "cell").agg(F.sum("cx").alias("cx"), F.sum("cy").alias("cy"))
    return rounded(p, CELL, cx=3, cy=3)


def c3_gamma_filter(spark, d):
    p = cloud.gamma_filter(points(spark, d), 0.3, 1.0)
    return rounded(p.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("kx").alias("kx")), [*CELL, "n"], kx=4)


def c4_direction_filter(spark, d):
    return cloud.direction_filter(points(spark, d)).groupBy(*CELL).agg(F.count("*").alias("n"))


def c5_filter_cloud(spark, d):
    p = points(spark, d)
    return cloud.cloud_status(p, cloud.filter_cloud(p)).select(*CELL, "status")


def c5_filtered_points(spark, d):
    p = cloud.filter_cloud(points(spark, d)).groupBy(*CELL).agg(F.count("*").alias("n"), F.count_distinct("omega").alias("n_layers"), F.sum("kx").alias("kx"), F.sum("ky").alias("ky"))
    return rounded(p, [*CELL, "n", "n_layers"], kx=6, ky=6)


def _kernel(spark):
    return neighbours.disc_kernel(spark, RADIUS, SPACING)


def c6_disc_kernel(spark, d):
    """Offsets around every cell, inside the grid or not."""
    return cells(spark, d).select("cell").crossJoin(_kernel(spark)).select("cell", F.col("dr").cast("long").alias("dr"), F.col("dc").cast("long").alias("dc"))


def c7_sample_kernel(spark, d):
    windows = points(spark, d).select("video_id", "window_id").distinct()
    return neighbours.sample_kernel(windows, _kernel(spark), 8, 5).select("window_id", F.col("dr").cast("long").alias("dr"), F.col("dc").cast("long").alias("dc"))


def c8_neighbour_cells(spark, d):
    return neighbours.neighbour_cells(cells(spark, d), _kernel(spark)).select("cell", "neighbour")


def _windows(p):
    return p.select("video_id", "window_id", "t").distinct()


def c9_recent_points(spark, d):
    p = points(spark, d)
    return rounded(neighbours.recent_points(p, _windows(p)).groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("kx").alias("kx")), [*CELL, "n"], kx=3)


def _combined(spark, d):
    p = points(spark, d)
    stored = neighbours.recent_points(p, _windows(p), 30)
    near = neighbours.neighbour_points(stored, neighbours.neighbour_cells(cells(spark, d), neighbours.disc_kernel(spark, 15.0, SPACING)))
    return neighbours.combine_points(p, stored, near)


def c10_combine_points(spark, d):
    return rounded(_combined(spark, d).groupBy(*CELL, "src").agg(F.count("*").alias("n"), F.sum("w").alias("w")), [*CELL, "src", "n"], w=10)


def c11_layer_gate(spark, d):
    return cloud.layer_gate(points(spark, d)).groupBy(*CELL).agg(F.count("*").alias("n"))


def c12_layer_weights(spark, d):
    p = cloud.layer_weights(points(spark, d))
    return rounded(p.groupBy(*CELL).agg(F.sum("layer_w").alias("total")), CELL, total=5)


def c13_period_bins(spark, d):
    """The period bins of every window."""
    bins = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("bin"), F.lit(o).alias("omega")) for i, o in cloud.period_bins()])).alias("b")
    return rounded(points(spark, d).select("window_id").distinct().select("window_id", bins).select("window_id", "b.*"), ["window_id", "bin"], omega=6)


def c14_nearest_bin(spark, d):
    return cloud.nearest_bin(points(spark, d)).groupBy("window_id", F.col("period_bin").cast("long").alias("period_bin")).agg(F.count("*").alias("n"))


def c15_binned_phase_speed(spark, d):
    s = cloud.binned_phase_speed(cloud.layer_representative(points(spark, d)))
    finite = s.withColumns({c: F.when(F.col(c) < 1e9, F.col(c)) for c in ("var_cx", "var_cy")})
    return rounded(finite, [*CELL, F.col("period_bin").cast("long").alias("period_bin")], cx=3, cy=3, var_cx=2, var_cy=2)


def c16_store_points(spark, d):
    p = cloud.store_points(cloud.gamma_filter(points(spark, d), 0.3, 1.0)).groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("ky").alias("ky"))
    # means of points of few decimals often lie halfway: as in SQL the double's product is rounded, not its printed decimals
    return rounded(p.withColumn("ky", F.col("ky") * 10**4), [*CELL, "n"], ky=0).withColumn("ky", F.col("ky") / 10**4)


def f1_depth_seed(spark, d):
    return rounded(fit.depth_seed(cloud.layer_weights(points(spark, d)).withColumn("w", F.col("w") * F.col("layer_w"))), CELL, d0=4)


def f2_dispersion(spark, d):
    p = points(spark, d).withColumn("m", fit.dispersion(cloud.norm(), F.col("kx"), F.col("ky"), F.lit(4.0), F.lit(0.2), F.lit(-0.1)))
    return rounded(p.groupBy(*CELL).agg(F.sum("m").alias("m")), CELL, m=5)


def f3_fit_depth(spark, d):
    return rounded(fit.fit_depth(cloud.layer_gate(points(spark, d))), CELL, d=3, rmse=3)


def f4_fit_depth_current(spark, d):
    p = cloud.layer_gate(cloud.layer_weights(points(spark, d)).withColumn("w", F.col("w") * F.col("layer_w")))
    return rounded(fit.fit_depth_current(p), CELL, d=3, u=3, v=3)


def f5_fit_softbound(spark, d):
    return rounded(fit.fit_depth_current(cloud.layer_gate(points(spark, d)), mode="softbound"), CELL, d=3, u=3, v=3)


def f6_fit_confidence(spark, d):
    return rounded(fit.fit_depth_current(cloud.layer_gate(points(spark, d))), CELL, conf_d=2, conf_u=2, conf_v=2)


def f7_fit_quality(spark, d):
    """rmse and r2 of the linear dispersion at a fixed depth, by the same rules."""
    p = points(spark, d).withColumn("m", fit.dispersion(cloud.norm(), F.col("kx"), F.col("ky"), F.lit(4.0), F.lit(0.0), F.lit(0.0)))
    e = F.col("m") - F.col("omega")
    s = p.groupBy("video_id", *CELL).agg(F.sum(e * e).alias("rss"), F.sum(F.col("omega") * F.col("omega")).alias("s2"), F.sum("omega").alias("s1"), F.count("*").alias("n"))
    total = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")
    q = s.where("n > 3").withColumn("rmse", F.sqrt(F.col("rss") / (F.col("n") - 3))).withColumn("r2", F.when(total > 1e-9, 1 - F.col("rss") / total))
    return rounded(fit.fit_quality(q), [*CELL, "n"], rmse=5, r2=5)


def f8_flip_sign(spark, d):
    return rounded(fit.flip_sign(cloud.phase_velocity(points(spark, d))).groupBy(*CELL).agg(F.sum("cx").alias("cx"), F.sum("cy").alias("cy")), CELL, cx=3, cy=3)


def k5_combine_estimates(spark, d):
    from wavefield.operators import tiles

    p = points(spark, d).select(
        "video_id", "window_id", "cell", "omega", F.array(F.col("kx"), F.col("kx") / 2).alias("kx"), F.array(F.col("ky"), -F.col("ky")).alias("ky"), (F.col("w") * 5).alias("e_fft"),
        F.when(F.col("w") > 0.03, F.col("kx") * 9).otherwise(0.0).alias("cx"), F.when(F.col("w") > 0.03, F.col("ky") * 3).otherwise(0.0).alias("cy"), F.col("w").alias("e_piv"),
    )
    out = tiles.combine_estimates(p)
    return rounded(out.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum("kx").alias("kx")), [*CELL, "n"], w=4, kx=3)


def k6_collect_cloud(spark, d):
    return cloud.count_layers(points(spark, d)).select(*CELL, "n_layers", "n_points")


def v3_layers_per_cell(spark, d):
    n = table(spark, d, "supplier").count()
    p = points(spark, d)
    return rounded(cloud.layers_per_cell(p, _windows(p), n), ["window_id"], layers_per_cell=5)


def v4_thin_vectors(spark, d):
    return validate.thin_vectors(cells(spark, d), 3).select("cell")


_WITH = "WITH " + POINTS_SQL
_G = "sqrt(kx * kx + ky * ky)"
_BINS = ", ".join(f"({i}, {o!r}::DOUBLE)" for i, o in cloud.period_bins())
_DIFF = """ rep AS (SELECT window_id, cell, omega, sum(kx * w) / sum(w) AS kx, sum(ky * w) / sum(w) AS ky, sum(w * w) / sum(w) AS w FROM pts GROUP BY window_id, cell, omega)"""
_GAMMA = _WITH + "," + _DIFF + f", good AS (SELECT window_id, cell, omega FROM rep WHERE {_G} > 0 AND omega * omega / (9.81::DOUBLE * {_G}) BETWEEN 0.3 AND 1.0)"
_KERNEL = "k AS (SELECT dr, dc FROM (SELECT unnest(range(-{h}, {h} + 1)) AS dr), (SELECT unnest(range(-{h}, {h} + 1)) AS dc) WHERE (dr * dr + dc * dc) * 100 <= {r2} AND NOT (dr = 0 AND dc = 0))"
_PAIRS = CELLS_SQL + ", us AS (SELECT * FROM cells WHERE usable), nb AS (SELECT a.cell, b.cell AS neighbour FROM us a, k JOIN us b ON true JOIN us m ON true WHERE b.cell_row = a.cell_row + dr AND b.cell_col = a.cell_col + dc AND m.cell_row = a.cell_row - dr AND m.cell_col = a.cell_col - dc)"
_RECENT = "win AS (SELECT window_id, t, lag(t) OVER (ORDER BY t) AS t1 FROM (SELECT DISTINCT window_id, t FROM pts)), past AS (SELECT a.window_id, b.window_id AS past_id FROM win a JOIN win b ON b.t < a.t AND floor(a.t1) - floor(b.t) <= {s})"
_R = "round(omega, 4) AS omega, round(kx, 8) + 0.0 AS kx, round(ky, 8) + 0.0 AS ky, round(w, 8) + 0.0 AS w"
_F2 = f"sqrt(9.81::DOUBLE * {_G} * ((exp(2 * {_G} * 4) - 1) / (exp(2 * {_G} * 4) + 1)))"



def _direction_sql(src: str, dst: str, layers: int = 0) -> str:
    """The direction filter: powers of each cell's moment matrix, scaled to trace one, tend to a a' for its
    principal axis a, and p' a a' p is the squared projection of p."""
    square = "(a*a+b*b+c*c)/t, (a*b+b*d+c*e)/t, (a*c+b*e+c*f)/t, (b*b+d*d+e*e)/t, (b*c+d*e+e*f)/t, (c*c+e*e+f*f)/t"
    moments = "sum(kx*kx)/s, sum(kx*ky)/s, sum(kx*omega)/s, sum(ky*ky)/s, sum(ky*omega)/s, sum(omega*omega)/s".replace("/s", " / sum(kx*kx + ky*ky + omega*omega)")
    return (
        f"{dst}_m(window_id, cell, i, a, b, c, d, e, f) AS (SELECT window_id, cell, 0, {moments} FROM {src} GROUP BY window_id, cell "
        f"UNION ALL SELECT window_id, cell, i + 1, {square} FROM (SELECT *, a*a + d*d + f*f + 2 * (b*b + c*c + e*e) AS t FROM {dst}_m WHERE i < 24)), "
        f"{dst}_l AS (SELECT window_id, cell, count(DISTINCT omega) AS l FROM {src} GROUP BY window_id, cell), "
        f"{dst} AS (SELECT p.* FROM {src} p JOIN {dst}_m USING (window_id, cell) JOIN {dst}_l USING (window_id, cell) WHERE i = 24 AND "
        f"(l < {layers} OR kx*kx*a + ky*ky*d + omega*omega*f + 2 * (kx*ky*b + kx*omega*c + ky*omega*e) >= omega * omega * (1 - 1e-12::DOUBLE)))"
    )


def _gamma_sql(src: str, dst: str, low: float, high: float) -> str:
    rep = f"{dst}_r AS (SELECT window_id, cell, omega, sqrt(pow(sum(kx * w) / sum(w), 2) + pow(sum(ky * w) / sum(w), 2)) AS k FROM {src} GROUP BY window_id, cell, omega)"
    return rep + f", {dst} AS (SELECT p.* FROM {src} p JOIN {dst}_r USING (window_id, cell, omega) WHERE k > 0 AND omega * omega / (9.81::DOUBLE * k) BETWEEN {low} AND {high})"


_STEPS = ", ".join([_direction_sql("pts", "s1", 5), _gamma_sql("s1", "s2", 0.0, 1.5), _direction_sql("s2", "s3", 3), _gamma_sql("s3", "s4", 0.3, 1.0)])

ORACLES = {
    "c4_direction_filter": "WITH RECURSIVE " + POINTS_SQL + ", " + _direction_sql("pts", "s1") + " SELECT window_id, cell, count(*) AS n FROM s1 GROUP BY window_id, cell",
    "c5_filter_cloud": "WITH RECURSIVE " + POINTS_SQL + ", " + _STEPS + f""", n AS (SELECT window_id, cell, count(*) AS n, count(DISTINCT omega) AS l FROM s4 WHERE {_G} > 0 GROUP BY window_id, cell)
      SELECT window_id, cell, CASE WHEN n IS NULL THEN 1 WHEN l < 3 THEN 2 WHEN n < 3 THEN 3 ELSE 0 END::INTEGER AS status FROM (SELECT DISTINCT window_id, cell FROM pts) LEFT JOIN n USING (window_id, cell)""",
    "c5_filtered_points": "WITH RECURSIVE " + POINTS_SQL + ", " + _STEPS + f" SELECT window_id, cell, count(*) AS n, count(DISTINCT omega) AS n_layers, round(sum(kx), 6) + 0.0 AS kx, round(sum(ky), 6) + 0.0 AS ky FROM s4 WHERE {_G} > 0 GROUP BY window_id, cell",
    "c1_representative_same": _WITH + ", rep AS (SELECT window_id, cell, omega, median(kx) AS kx, median(ky) AS ky, median(w) AS w FROM pts GROUP BY window_id, cell, omega) SELECT window_id, cell, " + _R + " FROM rep",
    "c1_representative_diff": _WITH + "," + _DIFF + " SELECT window_id, cell, " + _R + " FROM rep",
    "c1_representative_best": _WITH + ", rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id, cell, omega ORDER BY w DESC, kx DESC, ky DESC) AS rn FROM pts) WHERE rn = 1) SELECT window_id, cell, " + _R + " FROM rep",
    "c2_phase_velocity": _WITH + " SELECT window_id, cell, round(sum(omega * kx / (kx * kx + ky * ky)), 3) + 0.0 AS cx, round(sum(omega * ky / (kx * kx + ky * ky)), 3) + 0.0 AS cy FROM pts GROUP BY window_id, cell",
    "f8_flip_sign": _WITH + " SELECT window_id, cell, round(-sum(omega * kx / (kx * kx + ky * ky)), 3) + 0.0 AS cx, round(-sum(omega * ky / (kx * kx + ky * ky)), 3) + 0.0 AS cy FROM pts GROUP BY window_id, cell",
    "c3_gamma_filter": _GAMMA + " SELECT window_id, cell, count(*) AS n, round(sum(kx), 4) + 0.0 AS kx FROM pts JOIN good USING (window_id, cell, omega) GROUP BY window_id, cell",
    "c16_store_points": _GAMMA + " SELECT window_id, cell, count(*) AS n, round(sum(ky), 4) + 0.0 AS ky FROM rep JOIN good USING (window_id, cell, omega) GROUP BY window_id, cell",
    "c6_disc_kernel": "WITH " + _KERNEL.format(h=2, r2=625) + ", " + CELLS_SQL + " SELECT cell, dr, dc FROM cells, k",
    "c7_sample_kernel": _WITH + ", " + _KERNEL.format(h=2, r2=625) + ", q AS (SELECT window_id, dr, dc, row_number() OVER (PARTITION BY window_id ORDER BY md5(concat_ws('/', '5', 'li', window_id::VARCHAR, dr::VARCHAR, dc::VARCHAR))) AS rn FROM (SELECT DISTINCT window_id FROM pts), k WHERE dr >= 0 AND dc > 0), p AS (SELECT * FROM q WHERE rn <= 2) SELECT window_id, dr, dc FROM p UNION ALL SELECT window_id, -dc, dr FROM p UNION ALL SELECT window_id, -dr, -dc FROM p UNION ALL SELECT window_id, dc, -dr FROM p",
    "c8_neighbour_cells": "WITH " + _KERNEL.format(h=2, r2=625) + ", " + _PAIRS + " SELECT cell, neighbour FROM nb",
    "c9_recent_points": _WITH + ", " + _RECENT.format(s=60) + " SELECT past.window_id, cell, count(*) AS n, round(sum(kx), 3) + 0.0 AS kx FROM pts JOIN past ON pts.window_id = past.past_id GROUP BY past.window_id, cell",
    "c10_combine_points": _WITH + ", " + _RECENT.format(s=30) + ", " + _KERNEL.format(h=1, r2=225) + ", " + _PAIRS + """, st AS (SELECT past.window_id, cell, w FROM pts JOIN past ON pts.window_id = past.past_id),
      u AS (SELECT window_id, cell, w, 'current' AS src FROM pts UNION ALL SELECT window_id, cell, w, 'own' FROM st UNION ALL SELECT window_id, nb.cell, w, 'neighbour' FROM st JOIN nb ON st.cell = nb.neighbour),
      c AS (SELECT *, count(*) OVER (PARTITION BY window_id, cell, src) AS n, max(CASE WHEN src <> 'current' THEN 1 ELSE 0 END) OVER (PARTITION BY window_id, cell) AS s FROM u),
      v AS (SELECT window_id, cell, src, CASE WHEN s = 0 THEN w ELSE w / n * CASE WHEN src = 'current' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END END AS w FROM c),
      m AS (SELECT *, w / max(w) OVER (PARTITION BY window_id, cell) AS r FROM v) SELECT window_id, cell, src, count(*) AS n, round(sum(r), 10) + 0.0 AS w FROM m GROUP BY window_id, cell, src""",
    "c11_layer_gate": _WITH + " SELECT window_id, cell, count(*) AS n FROM pts GROUP BY window_id, cell HAVING count(DISTINCT omega) >= 3",
    "c12_layer_weights": _WITH + ", l AS (SELECT window_id, cell, omega, 1.0::DOUBLE / count(*) AS s, count(*) AS n FROM pts GROUP BY window_id, cell, omega) SELECT window_id, cell, round(sum(s * n) / max(s), 5) + 0.0 AS total FROM l GROUP BY window_id, cell",
    "c13_period_bins": _WITH + f" SELECT window_id, bin::BIGINT AS bin, round(2 * pi() / (15 - bin), 6) AS omega FROM (SELECT DISTINCT window_id FROM pts), (SELECT unnest(range(0, 13)) AS bin)",
    "c14_nearest_bin": _WITH + f", b(i, o) AS (VALUES {_BINS}), l AS (SELECT omega, i FROM (SELECT omega, i, row_number() OVER (PARTITION BY omega ORDER BY abs(omega - o), i) AS rn FROM (SELECT DISTINCT omega FROM pts), b) WHERE rn = 1) SELECT window_id, i::BIGINT AS period_bin, count(*) AS n FROM pts JOIN l USING (omega) GROUP BY window_id, i",
    "c15_binned_phase_speed": _WITH + "," + _DIFF + f""", b(i, o) AS (VALUES {_BINS}), l AS (SELECT omega, i FROM (SELECT omega, i, row_number() OVER (PARTITION BY omega ORDER BY abs(omega - o), i) AS rn FROM (SELECT DISTINCT omega FROM pts), b) WHERE rn = 1),
      c AS (SELECT window_id, cell, i, w, CASE WHEN kx * kx + ky * ky > 0 THEN omega * kx / (kx * kx + ky * ky) ELSE 0 END AS cx, CASE WHEN kx * kx + ky * ky > 0 THEN omega * ky / (kx * kx + ky * ky) ELSE 0 END AS cy FROM rep JOIN l USING (omega)),
      m AS (SELECT *, avg(cx) OVER p AS mx, avg(cy) OVER p AS my FROM c WINDOW p AS (PARTITION BY window_id, cell, i))
      SELECT window_id, cell, i::BIGINT AS period_bin, round(sum(cx * w) / sum(w), 3) + 0.0 AS cx, round(sum(cy * w) / sum(w), 3) + 0.0 AS cy,
        CASE WHEN count(*) > 1 THEN round(sum(w * pow(cx - mx, 2)) / sum(w) / (1 - sum(w * w) / pow(sum(w), 2)), 2) + 0.0 END AS var_cx, CASE WHEN count(*) > 1 THEN round(sum(w * pow(cy - my, 2)) / sum(w) / (1 - sum(w * w) / pow(sum(w), 2)), 2) + 0.0 END AS var_cy FROM m GROUP BY window_id, cell, i""",
    "f1_depth_seed": _WITH + f""", l AS (SELECT *, count(*) OVER (PARTITION BY window_id, cell, omega) AS n FROM pts), m AS (SELECT *, w / n / (max(1.0::DOUBLE / n) OVER (PARTITION BY window_id, cell)) AS ww FROM l),
      e AS (SELECT window_id, cell, sum(CASE WHEN omega * omega / (9.81::DOUBLE * {_G}) < 1 THEN atanh(CASE WHEN omega * omega / (9.81::DOUBLE * {_G}) < 1 THEN omega * omega / (9.81::DOUBLE * {_G}) ELSE 0 END) / {_G} * ww END) / sum(ww) AS d FROM m GROUP BY window_id, cell)
      SELECT window_id, cell, round(CASE WHEN d BETWEEN 0.1 AND 50 THEN d ELSE 5 END, 4) AS d0 FROM e""",
    "f2_dispersion": _WITH + f" SELECT window_id, cell, round(sum({_F2} + 0.2::DOUBLE * kx - 0.1::DOUBLE * ky), 5) + 0.0 AS m FROM pts GROUP BY window_id, cell",
    "f7_fit_quality": _WITH + f""", e AS (SELECT window_id, cell, sum(pow({_F2} - omega, 2)) AS rss, sum(omega * omega) - sum(omega) * sum(omega) / count(*) AS total, count(*) AS n FROM pts GROUP BY window_id, cell HAVING count(*) > 3),
      q AS (SELECT *, round_even(sqrt(rss / (n - 3)) / 0.002::DOUBLE, 0) * 0.002::DOUBLE AS rm, CASE WHEN total > 1e-9 THEN round_even((1 - rss / total) / 0.002::DOUBLE, 0) * 0.002::DOUBLE END AS r FROM e)
      SELECT window_id, cell, n, CASE WHEN r >= 0 THEN round(rm, 5) + 0.0 END AS rmse, CASE WHEN r >= 0 THEN round(r, 5) + 0.0 END AS r2 FROM q""",
    "k5_combine_estimates": _WITH + """, e AS (SELECT *, w * 5 AS ef, CASE WHEN w > 0.03 THEN kx * 9 ELSE 0 END AS cx, CASE WHEN w > 0.03 THEN ky * 3 ELSE 0 END AS cy FROM pts),
      f AS (SELECT *, sqrt(cx * cx + cy * cy) AS c, sqrt(0.981::DOUBLE) AS c0 FROM e), o AS (SELECT window_id, cell, kx, (1 - ef) / 2 AS w FROM f UNION ALL SELECT window_id, cell, kx / 2, (1 - ef) / 2 FROM f UNION ALL SELECT window_id, cell, omega * cx / (c * c), 1 - w FROM f WHERE c >= c0)
      SELECT window_id, cell, count(*) AS n, round(sum(w), 4) + 0.0 AS w, round(sum(kx), 3) + 0.0 AS kx FROM o GROUP BY window_id, cell""",
    "k6_collect_cloud": _WITH + " SELECT window_id, cell, count(DISTINCT omega) AS n_layers, count(*) AS n_points FROM pts GROUP BY window_id, cell",
    "v3_layers_per_cell": _WITH + " SELECT window_id, round(count(DISTINCT (cell, omega)) / (SELECT count(*) FROM supplier), 5) AS layers_per_cell FROM pts GROUP BY window_id",
    "v4_thin_vectors": "WITH " + CELLS_SQL + " SELECT cell FROM cells WHERE cell_row % 3 = 0 AND cell_col % 3 = 0",
}

QUERIES = {f"c1_representative_{k}": _rep(k) for k in ("same", "diff", "best")} | {
    q.__name__: q
    for q in (
        c2_phase_velocity, c3_gamma_filter, c4_direction_filter, c5_filter_cloud, c5_filtered_points, c6_disc_kernel, c7_sample_kernel, c8_neighbour_cells, c9_recent_points, c10_combine_points, c11_layer_gate,
        c12_layer_weights, c13_period_bins, c14_nearest_bin, c15_binned_phase_speed, c16_store_points, f1_depth_seed, f2_dispersion, f3_fit_depth, f4_fit_depth_current, f5_fit_softbound, f6_fit_confidence,
        f7_fit_quality, f8_flip_sign, k5_combine_estimates, k6_collect_cloud, v3_layers_per_cell, v4_thin_vectors,
    )
}
