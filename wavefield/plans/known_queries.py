"""Queries whose answers are known beforehand: points and signals are made from the tables by a rule, operators that SQL
cannot express must find the rule's numbers again."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wavefield.operators import cloud, fit, linalg
from wavefield.plans.adapters import DT, rounded, table

CELL = ["window_id", "cell"]
#: Frames of a window; cycles of its waves within the window, and how much faster each is in the next window.
NT, CYCLES = 64, (4, 7, 11)
#: A cell is fitted with so many points at least.
POINTS = 12


def _known_points(spark, d, current=True):
    """lineitem as points that obey the dispersion relation: a depth and a current by supplier, a wavenumber by line and part."""
    depth = 1 + F.col("l_suppkey") % 7 * 0.5
    u, v = (((F.col("l_suppkey") % 5) - 2) / 20, ((F.col("l_suppkey") % 3) - 1) / 20) if current else (F.lit(0.0), F.lit(0.0))
    k, angle = 0.06 + 0.05 * F.col("l_linenumber"), F.col("l_partkey") % 12 * (math.pi / 6)
    p = table(spark, d, "lineitem").select(F.lit("li").alias("video_id"), F.year("l_shipdate").cast("long").alias("window_id"), F.col("l_suppkey").alias("cell"), depth.alias("depth"), u.alias("u0"), v.alias("v0"), (k * F.cos(angle)).alias("kx"), (k * F.sin(angle)).alias("ky"), (F.col("l_tax") + 0.01).alias("w"))
    p = p.withColumn("omega", fit.dispersion(cloud.norm(), F.col("kx"), F.col("ky"), F.col("depth"), F.col("u0"), F.col("v0"))).drop("depth", "u0", "v0")
    return cloud.enough_points(p, POINTS)


def f3_known_depth(spark, d):
    """Depths of still water."""
    return rounded(fit.fit_depth(_known_points(spark, d, False)), [*CELL, F.col("n_points").cast("long").alias("n")], d=2, rmse=3)


def f4_known_depth_and_current(spark, d):
    """Depths, currents and their errors, which exact points leave at nothing."""
    return rounded(fit.fit_depth_current(_known_points(spark, d)), [*CELL, F.col("n_points").cast("long").alias("n")], d=2, u=2, v=2, conf_d=2, conf_u=2, conf_v=2, rmse=3, r2=3)


def _known_signals(spark, d):
    """part as pixels of complex series: three waves of each window, with amplitudes and phases by pixel."""
    key, w = F.col("p_partkey"), F.col("p_partkey") % 5
    turns = [2 * math.pi * (c + w / 4) / NT for c in CYCLES]
    phases = [key * (i + 1) * 0.7 for i in range(3)]
    sizes = [1 + (key % (i + 2)) / 4 for i in range(3)]
    series = lambda f: F.transform(F.sequence(F.lit(0), F.lit(NT - 1)), lambda t: sum((a * f(x * t + p) for a, x, p in zip(sizes, turns, phases, strict=True)), F.lit(0.0)))
    return table(spark, d, "part").select(F.lit("pa").alias("video_id"), w.cast("long").alias("window_id"), key.alias("pixel"), (key % 40).cast("int").alias("row"), F.floor(key / 40).cast("int").alias("col"), series(F.cos).alias("re"), series(F.sin).alias("im"))


def _frequencies(modes):
    return rounded(modes.select("window_id", (F.abs("alpha_im")).alias("omega"), (F.abs("alpha_re") < 1e-4).alias("steady")), ["window_id", "steady"], omega=4)


def d5_known_first_frequencies(spark, d):
    """Where the fit starts; one step of pure waves gives their frequencies at once."""
    return _frequencies(linalg.initial_frequencies(linalg.tall_svd(linalg.triangular(_known_signals(spark, d)), 3), DT, "equidistant"))


def d6_known_modes(spark, d):
    return _frequencies(linalg.fit_modes(linalg.tall_svd(linalg.triangular(_known_signals(spark, d)), 3), DT, stacked=False))


def d7_known_exact_modes(spark, d):
    return _frequencies(linalg.exact_modes(linalg.triangular(_known_signals(spark, d)), 3, DT))


def d8_known_mode_images(spark, d):
    """Each mode's image has the pixels' sizes in its wave, to length 1: how far that is off, at most."""
    s = _known_signals(spark, d)
    modes = linalg.fit_modes(linalg.tall_svd(linalg.triangular(s), 3), DT, stacked=False)
    images = linalg.draw_modes(s, modes).withColumn("size", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    key = F.col("col") * 40 + F.col("row")
    wave = images.withColumn("true", F.when(F.col("mode") == 0, 1 + key % 2 / 4).when(F.col("mode") == 1, 1 + key % 3 / 4).otherwise(1 + key % 4 / 4))
    sums = wave.groupBy("window_id", "mode").agg(F.count("*").alias("n_pixels"), F.sum(F.col("size") * F.col("size")).alias("energy"), (F.max(F.col("size") / F.col("true")) / F.min(F.col("size") / F.col("true"))).alias("spread"))
    return rounded(sums, ["window_id", F.col("mode").cast("long").alias("mode"), "n_pixels"], energy=4, spread=4)


QUERIES = {q.__name__: q for q in (f3_known_depth, f4_known_depth_and_current, d5_known_first_frequencies, d6_known_modes, d7_known_exact_modes, d8_known_mode_images)}

_CELLS = f"SELECT year(l_shipdate)::BIGINT AS window_id, l_suppkey AS cell, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= {POINTS}"
_WAVES = f"""SELECT DISTINCT (p_partkey % 5)::BIGINT AS window_id, true AS steady, round(2 * pi() * (c + p_partkey % 5 / 4) / {NT} / {DT}, 4) + 0.0 AS omega
  FROM part, (VALUES {", ".join(f"({c})" for c in CYCLES)}) AS w(c)"""
ORACLES = {
    "f3_known_depth": f"SELECT window_id, cell, n, round(1 + cell % 7 * 0.5::DOUBLE, 2) AS d, 0.0::DOUBLE AS rmse FROM ({_CELLS})",
    "f4_known_depth_and_current": f"""SELECT window_id, cell, n, round(1 + cell % 7 * 0.5::DOUBLE, 2) AS d, round((cell % 5 - 2) / 20, 2) + 0.0 AS u, round((cell % 3 - 1) / 20, 2) + 0.0 AS v,
      0.0::DOUBLE AS conf_d, 0.0::DOUBLE AS conf_u, 0.0::DOUBLE AS conf_v, 0.0::DOUBLE AS rmse, 1.0::DOUBLE AS r2 FROM ({_CELLS})""",
    "d5_known_first_frequencies": _WAVES,
    "d6_known_modes": _WAVES,
    "d7_known_exact_modes": _WAVES,
    "d8_known_mode_images": "SELECT (p_partkey % 5)::BIGINT AS window_id, mode, count(*) AS n_pixels, 1.0::DOUBLE AS energy, 1.0::DOUBLE AS spread FROM part, (VALUES (0::BIGINT), (1), (2)) AS m(mode) GROUP BY ALL",
}
