"""Queries over observations (events): Kalman tracks, windows of a frame feed and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavefield.operators import preprocess, track, validate, windows
from wavefield.plans.adapters import OBS_SQL, observations, rounded, soundings, table
from wavefield.sources.soundings import soundings_to_depth

Q = 0.01


def t1_kalman_track(spark, d):
    return rounded(track.kalman_track(observations(spark, d), Q), ["cell", "variable"], xhat=5, p=5, t_last=3)


def t1_kalman_history(spark, d):
    return rounded(track.kalman_history(observations(spark, d), Q), ["cell", "variable", "seq"], xhat=5, p=5)


def t2_kalman_running(spark, d):
    return rounded(track.kalman_running(observations(spark, d)), ["cell", "variable", "seq"], xhat=5, p=6)


def t3_observation_error(spark, d):
    return rounded(track.kalman_history(observations(spark, d), Q, "x_diff2"), ["cell", "variable", "seq"], xhat=5, p=5)


def _frames(spark, d):
    feed = table(spark, d, "events").select((F.col("user_id") % 4).cast("string").alias("video_id"), F.col("event_id").alias("at"), "value")
    return preprocess.frame_rank(feed)


def _windowed(spark, d):
    f = _frames(spark, d)
    lengths = f.groupBy("video_id").agg((F.max("frame") + 1).alias("n_frames"))
    return windows.frame_windows(f.join(lengths, "video_id"), F.col("n_frames"))


def w1_frame_windows(spark, d):
    w = _windowed(spark, d)
    stats = w.groupBy("video_id", F.col("window_id").cast("long").alias("window_id")).agg(F.count("*").alias("n"), F.min("frame").cast("long").alias("first"), F.sum("value").alias("total"))
    return rounded(stats, ["video_id", "window_id", "n", "first"], total=3)


def w2_window_time(spark, d):
    w = _windowed(spark, d).select("video_id", F.col("window_id").cast("long").alias("window_id")).distinct()
    return w.select("video_id", "window_id", windows.window_time(F.col("window_id"), 0.5).alias("t"))


def w3_frame_times(spark, d):
    w = _windowed(spark, d).select("video_id", F.col("window_id").cast("long").alias("window_id")).distinct()
    return w.select("video_id", "window_id", F.posexplode(windows.frame_times(0.5, 0, 64, stacked=True)).alias("i", "t")).select("video_id", "window_id", F.col("i").cast("long").alias("i"), "t")


def _maps(spark, d):
    """A depth per cell and window from the history of one variable of the events."""
    o = observations(spark, d).where("x IS NOT NULL")
    return o.select("video_id", "cell", (F.col("seq") % 20).alias("window_id"), (F.abs("x") / 10).alias("d"))


def _truth(spark, d):
    return soundings(spark, d).select(F.lit("ev").alias("video_id"), (F.col("x") / 10 + F.col("y") * 4).cast("long").alias("cell"), (soundings_to_depth(F.col("z"), 0.077) + F.when(F.col("x") == 70, 30.0).otherwise(0.0)).alias("depth"))


def v1_depth_error_stats(spark, d):
    return rounded(validate.depth_error_stats(_maps(spark, d), _truth(spark, d)), ["window_id", "n"], bias=5, rmse=5, rmse_unbiased=5)


def v2_truth_pairs(spark, d):
    p = validate.truth_pairs(_maps(spark, d), _truth(spark, d))
    return rounded(p.groupBy("cell").agg(F.count("*").alias("n"), F.max("truth").alias("truth"), F.sum("d").alias("total")), ["cell", "n"], truth=5, total=4)


def s6_soundings_to_depth(spark, d):
    s = soundings(spark, d).select("x", "y", soundings_to_depth(F.col("z"), 0.077).alias("down"), soundings_to_depth(F.col("z"), 9.6, 1, 0.3).alias("up"))
    return rounded(s, ["x", "y"], down=5, up=5)


_RECURSIVE = (
    "WITH RECURSIVE " + OBS_SQL + """,
n AS (SELECT *, row_number() OVER (PARTITION BY cell, variable ORDER BY t, seq) AS rn FROM obs),
k AS (SELECT cell, variable, rn, seq, x AS xhat, {first} AS p, t AS t_last FROM n WHERE rn = 1
  UNION ALL SELECT n.cell, n.variable, n.rn, n.seq,
    CASE WHEN k.xhat IS NULL THEN n.x WHEN n.x IS NULL OR {r} IS NULL THEN k.xhat ELSE k.xhat + (k.p + {q} * (n.t - k.t_last)) / (k.p + {q} * (n.t - k.t_last) + {r}) * (n.x - k.xhat) END,
    CASE WHEN k.xhat IS NULL THEN {again} WHEN n.x IS NULL OR {r} IS NULL THEN k.p ELSE (1 - (k.p + {q} * (n.t - k.t_last)) / (k.p + {q} * (n.t - k.t_last) + {r})) * (k.p + {q} * (n.t - k.t_last)) END,
    CASE WHEN k.xhat IS NULL OR NOT (n.x IS NULL OR {r} IS NULL) THEN n.t ELSE k.t_last END
  FROM k JOIN n ON n.cell = k.cell AND n.variable = k.variable AND n.rn = k.rn + 1)"""
)
_FIT = _RECURSIVE.format(first="r", again="n.r", r="n.r", q=Q)
_DIFF = _RECURSIVE.format(first="CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE END", again="CASE WHEN n.x IS NOT NULL THEN 2.0::DOUBLE END", r="CASE WHEN abs(n.x - k.xhat) = 0 THEN 1e-7::DOUBLE ELSE abs(n.x - k.xhat) END", q=Q)
_FRAMES = "f AS (SELECT (user_id % 4)::VARCHAR AS video_id, value, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS frame FROM events)"
_WIN = _FRAMES + ", l AS (SELECT video_id, max(frame) + 1 AS n FROM f GROUP BY video_id), w AS (SELECT video_id, unnest(range(0, (n - 64) // 32 + 1)) AS window_id FROM l WHERE n >= 64)"
_TRUTH = """maps AS (SELECT cell, seq % 20 AS window_id, abs(x) / 10 AS d FROM obs WHERE x IS NOT NULL),
t0 AS (SELECT p_partkey AS cell, CASE WHEN p_retailprice / 100 + 0.077::DOUBLE >= 0.1 THEN p_retailprice / 100 + 0.077::DOUBLE END + CASE WHEN p_partkey % 40 = 7 THEN 30.0 ELSE 0.0 END AS depth FROM part),
truth AS (SELECT * FROM t0 WHERE depth <= 35), pairs AS (SELECT * FROM maps JOIN truth USING (cell))"""

ORACLES = {
    "t1_kalman_track": _FIT + " SELECT cell, variable, round(arg_max(xhat, rn), 5) + 0.0 AS xhat, round(arg_max(p, rn), 5) + 0.0 AS p, round(arg_max(t_last, rn), 3) + 0.0 AS t_last FROM (SELECT cell, variable, max(rn) AS rn FROM k GROUP BY cell, variable) JOIN k USING (cell, variable, rn) GROUP BY cell, variable",
    "t1_kalman_history": _FIT + " SELECT cell, variable, seq, round(xhat, 5) + 0.0 AS xhat, round(p, 5) + 0.0 AS p FROM k",
    "t3_observation_error": _DIFF + " SELECT cell, variable, seq, round(xhat, 5) + 0.0 AS xhat, round(p, 5) + 0.0 AS p FROM k",
    "t2_kalman_running": "WITH " + OBS_SQL + ", w AS (SELECT *, sum(CASE WHEN x IS NOT NULL THEN 1 / r END) OVER o AS s, sum(x / r) OVER o AS m FROM obs WINDOW o AS (PARTITION BY cell, variable ORDER BY t, seq ROWS UNBOUNDED PRECEDING)) SELECT cell, variable, seq, round(m / s, 5) + 0.0 AS xhat, round(1 / s, 6) + 0.0 AS p FROM w",
    "w1_frame_windows": "WITH " + _FRAMES + ", l AS (SELECT video_id, max(frame) + 1 AS n FROM f GROUP BY video_id), w AS (SELECT video_id, unnest(range(0, (n - 64) // 32 + 1)) AS window_id FROM l WHERE n >= 64) SELECT video_id, window_id, count(*) AS n, min(frame) AS first, round(sum(value), 3) + 0.0 AS total FROM w JOIN f USING (video_id) WHERE frame BETWEEN window_id * 32 AND window_id * 32 + 63 GROUP BY video_id, window_id",
    "w2_window_time": "WITH " + _WIN + " SELECT video_id, window_id, (window_id * 32 + 32) * 0.5::DOUBLE AS t FROM w",
    "w3_frame_times": "WITH " + _WIN + " SELECT video_id, window_id, i, i * 0.5::DOUBLE AS t FROM w, (SELECT unnest(range(0, 63)) AS i)",
    "v1_depth_error_stats": "WITH " + OBS_SQL + "," + _TRUTH + " SELECT window_id, count(*) AS n, round(avg(depth - d), 5) + 0.0 AS bias, round(sqrt(avg((depth - d) * (depth - d))), 5) + 0.0 AS rmse, round(sqrt(greatest(0, avg((depth - d) * (depth - d)) - avg(depth - d) * avg(depth - d))), 5) + 0.0 AS rmse_unbiased FROM pairs GROUP BY window_id",
    "v2_truth_pairs": "WITH " + OBS_SQL + "," + _TRUTH + " SELECT cell, count(*) AS n, round(max(depth), 5) + 0.0 AS truth, round(sum(d), 4) + 0.0 AS total FROM pairs GROUP BY cell",
    "s6_soundings_to_depth": "WITH s AS (SELECT p_partkey % 40 * 10.0::DOUBLE AS x, (p_partkey // 40) * 10.0::DOUBLE AS y, p_retailprice / 100 + 0.077::DOUBLE AS a, -p_retailprice / 100 + 9.6::DOUBLE AS b FROM part) SELECT x, y, CASE WHEN a >= 0.1 THEN round(a, 5) + 0.0 END AS down, CASE WHEN b >= 0.3 THEN round(b, 5) + 0.0 END AS up FROM s",
}

QUERIES = {
    q.__name__: q
    for q in (t1_kalman_track, t1_kalman_history, t2_kalman_running, t3_observation_error, w1_frame_windows, w2_window_time, w3_frame_times, v1_depth_error_stats, v2_truth_pairs, s6_soundings_to_depth)
}
