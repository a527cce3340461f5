"""Spectral point clouds: points(video_id, window_id, t, cell, omega, kx, ky, w), a layer being the points
of one cell and one omega. All steps group by (video_id, window_id, cell[, omega]) with partial sums."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAVITY = 9.81
CELL = ["video_id", "window_id", "cell"]
LAYER = [*CELL, "omega"]


def norm(kx: Column | str = "kx", ky: Column | str = "ky") -> Column:
    kx, ky = (F.col(x) if isinstance(x, str) else x for x in (kx, ky))
    return F.sqrt(kx * kx + ky * ky)


def _weighted(of: str) -> Column:
    return F.sum(F.col(of) * F.col("w")) / F.sum("w")


def layer_representative(points: DataFrame, kind: str = "diff") -> DataFrame:
    """One point per layer. same: medians; diff: weighted mean, and sum(w^2)/sum(w); best: the point of
    the largest weight (then largest kx, ky)."""
    grouped = points.groupBy(*LAYER)
    if kind == "same":
        return grouped.agg(*[F.median(c).alias(c) for c in ("kx", "ky", "w")])
    if kind == "diff":
        return grouped.agg(_weighted("kx").alias("kx"), _weighted("ky").alias("ky"), (F.sum(F.col("w") * F.col("w")) / F.sum("w")).alias("w"))
    if kind == "best":
        return grouped.agg(F.max(F.struct("w", "kx", "ky")).alias("p")).select(*LAYER, "p.kx", "p.ky", "p.w")
    raise ValueError(f"unknown kind {kind!r}")


def phase_velocity(points: DataFrame) -> DataFrame:
    """cx and cy of omega along (kx, ky); 0 where k is 0."""
    k2 = F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky")
    along = lambda c: F.when(k2 > 0, F.col("omega") * F.col(c) / k2).otherwise(0.0)
    return points.withColumns({"cx": along("kx"), "cy": along("ky")})


def _with_representative(points: DataFrame, kind: str) -> DataFrame:
    """points with rx_ and ry_ of their layer's representative. A layer's points are few, and all steps on
    a cell share one distribution by CELL, so windows cost no further shuffle."""
    layer = Window.partitionBy(*LAYER)
    if kind == "same":
        each = {f"r{c[1]}_": F.median(c).over(layer) for c in ("kx", "ky")}
    elif kind == "diff":
        each = {f"r{c[1]}_": F.sum(F.col(c) * F.col("w")).over(layer) / F.sum("w").over(layer) for c in ("kx", "ky")}
    elif kind == "best":
        best = F.max(F.struct("w", "kx", "ky")).over(layer)
        each = {f"r{c[1]}_": best[c] for c in ("kx", "ky")}
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return points.withColumns(each)


def gamma_filter(points: DataFrame, low: float, high: float, kind: str = "diff") -> DataFrame:
    """Without the layers whose representative has omega^2 / (g k) outside [low, high], or no k."""
    k = norm("rx_", "ry_")
    gamma = F.col("omega") * F.col("omega") / (GRAVITY * k)
    return _with_representative(points, kind).where((k > 0) & gamma.between(low, high)).drop("rx_", "ry_")


def _principal(points: DataFrame) -> DataFrame:
    """points with along2_: the squared projection of (kx, ky, omega) on the cell's principal axis, the
    eigenvector of the largest eigenvalue of its uncentred second moments.

    With eigenvalues h1 >= h2 >= h3 of the moments M, (M - h2)(M - h3) / ((h1 - h2)(h1 - h3)) projects on the axis.
    They come in closed form: h = q + 2 s cos(angle), for q a third of the trace and s the root of a sixth of the
    sum of squares of M - q."""
    cell = Window.partitionBy(*CELL)
    names = {"a": ("kx", "kx"), "b": ("kx", "ky"), "c": ("kx", "omega"), "d": ("ky", "ky"), "e": ("ky", "omega"), "f": ("omega", "omega")}
    c = {n: F.col(f"{n}_") for n in [*names, *"qsrgh", "h1", "h2", "h3"]}
    out = points.withColumns({f"{n}_": F.sum(F.col(x) * F.col(y)).over(cell) for n, (x, y) in names.items()})
    out = out.withColumn("q_", (c["a"] + c["d"] + c["f"]) / 3)
    out = out.withColumns({f"{n}_": c[n] - c["q"] for n in "adf"})
    out = out.withColumn("s_", F.sqrt((c["a"] * c["a"] + c["d"] * c["d"] + c["f"] * c["f"] + 2 * (c["b"] * c["b"] + c["c"] * c["c"] + c["e"] * c["e"])) / 6))
    det = c["a"] * (c["d"] * c["f"] - c["e"] * c["e"]) - c["b"] * (c["b"] * c["f"] - c["e"] * c["c"]) + c["c"] * (c["b"] * c["e"] - c["d"] * c["c"])
    out = out.withColumn("r_", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(c["s"] > 0, det / (2 * c["s"] * c["s"] * c["s"])).otherwise(1.0)))) / 3)
    # eigenvalues of M - q
    out = out.withColumn("h1_", 2 * c["s"] * F.cos("r_")).withColumn("h3_", 2 * c["s"] * F.cos(c["r"] + 2 * math.pi / 3))
    out = out.withColumn("h2_", -c["h1"] - c["h3"])
    # (M - q - h3) p, then p' (M - q - h2) of that
    p = [F.col(x) for x in ("kx", "ky", "omega")]
    rows = [(c["a"], c["b"], c["c"]), (c["b"], c["d"], c["e"]), (c["c"], c["e"], c["f"])]
    out = out.withColumns({f"y{i}_": sum((rows[i][j] * p[j] for j in range(3)), -c["h3"] * p[i]) for i in range(3)})
    y = [F.col(f"y{i}_") for i in range(3)]
    product = sum(((sum((rows[i][j] * p[j] for j in range(3)), -c["h2"] * p[i])) * y[i] for i in range(3)), F.lit(0.0))
    gap = (c["h1"] - c["h2"]) * (c["h1"] - c["h3"])
    return out.withColumn("along2_", F.when(gap > 0, product / gap).otherwise(sum((x * x for x in p), F.lit(0.0)))).drop(*[f"{n}_" for n in [*names, "q", "s", "r", "h1", "h2", "h3", "y0", "y1", "y2"]])


def direction_filter(points: DataFrame, reflect: bool = False, layers: int = 0) -> DataFrame:
    """In cells of at least so many layers, without the points whose projection on the cell's principal
    axis (largest uncentred spread of kx, ky, omega) is below their omega, but for rounding; or, to reflect, with
    (kx, ky) of those turned round."""
    with_axis = _principal(points).withColumn("n_", F.size(F.collect_set("omega").over(Window.partitionBy(*CELL))))
    off = (F.col("along2_") < F.col("omega") * F.col("omega") * (1 - 1e-12)) & (F.col("n_") >= layers)
    if reflect:
        with_axis = with_axis.withColumn("off_", off).withColumns({c: F.when(F.col("off_"), -F.col(c)).otherwise(F.col(c)) for c in ("kx", "ky")}).drop("off_")
    else:
        with_axis = with_axis.where(~off)
    return with_axis.drop("along2_", "n_")


def count_layers(points: DataFrame) -> DataFrame:
    return points.groupBy(*CELL).agg(F.count_distinct("omega").alias("n_layers"), F.count("*").alias("n_points"))


def layer_gate(points: DataFrame, layers: int = 3) -> DataFrame:
    """Points of cells with at least so many layers."""
    n = F.size(F.collect_set("omega").over(Window.partitionBy(*CELL)))
    return points.withColumn("n_", n).where(F.col("n_") >= layers).drop("n_")


def filter_cloud(points: DataFrame, kind: str = "diff", limits: tuple[float, float] = (0.3, 1.0), reflect: bool = False) -> DataFrame:
    """Directions (cells of more than 4 layers), a wide Gamma filter, directions (3 layers or more), the
    Gamma limits, points without k; what is left comes as points. Cells are dealt out once, and all steps are
    column expressions over that distribution."""
    step = direction_filter(points, reflect, 5)
    step = direction_filter(gamma_filter(step, 0.0, 1.5, kind), reflect, 3)
    return gamma_filter(step, *limits, kind).where(norm() > 0)


def enough_points(points: DataFrame, least: int = 3) -> DataFrame:
    """Points of cells that have so many: fewer are not fitted, however many layers they are of."""
    return points.withColumn("n_", F.count("*").over(Window.partitionBy(*CELL))).where(F.col("n_") >= least).drop("n_")


def cloud_status(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per cell of before: 1 nothing left, 2 under 3 layers, 3 under 3 points, else 0."""
    counts = before.select(*CELL).distinct().join(count_layers(after), CELL, "left")
    none = F.coalesce(F.col("n_points"), F.lit(0)) == 0
    status = F.when(none, 1).when(F.col("n_layers") < 3, 2).when(F.col("n_points") < 3, 3).otherwise(0)
    return counts.select(*CELL, status.alias("status"))


def layer_weights(points: DataFrame) -> DataFrame:
    """layer_w: 1 / points of the layer, over the largest of that in the cell."""
    share = 1 / F.count("*").over(Window.partitionBy(*LAYER))
    with_share = points.withColumn("share", share)
    return with_share.withColumn("layer_w", F.col("share") / F.max("share").over(Window.partitionBy(*CELL))).drop("share")


def period_bins(limits: tuple[float, float] = (1 / 3, 1 / 15), step: float = 1.0) -> list[tuple[int, float]]:
    """(period_bin, omega) of evenly spaced periods from the longest to the shortest."""
    longest, shortest = 1 / limits[1], 1 / limits[0]
    n = int((longest - shortest + 1) / step + 1e-9)
    return [(i, 2 * math.pi / (longest + (shortest - longest) * i / max(1, n - 1))) for i in range(n)]


def nearest_bin(points: DataFrame, bins: list[tuple[int, float]] | None = None) -> DataFrame:
    """period_bin nearest in omega, the first on ties. Bins are a handful of literals."""
    bins = period_bins() if bins is None else bins
    best = F.array_min(F.array(*[F.struct(F.abs(F.col("omega") - F.lit(o)).alias("far"), F.lit(i).alias("bin")) for i, o in bins]))
    return points.withColumn("period_bin", best["bin"])


def binned_phase_speed(points: DataFrame) -> DataFrame:
    """Weighted mean cx and cy per cell and period bin, and their variance about the unweighted mean with
    the reliability-weights correction; infinite for a single layer. points: one per layer."""
    with_c = nearest_bin(phase_velocity(points))
    key = [*CELL, "period_bin"]
    means = with_c.groupBy(*key).agg(
        F.sum("w").alias("v1"), F.sum(F.col("w") * F.col("w")).alias("v2"), F.avg("cx").alias("mx"), F.avg("cy").alias("my"), F.count("*").alias("n")
    )
    spread = lambda c, m: F.sum(F.col("w") * (F.col(c) - F.col(m)) * (F.col(c) - F.col(m)))
    sums = with_c.join(means, key).groupBy(*key, "v1", "v2", "n").agg(
        F.sum(F.col("cx") * F.col("w")).alias("sx"), F.sum(F.col("cy") * F.col("w")).alias("sy"), spread("cx", "mx").alias("qx"), spread("cy", "my").alias("qy")
    )
    free = 1 - F.col("v2") / (F.col("v1") * F.col("v1"))
    var = lambda q: F.when((F.col("n") > 1) & (free > 0), F.col(q) / F.col("v1") / free).otherwise(F.lit(float("inf")))
    return sums.select(*key, (F.col("sx") / F.col("v1")).alias("cx"), (F.col("sy") / F.col("v1")).alias("cy"), var("qx").alias("var_cx"), var("qy").alias("var_cy"))


def store_points(filtered: DataFrame, kind: str = "diff") -> DataFrame:
    """What later windows get of a cloud that the first filter has left: one representative of each layer."""
    finite = F.col("kx").isNotNull() & F.col("ky").isNotNull() & ~F.isnan("kx") & ~F.isnan("ky")
    return layer_representative(filtered, kind).where(finite)


def layers_per_cell(points: DataFrame, windows: DataFrame, cells: int) -> DataFrame:
    """Mean number of stored layers per cell and window, over `cells` cells; windows without points count 0."""
    layers = points.select(*LAYER).distinct().groupBy("video_id", "window_id").agg(F.count("*").alias("n"))
    joined = windows.select("video_id", "window_id").distinct().join(layers, ["video_id", "window_id"], "left")
    return joined.select("video_id", "window_id", (F.coalesce("n", F.lit(0)) / F.lit(cells)).alias("layers_per_cell"))
