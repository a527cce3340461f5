"""Distributed decomposition of a window's tall pixel-by-frame matrix (series with re, im, or v).

Only triangular factors of frame-by-frame size leave the tasks; everything about a window that is not
per pixel follows from its factor, one small row per window.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefield.functions.arrays import matrix, own_columns
from wavefield.functions.modefit import first_alphas, fit_exponentials, marchenko_pastur_median, rank_threshold

WINDOW = ["video_id", "window_id"]
FACTOR = "video_id string, window_id long, n int, re array<double>, im array<double>"
#: Pixels of one window that a task holds together when modes are drawn.
PIXELS = 16_384
#: Windows of which a task keeps a factor or sum (64 KB for 64 frames) before it sends what it has on.
OPEN_WINDOWS = 256


def _complex(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    if "re" in batch.schema.names:
        return matrix(batch.column("re")) + 1j * matrix(batch.column("im"))
    return matrix(batch.column("v")).astype(complex)


def _by_window(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    keys = list(zip(batch.column("video_id").to_pylist(), batch.column("window_id").to_pylist(), strict=True))
    x = _complex(batch)
    codes = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    which = np.array([codes[k] for k in keys])
    for key, i in codes.items():
        yield key, x[which == i]


def _rows(factors: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    keys, values = list(factors), [np.ravel(r) for r in factors.values()]
    columns = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), pa.array([r.shape[1] for r in factors.values()], pa.int32())]
    return pa.record_batch([*columns, pa.array([v.real for v in values]), pa.array([v.imag for v in values])], ["video_id", "window_id", "n", "re", "im"])


def _signals(series: DataFrame) -> DataFrame:
    names = ["re", "im"] if "re" in series.columns else ["v"]
    return series.select(F.col("video_id").cast("string").alias("video_id"), F.col("window_id").cast("long").alias("window_id"), *names)


def _smaller(factor: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x if factor is None else np.vstack([factor, x]), mode="r")


def triangular(series: DataFrame, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """The R factor (n by n, rows one after the other) of each window's matrix: a QR step per batch of
    pixels in each task, then one over the tasks' factors, window by window. Factors of one window can be merged
    at any time, so a task that meets more than open_windows windows sends those it has and starts anew."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, x in _by_window(batch) if batch.num_rows else ():
                if key not in factors and len(factors) >= open_windows:
                    yield _rows(factors)
                    factors = {}
                factors[key] = _smaller(factors.get(key), x)
        if factors:
            yield _rows(factors)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, factor = None, None
        for video, window, r in _factors(batches):
            if (video, window) != last and last is not None:
                yield _rows({last: factor})
                factor = None
            last, factor = (video, window), _smaller(factor, r)
        if last is not None:
            yield _rows({last: factor})

    parts = _signals(series).mapInArrow(partial, FACTOR)
    return parts.repartition(*WINDOW).sortWithinPartitions(*WINDOW).mapInArrow(whole, FACTOR)


def gram(series: DataFrame, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(i, j, re, im) of sum over pixels of conj(x_i) x_j, from partial matrices by task and window; a task
    holds those of open_windows windows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, x in _by_window(batch) if batch.num_rows else ():
                if key not in sums and len(sums) >= open_windows:
                    yield from rows(sums)
                    sums = {}
                sums[key] = sums.get(key, 0) + x.conj().T @ x
        yield from rows(sums)

    def rows(sums: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (video, window), g in sums.items():
            n = len(g)
            i, j = np.divmod(np.arange(n * n), n)
            yield pa.record_batch(
                [pa.array([video] * n * n), pa.array(np.full(n * n, window)), pa.array(i), pa.array(j), pa.array(g.ravel().real), pa.array(g.ravel().imag)],
                ["video_id", "window_id", "i", "j", "re", "im"],
            )

    partial = _signals(series).mapInArrow(run, "video_id string, window_id long, i long, j long, re double, im double")
    return partial.groupBy(*WINDOW, "i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            r = np.array(row["re"]) + 1j * np.array(row["im"])
            yield row["video_id"], row["window_id"], r.reshape(-1, row["n"])


BASIS = "video_id string, window_id long, rank int, s array<double>, v_re array<double>, v_im array<double>"


def tall_svd(factors: DataFrame, rank: int) -> DataFrame:
    """Singular values s and right vectors v (n by rank) of each window; U follows as x v / s. The rank
    is cut where the singular values are round-off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for video, window, r in _factors(batches):
            _, s, vh = np.linalg.svd(r, full_matrices=False)
            k = min(rank, int((s > r.shape[1] * np.finfo(float).eps * s[0]).sum()))
            v = vh[:k].conj().T.ravel()
            yield pa.RecordBatch.from_pylist([{"video_id": video, "window_id": window, "rank": k, "s": s[:k].tolist(), "v_re": v.real.tolist(), "v_im": v.imag.tolist()}], _schema(BASIS))

    return factors.mapInArrow(run, BASIS)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def project(basis: DataFrame) -> DataFrame:
    """U^H X of each window, rank by n: S V^H, without another pass over the pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for video, window, s, v in _bases(batches):
            x = (s[:, None] * v.conj().T).ravel()
            yield pa.RecordBatch.from_pylist([{"video_id": video, "window_id": window, "n": v.shape[0], "re": x.real.tolist(), "im": x.imag.tolist()}], _schema(FACTOR))

    return basis.mapInArrow(run, FACTOR)


def _bases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            v = np.array(row["v_re"]) + 1j * np.array(row["v_im"])
            # a window without any signal has no rank
            yield row["video_id"], row["window_id"], np.array(row["s"]), v.reshape(-1, row["rank"]) if row["rank"] else np.zeros((0, 0), complex)


def optimal_rank(singular: DataFrame, beta: float, rows: int, sigma: float | None = None) -> DataFrame:
    """Per window the last index of singular(video_id, window_id, i, sv) above the optimal hard threshold."""
    if sigma is None:
        factor = rank_threshold(beta) / np.sqrt(marchenko_pastur_median(beta))
        cut = singular.groupBy(*WINDOW).agg((F.median("sv") * F.lit(float(factor))).alias("cutoff"))
    else:
        cut = singular.groupBy(*WINDOW).agg(F.lit(float(rank_threshold(beta) * np.sqrt(rows) * sigma)).alias("cutoff"))
    return singular.join(cut, WINDOW).groupBy(*WINDOW, "cutoff").agg(F.coalesce(F.max(F.when(F.col("sv") > F.col("cutoff"), F.col("i") + 1)), F.lit(0)).alias("rank"))


MODES = "video_id string, window_id long, mode int, alpha_re double, alpha_im double, b double, error double, status string, m_re array<double>, m_im array<double>"


def _mode_rows(video: str, window: int, alpha: np.ndarray, b: np.ndarray, error: float, s: np.ndarray, v: np.ndarray, stacked: bool) -> list[dict]:
    """Modes with weight b (norm of each row of the fit) and the vector m that draws them: phi = x m."""
    weight = np.linalg.norm(b, axis=1)
    weight[weight < 10 * np.finfo(float).eps * weight.max(initial=0)] = 0
    draw = (v / s) @ (b / np.where(weight > 0, weight, np.inf)[:, None]).T
    order = sorted(range(len(alpha)), key=lambda j: (abs(alpha[j].imag), -alpha[j].imag, alpha[j].real))
    return [
        {"video_id": video, "window_id": window, "mode": i, "alpha_re": alpha[j].real, "alpha_im": alpha[j].imag, "b": weight[j] / (np.sqrt(2) if stacked else 1),
         "error": error, "status": "ok", "m_re": draw[:, j].real.tolist(), "m_im": draw[:, j].imag.tolist()}
        for i, j in enumerate(order)
    ]


def _failed(video: str, window: int) -> list[dict]:
    return [{"video_id": video, "window_id": window, "mode": -1, "alpha_re": None, "alpha_im": None, "b": None, "error": None, "status": "failed", "m_re": None, "m_im": None}]


def initial_frequencies(basis: DataFrame, dt: float, method: str = "nonequidistant") -> DataFrame:
    """(alpha_re, alpha_im) from which fit_modes starts, per window."""
    schema = "video_id string, window_id long, alpha_re double, alpha_im double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for video, window, s, v in _bases(batches):
            alpha = first_alphas(s[:, None] * v.conj().T, dt, len(s), method) if len(s) else ()
            yield pa.RecordBatch.from_pylist([{"video_id": video, "window_id": window, "alpha_re": a.real, "alpha_im": a.imag} for a in alpha], _schema(schema))

    return basis.mapInArrow(run, schema)


def last_frequencies(modes: DataFrame) -> DataFrame:
    """starts(video_id, first_re, first_im): the frequencies of each video's newest window that could be fitted."""
    mine = modes.where(F.col("status") == "ok").groupBy(*WINDOW).agg(F.array_sort(F.collect_list(F.struct("mode", "alpha_re", "alpha_im"))).alias("m"))
    newest = mine.groupBy("video_id").agg(F.max_by("m", "window_id").alias("m"))
    return newest.select("video_id", F.col("m.alpha_re").alias("first_re"), F.col("m.alpha_im").alias("first_im"))


def fit_modes(basis: DataFrame, dt: float, mode: str = "standard", init: str = "cold", stacked: bool = True, method: str = "nonequidistant", starts: DataFrame | None = None) -> DataFrame:
    """Modes of each window by variable projection on its projected series. cold: windows are fitted
    apart. warm: a video's windows are walked in order, each starting from the last one's frequencies, and the first from those
    of starts (last_frequencies of earlier windows), if it has any;
    robust: from both starts, the smaller residual wins. A window that cannot be fitted gives one row of
    status failed."""

    started = starts is not None and init == "warm"

    def one(video: str, window: int, s: np.ndarray, v: np.ndarray, previous: np.ndarray | None) -> tuple[list[dict], np.ndarray | None]:
        if not len(s):
            return _failed(video, window), previous
        try:
            x, times = s[:, None] * v.conj().T, np.arange(v.shape[0]) * dt
            starts = [] if previous is None else [previous]
            if previous is None or mode == "robust":
                starts.append(first_alphas(x, dt, len(s), method))
            fits = [fit_exponentials(x, times, a) for a in starts if len(a)]
            alpha, b, error = min(fits, key=lambda f: f[2])
            if not np.isfinite(error):
                return _failed(video, window), previous
            return _mode_rows(video, window, alpha, b, error, s, v, stacked), alpha
        except (np.linalg.LinAlgError, ValueError):
            return _failed(video, window), previous

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray | None] = (None, None)
        for batch in batches:
            firsts = zip(batch.column("first_re").to_pylist(), batch.column("first_im").to_pylist(), strict=True) if started else itertools.repeat((None, None))
            for (video, window, s, v), (re, im) in zip(_bases(iter([batch])), firsts):
                if video != last[0]:
                    last = (video, None if re is None else np.array(re) + 1j * np.array(im))
                rows, alpha = one(video, window, s, v, last[1] if init == "warm" else None)
                last = (video, alpha)
                yield pa.RecordBatch.from_pylist(rows, _schema(MODES))

    source = basis
    if init == "warm":
        source = basis if starts is None else basis.join(starts.select("video_id", "first_re", "first_im"), "video_id", "left")
        source = source.repartition("video_id").sortWithinPartitions(*WINDOW)
    return source.mapInArrow(run, MODES)


def exact_modes(factors: DataFrame, rank: int, dt: float) -> DataFrame:
    """Modes of the one-step operator from each frame to the next, weighed by frame 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for video, window, r in _factors(batches):
            u, s, vh = np.linalg.svd(r[:, :-1], full_matrices=False)
            k = min(rank, int((s > r.shape[1] * np.finfo(float).eps * s[0]).sum()))
            u, s, v = u[:, :k], s[:k], vh[:k].conj().T
            values, w = np.linalg.eig(u.conj().T @ r[:, 1:] @ v / s)
            modes = r[:, 1:] @ (v / s) @ w
            b = np.linalg.lstsq(modes, r[:, 0], rcond=None)[0]
            alpha = np.log(values.astype(complex)) / dt
            order = sorted(range(k), key=lambda j: (abs(alpha[j].imag), -alpha[j].imag, alpha[j].real))
            draw = np.vstack([np.zeros(k), (v / s) @ w])  # on frames 1 to n-1
            yield pa.RecordBatch.from_pylist(
                [{"video_id": video, "window_id": window, "mode": i, "alpha_re": alpha[j].real, "alpha_im": alpha[j].imag, "b": abs(b[j]) * np.linalg.norm(modes[:, j]), "error": 0.0,
                  "status": "ok", "m_re": draw[:, j].real.tolist(), "m_im": draw[:, j].imag.tolist()} for i, j in enumerate(order)], _schema(MODES))

    return factors.mapInArrow(run, MODES)


PIXEL_MODES = "video_id string, window_id long, mode int, row int, col int, re double, im double"


def draw_modes(series: DataFrame, modes: DataFrame) -> DataFrame:
    """mode_pixels: the value x m of each mode at each pixel; series of stacked pixels bring their half 0
    only. Pixels of a window go in chunks, each with the window's few mode vectors."""
    x = series.where(F.col("half") == 0) if "half" in series.columns else series
    names = ["re", "im"] if "re" in x.columns else ["v"]
    x = x.select(F.col("video_id").cast("string").alias("video_id"), F.col("window_id").cast("long").alias("window_id"), F.floor(F.col("pixel") / PIXELS).alias("chunk"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *names)
    chunks = x.select(*WINDOW, "chunk").distinct()
    vectors = modes.where(F.col("status") == "ok").select(*WINDOW, "mode", F.col("m_re"), F.col("m_im")).join(chunks, WINDOW)
    key = [*WINDOW, "chunk"]

    def run(pixels: pa.Table, drawn: pa.Table) -> pa.Table:
        if not pixels.num_rows or not drawn.num_rows:
            return _schema(PIXEL_MODES).empty_table()
        m = (matrix(drawn["m_re"]) + 1j * matrix(drawn["m_im"])).T
        phi = _complex(pixels)[:, : len(m)] @ m
        k, n = drawn.num_rows, pixels.num_rows
        repeat = lambda c: pa.array(np.repeat(pixels[c].to_numpy(), k), pa.int32())
        return pa.table(
            [pa.array([pixels["video_id"][0].as_py()] * (n * k)), pa.array(np.full(n * k, pixels["window_id"][0].as_py())), pa.array(np.tile(drawn["mode"].to_numpy(), n), pa.int32()),
             repeat("row"), repeat("col"), pa.array(phi.ravel().real), pa.array(phi.ravel().imag)], [y.split()[0] for y in PIXEL_MODES.split(", ")])

    return x.groupBy(*key).cogroup(own_columns(vectors).groupBy(*key)).applyInArrow(run, PIXEL_MODES)


def singular_values(basis: DataFrame) -> DataFrame:
    return basis.select(*WINDOW, F.posexplode("s").alias("i", "sv"))


