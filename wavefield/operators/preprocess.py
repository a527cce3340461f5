"""Per-window pixel preparation. A `series` has a row per (video_id, window_id, pixel) with v, the
array of samples (null where there is none); `re` and `im` hold complex signals.

Window-wide figures are partial aggregates joined back on (video_id, window_id) and a part of the pixels: no
window is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavefield.functions.arrays import lists, matrix
from wavefield.functions.shared import if_small, kept
from wavefield.functions.signal import amplitudes, analytic

WINDOW = ["video_id", "window_id"]
#: A window's pixels are dealt to so many keys where they meet figures of the whole window.
PARTS = 32
#: Windows of which a task keeps a spectrum before it sends what it has on.
OPEN_WINDOWS = 10_000


def to_series(frames: DataFrame, rows: Column | int | None = None) -> DataFrame:
    """Long frames (video_id, window_id, frame, row, col, value) as series; pixel ids run down the columns
    of an image of `rows` rows (a number, or a column of frames). NaN becomes null."""
    pixel = F.col("pixel") if "pixel" in frames.columns else (F.col("col") * rows + F.col("row")).cast("long")
    value = F.when(~F.isnan("value"), F.col("value").cast("double"))
    ordered = F.array_sort(F.collect_list(F.struct("frame", value.alias("value"))))
    grouped = frames.withColumn("pixel", pixel).groupBy(*WINDOW, "pixel").agg(ordered.alias("s"), F.first("row").alias("row"), F.first("col").alias("col"))
    return grouped.select(*WINDOW, "pixel", "row", "col", F.transform("s", lambda x: x["value"]).alias("v"))


def flag_bad_pixels(series: DataFrame) -> DataFrame:
    """bad: all samples are 0 or missing, or any is missing."""
    empty = F.forall("v", lambda x: x.isNull() | (x == 0))
    return series.withColumn("bad", empty | F.exists("v", lambda x: x.isNull()))


def _long(series: DataFrame) -> DataFrame:
    return series.select(*WINDOW, F.posexplode("v").alias("frame", "x"))


def with_figures(series: DataFrame, figures: DataFrame, how: str = "left") -> DataFrame:
    """series with the columns of figures, one row per window."""
    spread = figures.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = series.withColumn("part_", F.pmod(F.coalesce("pixel", F.lit(0)), F.lit(PARTS)).cast("int"))
    return dealt.join(spread, [*WINDOW, "part_"], how).drop("part_")


def demean_frames(series: DataFrame) -> DataFrame:
    """v less the mean of each frame over the good pixels (column bad)."""
    means = _long(series.where(~F.col("bad"))).groupBy(*WINDOW, "frame").agg(F.avg("x").alias("mean"))
    by_window = means.groupBy(*WINDOW).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "mean"))), lambda x: x["mean"]).alias("means"))
    joined = with_figures(series, by_window)
    return joined.withColumn("v", F.coalesce(F.zip_with("v", "means", lambda x, m: x - m), F.col("v"))).drop("means")


def minmax_normalise(series: DataFrame) -> DataFrame:
    """v scaled so that the good pixels (all, without a column bad) of the whole window span 0..1; normfac
    keeps their range."""
    good = series.where(~F.col("bad")) if "bad" in series.columns else series
    extremes = good.groupBy(*WINDOW).agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"))
    joined = with_figures(series, extremes)
    scaled = F.when(F.col("high") > F.col("low"), F.transform("v", lambda x: (x - F.col("low")) / (F.col("high") - F.col("low")))).otherwise(F.transform("v", lambda x: x * 0.0))
    return joined.withColumn("v", scaled).withColumn("normfac", F.col("high") - F.col("low")).drop("low", "high")


def exclude_bad(series: DataFrame, exclude: bool = True) -> DataFrame:
    """Without bad pixels; or with all of them, missing samples as 0."""
    if exclude:
        return series.where(~F.col("bad"))
    return series.withColumn("v", F.transform("v", lambda x: F.coalesce(x, F.lit(0.0))))


def pixel_count(series: DataFrame) -> DataFrame:
    return series.groupBy(*WINDOW).agg(F.count("*").alias("n_pixels"))


def _with_lists(batch: pa.RecordBatch, drop: list[str], new: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in drop]
    return pa.record_batch([*[batch.column(n) for n in names], *[lists(x) for x in new.values()]], [*names, *new])


def analytic_signal(series: DataFrame) -> DataFrame:
    """re and im of the analytic signal in place of v."""
    kept = [f"{n} {t}" for n, t in series.dtypes if n != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = analytic(matrix(batch.column("v")))
                yield _with_lists(batch, ["v"], {"re": z.real, "im": z.imag})

    return series.mapInArrow(run, ", ".join([*kept, "re array<double>", "im array<double>"]))


def amplitude_spectrum(series: DataFrame, dt: float, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Mean amplitude over the pixels of a window per frequency bin: bin, omega (rad/s), f (Hz),
    amplitude. Tasks send partial sums per window and bin, and hold those of open_windows windows at most."""
    is_complex = "re" in series.columns
    columns = ["re", "im"] if is_complex else ["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("re")) + 1j * matrix(batch.column("im")) if is_complex else matrix(batch.column("v"))
            n, a = x.shape[1], amplitudes(x)
            keys = list(zip(batch.column("video_id").to_pylist(), batch.column("window_id").to_pylist(), strict=True))
            codes = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            which = np.array([codes[k] for k in keys])
            for key, i in codes.items():
                own = a[which == i]
                if key not in sums and len(sums) >= open_windows:
                    yield rows(sums)
                    sums = {}
                part = sums.setdefault(key, [n, 0.0, 0])
                part[1], part[2] = part[1] + own.sum(axis=0), part[2] + len(own)
        if sums:
            yield rows(sums)

    def rows(sums: dict[tuple, list]) -> pa.RecordBatch:
        each = [(*k, j, n, float(y), count) for k, (n, total, count) in sums.items() for j, y in enumerate(total)]
        return pa.record_batch([pa.array(c) for c in zip(*each, strict=True)], ["video_id", "window_id", "bin", "n", "total", "pixels"])

    kinds = dict(series.dtypes)
    schema = f"video_id {kinds['video_id']}, window_id long, bin long, n long, total double, pixels long"
    partial = series.select(F.col("video_id"), F.col("window_id").cast("long"), *columns).mapInArrow(run, schema)
    f = F.col("bin") / F.max("n") / F.lit(float(dt))
    return partial.groupBy(*WINDOW, "bin").agg((F.sum("total") / F.sum("pixels")).alias("amplitude"), f.alias("f")).withColumn("omega", F.lit(2 * np.pi) * F.col("f"))


def coast_detect(series: DataFrame, dt: float, band: tuple[float, float] = (1 / 20, 1 / 3), threshold: float = 0.3) -> DataFrame:
    """coast: the pixel's amplitude outside the wave band, relative to that inside and scaled to 0..1
    over the window, exceeds the threshold. ratio is the scaled figure."""
    kept = ", ".join(f"{n} {t}" for n, t in series.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                a = amplitudes(x)
                f = np.arange(a.shape[1]) / (x.shape[1] * dt)
                inside = (f > band[0]) & (f < band[1])
                with np.errstate(all="ignore"):
                    ratio = a[:, ~inside].sum(axis=1) / a[:, inside].sum(axis=1)
                yield pa.record_batch([*batch.columns, pa.array(np.nan_to_num(ratio, nan=0, posinf=0, neginf=0))], [*batch.schema.names, "raw"])

    with_ratio = series.mapInArrow(run, f"{kept}, raw double")
    extremes = with_ratio.groupBy(*WINDOW).agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("raw") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return with_figures(with_ratio, extremes).withColumn("ratio", scaled).withColumn("coast", F.col("ratio") > threshold).drop("raw", "low", "high")


def stack_delay(series: DataFrame) -> DataFrame:
    """Each pixel twice: half 0 has the samples but the last, half 1 those but the first."""
    names = [c for c in ("v", "re", "im") if c in series.columns]
    cut = lambda start: {c: F.slice(c, start, F.size(c) - 1) for c in names}
    return series.withColumns(cut(1)).withColumn("half", F.lit(0)).unionByName(series.withColumns(cut(2)).withColumn("half", F.lit(1)))


def band_filter(spectrum: DataFrame, limits: tuple[float, float] = (1 / 3, 1 / 15)) -> DataFrame:
    """Bins with f strictly between limits[1] and limits[0]."""
    return spectrum.where((F.col("f") > limits[1]) & (F.col("f") < limits[0]))


def frame_rank(frames: DataFrame) -> DataFrame:
    """Frame numbers for feeds that only have an order (column at) within a video. Tasks take ranges of (video_id, at) and
    number a video's frames within theirs; what lies in the ranges before is added."""
    dealt = kept(frames.repartitionByRange("video_id", "at").withColumn("range_", F.spark_partition_id()))
    sizes = dealt.groupBy(F.col("video_id").alias("video_"), F.col("range_").alias("part_")).agg(F.count("*").alias("n_"))
    earlier = F.sum("n_").over(Window.partitionBy("video_").orderBy("part_")) - F.col("n_")
    numbered = dealt.withColumn("frame", F.row_number().over(Window.partitionBy("video_id", "range_").orderBy("at")))
    same = (F.col("range_") == F.col("part_")) & F.col("video_id").eqNullSafe(F.col("video_"))
    moved = numbered.join(if_small(sizes.withColumn("before_", earlier)), same)
    return moved.withColumn("frame", (F.col("frame") - 1 + F.col("before_")).cast("int")).drop("range_", "video_", "part_", "n_", "before_")
