"""Reading and cutting frame stacks: frames(video_id, frame, row, col, value)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefield.sources.stacks import StackSource


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet", array: str = "ImgSequence", rows: int = 100_000, keep: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Long frames from Parquet in that layout, or from .npy and .npz files that hold a stack (row, col, frame); a file is one
    video named after it. keep: of which rows, cols and frames (row, col, frame: from, to before) values are read at all. Stacks of any
    size are read by many tasks, in batches of about `rows` values; a compressed member of a file is read by one."""
    keep = keep or {}
    if fmt == "parquet":
        inside = [(F.col(x) >= start) & (F.col(x) < stop) for x, (start, stop) in keep.items()]
        frames = spark.read.parquet(path).select("video_id", "frame", "row", "col", F.col("value").cast("double").alias("value"))
        return frames.where(functools.reduce(Column.__and__, inside, F.lit(True)))
    if fmt not in ("npz", "npy"):
        raise ValueError(f"unknown format {fmt!r}")
    spark.dataSource.register(StackSource)
    bounds = {f"{x}_{end}": v for x, pair in keep.items() for end, v in zip(("from", "to"), pair, strict=True)}
    return spark.read.format("wave_stack").options(array=array, batch_values=rows, **bounds).load(path)


def read_meta(spark: SparkSession, path: str, array: str = "ImgSequence", dx: str = "dx", dt: str = "dt", x: str = "X", y: str = "Y") -> DataFrame:
    """video_meta of .npy and .npz files: the stack's size and, from arrays of these names, the pixel size, the time between frames
    and the place of the first pixel (null where a file has no such array). Only headers and first values are read."""
    spark.dataSource.register(StackSource)
    return spark.read.format("wave_stack").options(geometry="true", array=array, dx=dx, dt=dt, x=x, y=y).load(path)


def crop_stride(frames: DataFrame, startx: int, stopx: int, starty: int, stopy: int, step: int = 1) -> DataFrame:
    """Pixels from start to before stop (x: columns, y: rows), every step-th, numbered anew; the pixel
    size grows step-fold."""
    inside = (F.col("row") >= starty) & (F.col("row") < stopy) & (F.col("col") >= startx) & (F.col("col") < stopx)
    on = ((F.col("row") - starty) % step == 0) & ((F.col("col") - startx) % step == 0)
    place = lambda c, start: F.floor((F.col(c) - start) / step).cast("int")
    return frames.where(inside & on).withColumn("row", place("row", starty)).withColumn("col", place("col", startx))


def inside_polygon(pixels: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """inside: whether (x, y) lies in the polygon, even-odd rule. Its edges are literals: a polygon is
    drawn by hand and has few corners, so there is nothing to join."""
    x, y, crossings = F.col("x"), F.col("y"), F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 != y2:
            spans = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
            crossings = crossings + (spans & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)).cast("int")
    return pixels.withColumn("inside", crossings % 2 == 1)


def mask_polygon(frames: DataFrame, polygon: list[tuple[float, float]], dx: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Values inside the polygon set to 0, which later makes those pixels bad."""
    placed = frames.withColumn("x", F.lit(x0) + F.col("col") * F.lit(dx)).withColumn("y", F.lit(y0) + F.col("row") * F.lit(dx))
    return inside_polygon(placed, polygon).withColumn("value", F.when(F.col("inside"), 0.0).otherwise(F.col("value"))).drop("x", "y", "inside")


def write_results(df: DataFrame, path: str) -> None:
    """Writes rows by video: what path held of these videos is replaced, other videos' results stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path)
