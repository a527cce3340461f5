"""Depth maps of endless feeds: the composed job inside a stream.

Windows are handed on by on_the_fly. Each goes through the batch job's steps, with what earlier windows have left in tables
of a shared folder: representatives of their clouds, their times, the Kalman states and, for a warm start, their frequencies. Results are written by batch and step;
a batch that is tried again first removes all it wrote and starts from what the steps before it left, so nothing counts twice.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wavefield.operators import track
from wavefield.plans import depth_map
from wavefield.streaming.streams import on_the_fly

TABLES = ("windows", "stored", "cell_fit", "speeds", "tracks", "states", "frequencies")


class Results:
    """Tables in a folder, in parts named by batch and step."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[int]:
        store, path = self._path(*parts)
        return sorted(int(x.getPath().getName()) for x in store.listStatus(path)) if store.exists(path) else []

    def parts(self, name: str) -> list[tuple[int, int]]:
        return [(batch, step) for batch in self._names(name) for step in self._names(name, str(batch))]

    def delete(self, name: str, *part: int) -> None:
        store, path = self._path(name, *map(str, part))
        store.delete(path, True)

    def write(self, df: DataFrame, name: str, part: tuple[int, int]) -> DataFrame:
        path = f"{self.folder}/{name}/{part[0]}/{part[1]}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, parts: list[tuple[int, int]] | None = None) -> DataFrame | None:
        """The rows of a table, or of some parts of it; None if there are none."""
        tables = [self.spark.read.parquet(f"{self.folder}/{name}/{a}/{b}") for a, b in (self.parts(name) if parts is None else parts)]
        return functools.reduce(DataFrame.unionByName, tables) if tables else None

    def drop_older(self, name: str, before: list[tuple[int, int]], part: tuple[int, int]) -> None:
        """Of a table whose every part is whole, one before this step is enough to start from; a batch that is tried again
        needs the one before it."""
        for x in before[:-1]:
            if x[0] < part[0] - 1:
                self.delete(name, *x)

    def earlier(self, name: str, part: tuple[int, int]) -> list[tuple[int, int]]:
        return [x for x in self.parts(name) if x < part]


def _tracked(results: Results, observed: DataFrame, part: tuple[int, int], q: float) -> None:
    """Takes the states of all keys a window further. A state is what a filter makes of it as a first observation."""
    before = results.earlier("states", part)
    if before:
        states = results.read("states", before[-1:]).where("xhat IS NOT NULL AND p IS NOT NULL")
        known = states.select(*track.KEY, F.col("t_last").alias("t"), F.lit(-1).cast("long").alias("seq"), F.col("xhat").alias("x"), F.col("p").alias("r"))
        observed = observed.withColumn("seq", F.col("seq").cast("long")).unionByName(known)
    results.write(track.kalman_history(observed, q).where("seq >= 0"), "tracks", part)
    results.write(track.kalman_track(observed, q), "states", part)
    results.drop_older("states", before, part)


def _frequencies(results: Results, found: DataFrame, part: tuple[int, int]) -> None:
    """Writes each video's last frequencies: this step's, or else what the steps before left."""
    before = results.earlier("frequencies", part)
    if before:
        found = found.unionByName(results.read("frequencies", before[-1:]).join(found.select("video_id"), "video_id", "left_anti"))
    results.write(found, "frequencies", part)
    results.drop_older("frequencies", before, part)


def _forget(results: Results, part: tuple[int, int], o: depth_map.Options) -> None:
    """Deletes stored points that no window to come can reach."""
    ends = results.read("windows").groupBy("video_id").agg(F.max("t").alias("newest"))
    for x in results.earlier("stored", part):
        times = results.read("windows", [x]).join(ends, "video_id")
        if x[0] < part[0] and times.where(F.floor("newest") - F.floor("t") <= o.stationary).isEmpty():
            results.delete("stored", *x)


def stream_depth_maps(frames: DataFrame, meta: DataFrame, dt: float, folder: str, o: depth_map.Options | None = None, skip: bool = False, interval: str | None = "16 seconds") -> StreamingQuery:
    """Starts a query that keeps cell_fit, speeds and tracks under folder up to date with a stream of
    frames(video_id, frame, row, col, value). Windows are o.hop frames apart as in depth_maps, and results equal its; to
    skip, the next window starts as many frames on as the last one took, and its id is its first frame."""
    o = o or depth_map.Options()
    timed = o if not skip else depth_map.Options(**{**o.__dict__, "hop": 1})
    at = {"batch": None, "step": 0}

    def process(window: DataFrame, batch_id: int) -> None:
        results = Results(window.sparkSession, folder)
        if at["batch"] != batch_id:
            for name in TABLES:
                results.delete(name, batch_id)
            at.update(batch=batch_id, step=0)
        part = (batch_id, at["step"])
        at["step"] += 1
        cut = window.withColumn("window_id", F.floor(F.col("start") / timed.hop)).drop("start")
        starts = results.read("frequencies", results.earlier("frequencies", part)[-1:]) if o.start == "warm" else None
        clouds = depth_map.window_clouds(cut, meta, dt, timed, starts)
        if o.start == "warm":
            _frequencies(results, clouds.frequencies, part)
        results.write(clouds.points.select("video_id", "window_id", "t").distinct(), "windows", part)
        results.write(clouds.stored, "stored", part)
        fits, speeds = depth_map.fit_windows(clouds, results.read("stored"), results.read("windows"), dt, timed)
        results.write(fits, "cell_fit", part)
        results.write(speeds, "speeds", part)
        _tracked(results, depth_map.observed(fits, speeds), part, o.q)
        _forget(results, part, o)

    return on_the_fly(frames, o.nt, process, f"{folder}/checkpoint", interval, dt, hop=None if skip else o.hop)
