"""The wave-field tables as views of the driver's tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DT = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as pixel series of 64 frames, a window per label, on an image of 25 rows; some pixels are
    made bad."""
    id_ = F.col("vec_id")
    v = F.transform("embedding", lambda x, i: F.when(id_ % 17 == 0, 0.0).when((id_ % 23 == 0) & (i == 5), None).otherwise(x.cast("double")))
    place = [(id_ % 25).cast("int").alias("row"), F.floor(id_ / 25).cast("int").alias("col")]
    return table(spark, sf_dir, "embeddings").select(F.lit("emb").alias("video_id"), F.col("label").cast("long").alias("window_id"), id_.alias("pixel"), *place, v.alias("v"))


def good_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavefield.operators.preprocess import exclude_bad, flag_bad_pixels

    return exclude_bad(flag_bad_pixels(pixel_series(spark, sf_dir)))


#: Long rows px(video_id, window_id, pixel, frame, x) with bad, and good ones only.
SERIES_SQL = """
WITH px AS (SELECT 'emb' AS video_id, label::BIGINT AS window_id, vec_id AS pixel, i - 1 AS frame,
                   CASE WHEN vec_id % 17 = 0 THEN 0.0 WHEN vec_id % 23 = 0 AND i = 6 THEN NULL ELSE embedding[i]::DOUBLE END AS x
            FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)),
bad AS (SELECT pixel, (bool_and(x IS NULL OR x = 0) OR bool_or(x IS NULL)) AS bad FROM px GROUP BY pixel),
good AS (SELECT px.* FROM px JOIN bad USING (pixel) WHERE NOT bad)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations of cells through time; some values missing, some errors infinite or zero."""
    e, id_ = table(spark, sf_dir, "events"), F.col("event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    x = F.when(id_ % 11 != 0, F.col("value"))
    r = F.when(id_ % 29 == 0, float("inf")).when(id_ % 31 == 0, 0.0).otherwise((1 + id_ % 7).cast("double"))
    return e.select(F.lit("ev").alias("video_id"), F.col("user_id").alias("cell"), F.col("event_type").alias("variable"), F.lit(-1).alias("period_bin"), t.alias("t"), id_.alias("seq"), x.alias("x"), r.alias("r"))


OBS_SQL = """
obs AS (SELECT 'ev' AS video_id, user_id AS cell, event_type AS variable, -1 AS period_bin, epoch_us(ts) / 1e6 AS t, event_id AS seq,
               CASE WHEN event_id % 11 <> 0 THEN value END AS x,
               CASE WHEN event_id % 29 = 0 THEN 500.0 WHEN event_id % 31 = 0 THEN 1e-7 ELSE (1 + event_id % 7)::DOUBLE END AS r FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as spectral points: a window per month, a cell per supplier, seven layers."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 12 * 1992
    return table(spark, sf_dir, "lineitem").select(
        F.lit("li").alias("video_id"), month.cast("long").alias("window_id"), (month * 16.0).alias("t"), F.col("l_suppkey").alias("cell"),
        (0.4 + 0.2 * F.col("l_linenumber")).alias("omega"), (F.col("l_quantity") / 100).alias("kx"), ((F.col("l_discount") - 0.05) * 2).alias("ky"), (F.col("l_tax") + 0.01).alias("w"),
    )


POINTS_SQL = """
pts AS (SELECT 'li' AS video_id, (year(l_shipdate) * 12 + month(l_shipdate) - 12 * 1992)::BIGINT AS window_id,
               (year(l_shipdate) * 12 + month(l_shipdate) - 12 * 1992) * 16.0::DOUBLE AS t, l_suppkey AS cell,
               0.4::DOUBLE + 0.2::DOUBLE * l_linenumber AS omega, l_quantity / 100 AS kx, (l_discount - 0.05::DOUBLE) * 2 AS ky, l_tax + 0.01::DOUBLE AS w FROM lineitem)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as a grid of ten rows; overdrawn suppliers are masked."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("cell"), (key % 10).cast("int").alias("cell_row"), F.floor(key / 10).cast("int").alias("cell_col"), (F.col("s_acctbal") >= 0).alias("usable"))


CELLS_SQL = "cells AS (SELECT s_suppkey AS cell, (s_suppkey % 10)::INTEGER AS cell_row, (s_suppkey // 10)::INTEGER AS cell_col, s_acctbal >= 0 AS usable FROM supplier)"


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as modes: frequency by size, weight by price, some without weight."""
    key, omega = F.col("p_partkey"), F.lit(2 * 3.141592653589793) * F.col("p_size") / 100
    sign = F.when(key % 2 == 0, 1.0).otherwise(-1.0)
    b = F.when(key % 19 != 0, F.col("p_retailprice")).otherwise(0.0)
    return table(spark, sf_dir, "part").select(F.lit("pa").alias("video_id"), (key % 50).cast("long").alias("window_id"), key.alias("mode"), F.lit(0.0).alias("alpha_re"), (sign * omega).alias("alpha_im"), b.alias("b"))


MODES_SQL = """
modes AS (SELECT 'pa' AS video_id, (p_partkey % 50)::BIGINT AS window_id, p_partkey AS mode, 0.0::DOUBLE AS alpha_re,
                 (CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * (2 * 3.141592653589793::DOUBLE * p_size / 100) AS alpha_im,
                 CASE WHEN p_partkey % 19 <> 0 THEN p_retailprice ELSE 0.0 END AS b FROM part)"""


def soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a survey on a grid of 40 columns, 10 m apart."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.lit("pa").alias("video_id"), (key % 40 * 10.0).alias("x"), (F.floor(key / 40) * 10.0).alias("y"), (-F.col("p_retailprice") / 100).alias("z"))


SOUNDINGS_SQL = "snd AS (SELECT 'pa' AS video_id, p_partkey % 40 * 10.0::DOUBLE AS x, (p_partkey // 40) * 10.0::DOUBLE AS y, -p_retailprice / 100 AS z FROM part)"


def rounded(df: DataFrame, keys: list[str], **digits: int) -> DataFrame:
    """Keys and rounded figures, without negative zeros."""
    return df.select(*keys, *[(F.round(c, n) + 0.0).alias(c) for c, n in digits.items()])
