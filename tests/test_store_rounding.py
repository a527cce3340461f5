"""Stored points whose mean lies halfway between two rounded figures, against the SQL."""

from __future__ import annotations

import datetime
import itertools

import duckdb

from wavefield.plans.cloud_queries import ORACLES, QUERIES


def test_halfway_means_round_as_in_sql(spark, tmp_path):
    """Cells of a layer of two points, for each two pairs of discount and tax, and a layer of one; two terms add up
    the same in any order."""
    pairs = list(itertools.product(range(11), range(9)))
    day = datetime.datetime(1995, 3, 1)
    rows = [
        (cell, line, 20.0, d / 100, t / 100, day)
        for cell, (both, other) in enumerate(itertools.product(itertools.combinations(pairs, 2), (0, 6, 10)))
        for line, d, t in [*((3, *x) for x in both), (4, other, 0)]
    ]
    schema = "l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
    path = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(rows, schema).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    expected = {tuple(r[:2]): tuple(r[2:]) for r in con.execute(ORACLES["c16_store_points"]).fetchall()}
    got = {(r["window_id"], r["cell"]): (r["n"], r["ky"]) for r in QUERIES["c16_store_points"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) // 3
    assert got == expected
