"""Streams over tables that are folders of files, as larger tables are."""

from __future__ import annotations

import duckdb
import pytest
from test_queries import SF, _rows

from wavefield.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["r1_stream_series", "r1_stream_windows"])
def test_tables_in_folders_are_streamed_whole(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    wanted = _rows(columns, found.fetchall())
    assert len(wanted) > 20 and _rows(df.columns, [tuple(r) for r in df.collect()]) == wanted
