"""Filters on clouds against plain numpy, the store, and which cells are fitted."""

from __future__ import annotations

import numpy as np
import pytest

from wavefield.operators import cloud, neighbours

POINTS = "video_id string, window_id long, t double, cell long, omega double, kx double, ky double, w double"


def _clouds(rng, n=60):
    rows = []
    for cell in range(n):
        direction = rng.normal(size=2)
        for i in range(int(rng.integers(1, 25))):
            omega = 0.4 + 0.2 * int(rng.integers(0, 7))
            k = omega**2 / 9.81 * rng.uniform(0.8, 3) * direction / np.linalg.norm(direction)
            if i % 4 == 0:
                k = -k
            rows.append(("v", 0, 0.0, cell, omega, *(k + rng.normal(size=2) * 0.02), float(rng.uniform(0.1, 1))))
    rows += [("v", 0, 0.0, 1_000, 0.6, 0.0, 0.0, 1.0), ("v", 0, 0.0, 1_001, 0.6, 0.1, 0.0, 1.0), ("v", 0, 0.0, 1_002, 0.6, 0.1, 0.0, 1.0), ("v", 0, 0.0, 1_002, 0.6, 0.1, 0.0, 1.0)]
    return [tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows]


def _kept(rows, layers=0, reflect=False):
    out = []
    for cell in {r[3] for r in rows}:
        mine = np.array([r[4:8] for r in rows if r[3] == cell])
        p = mine[:, [1, 2, 0]]
        axis = np.linalg.eigh(p.T @ p)[1][:, 2]
        off = (np.abs(p @ axis) < p[:, 2] * (1 - 1e-12)) & (len(set(mine[:, 0])) >= layers)
        if reflect:
            mine[off, 1:3] *= -1
            off[:] = False
        out += [(cell, *x) for x in mine[~off].tolist()]
    return sorted(out)


@pytest.mark.parametrize("layers,reflect", [(0, False), (4, False), (0, True)])
def test_directions_equal_an_eigensolver(spark, layers, reflect):
    rows = _clouds(np.random.default_rng(3))
    got = cloud.direction_filter(spark.createDataFrame(rows, POINTS), reflect, layers)
    assert got.columns == [x.split()[0] for x in POINTS.split(", ")]
    assert sorted((r["cell"], r["omega"], r["kx"], r["ky"], r["w"]) for r in got.collect()) == _kept(rows, layers, reflect)


def test_filters_deal_cells_once_and_stay_in_columns(spark, tmp_path):
    spark.createDataFrame(_clouds(np.random.default_rng(4)), POINTS).write.parquet(f"{tmp_path}/p")
    plan = cloud.filter_cloud(spark.read.parquet(f"{tmp_path}/p"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Arrow" not in plan and "Python" not in plan


def test_store_has_one_representative_of_each_layer_that_is_left(spark):
    """Seven points in six layers; the direction filter drops one, whose layer has another."""
    rows = [("v", 0, 0.0, 1, 0.4 + 0.2 * i, 0.05 + 0.05 * i, 0.01, 0.5) for i in range(6)] + [("v", 0, 0.0, 1, 0.6, -0.11, -0.3, 0.9)]
    first = cloud.filter_cloud(spark.createDataFrame(rows, POINTS))
    stored = cloud.store_points(first).collect()
    left = first.collect()
    assert len(left) == 6 and len({r["omega"] for r in left}) == 6
    assert sorted((r["omega"], r["kx"], r["ky"]) for r in stored) == [pytest.approx((r["omega"], r["kx"], r["ky"])) for r in sorted(left, key=lambda r: r["omega"])]


def test_cells_without_current_points_are_not_fitted_and_three_points_are_enough(spark):
    at = lambda cell, omega, k, n=1: [("v", 1, 16.0, cell, omega, k + 0.001 * i, 0.0, 1.0) for i in range(n)]
    current = at(1, 0.6, 0.1) + at(2, 0.6, 0.1)
    stored = at(1, 0.8, 0.15) + at(1, 1.0, 0.2) + at(3, 0.6, 0.1) + at(3, 0.8, 0.15) + at(3, 1.0, 0.2)
    none = spark.createDataFrame([], POINTS)
    combined = neighbours.combine_points(spark.createDataFrame(current, POINTS), spark.createDataFrame(stored, POINTS), none, only_current=True)
    assert {r["cell"] for r in combined.collect()} == {1, 2}
    assert {r["cell"] for r in cloud.layer_gate(combined).collect()} == {1}
    two_layers = spark.createDataFrame(at(5, 0.6, 0.1, 2) + at(5, 0.8, 0.15) + at(6, 0.6, 0.1, 2), POINTS)
    assert {r["cell"] for r in cloud.enough_points(two_layers).collect()} == {5}


def test_recent_windows_join_on_time_buckets(spark):
    rng = np.random.default_rng(2)
    rows = [(v, i, float(t)) for v in ("a", "b") for i, t in enumerate(np.sort(np.concatenate([rng.uniform(0, 900, 60), [100.0, 100.0, 5_000.0, 5_001.0]])))]
    got = neighbours.recent_windows(spark.createDataFrame(rows, "video_id string, window_id long, t double"), 60)
    expected = []
    for v in ("a", "b"):
        mine = sorted((t, i) for u, i, t in rows if u == v)
        for n, (t, i) in enumerate(mine[1:], 1):
            t1 = mine[n - 1][0]
            expected += [(v, i, j) for s, j in mine if s < t and np.floor(t1) - np.floor(s) <= 60]
    assert sorted((r["video_id"], r["window_id"], r["past_id"]) for r in got.collect()) == sorted(expected)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
