"""Registered queries of the wave-field operators and their SQL twins."""

from __future__ import annotations

from wavefield.plans import cloud_queries, grid_queries, known_queries, map_queries, series_queries, stream_queries, track_queries

_MODULES = (series_queries, track_queries, cloud_queries, grid_queries, stream_queries, known_queries, map_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
