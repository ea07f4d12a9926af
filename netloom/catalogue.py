"""Every query of the engine and its DuckDB SQL."""

from __future__ import annotations

from netloom.plans import design_queries, graph_queries, path_queries, spatial_queries, vector_queries

_PARTS = (path_queries, spatial_queries, graph_queries, vector_queries, design_queries)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
