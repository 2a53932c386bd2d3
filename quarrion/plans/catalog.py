"""All registered queries of the library, and the DuckDB SQL each is checked against."""

from __future__ import annotations

from quarrion.plans import graphs, ingestion, layouts, library, spatial, temporal, textual

_PARTS = (temporal, spatial, textual, graphs, library, ingestion, layouts)
QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE: dict = {k: f for part in _PARTS for k, f in part.ORACLE.items()}
