"""Named queries over the driver's tables, and the SQL that states each result."""

from __future__ import annotations

from . import matching_queries, score_queries, sequence_queries

_PARTS = (sequence_queries.R, matching_queries.R, score_queries.R)
QUERIES = {name: query for part in _PARTS for name, query in part.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.oracles.items()}
