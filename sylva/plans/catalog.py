"""All registered graph queries and their DuckDB equivalents."""

from __future__ import annotations

from . import downstream_queries, runner_queries, score_queries, search_queries, tree_queries  # noqa: F401
from .register import ORACLES, QUERIES  # noqa: F401
