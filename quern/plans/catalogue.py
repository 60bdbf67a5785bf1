"""Every query of the engine's own operators by name, with its SQL twin."""

from __future__ import annotations

from . import q_aggregates, q_io, q_iterative, q_joins, q_more, q_pipelines, q_ranges, q_scalar, q_streaming, q_windows  # noqa: F401  they register
from ._registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
