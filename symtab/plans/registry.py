"""Registered queries, one for each operator of the survey, over the driver's tables, and their DuckDB oracles.

``symNN_name`` applies operator NN. Every query runs over its whole tables.
"""

from __future__ import annotations

from symtab.plans import event_queries, index_queries

QUERIES: dict = {**index_queries.QUERIES, **event_queries.QUERIES}
ORACLES: dict[str, str] = {**index_queries.ORACLES, **event_queries.ORACLES}
