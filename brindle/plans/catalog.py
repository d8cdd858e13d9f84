"""Every query over the record-processing operators, by name, with its DuckDB counterpart."""

from __future__ import annotations

from brindle.plans import cycle, extraction, keeping, records, relations, sites, stateful, streams, walks  # noqa: F401
from brindle.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "agg7_inventory_audit"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
