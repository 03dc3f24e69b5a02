"""All queries: over the driver's tables, over an index made of them, over many questions at once, and over sources written from them."""

from __future__ import annotations

from gneiss import registry_index, registry_scale, registry_sources  # noqa: F401  (they add their queries)
from gneiss.registry_tables import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
