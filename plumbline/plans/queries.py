"""All queries of the validation engine and their oracle SQL: each module adds its own to the registry."""

from __future__ import annotations

from . import files, registry, statistics

MODULES = (registry, files, statistics)
QUERIES, ORACLE_SQL, FLAGSHIP = registry.QUERIES, registry.ORACLE_SQL, registry.FLAGSHIP
