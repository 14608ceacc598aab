"""All queries of the engine and their SQL, from the modules that register them."""

from __future__ import annotations

from cartulary.plans import deep, extended, registry  # noqa: F401  importing a module registers its queries

queries, oracle_sql = registry.queries, registry.oracle_sql
