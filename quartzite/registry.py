"""Name to query builder and to DuckDB SQL of the same result."""

from __future__ import annotations

from quartzite.operators import context, entropy, extras, quant, relational, storage, text, transforms

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (context, entropy, extras, quant, relational, storage, text, transforms):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
