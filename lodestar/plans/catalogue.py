"""The registry of queries over the star-schema and text tables, each beside its DuckDB SQL."""

from __future__ import annotations

from lodestar.plans import events_queries, orders_queries, record_queries, review_queries, text_queries

MODULES = (text_queries, events_queries, orders_queries, review_queries, record_queries)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
