"""Registered queries over the tables, and their SQL."""

from . import cells, dynamic, graphs, rules, search

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (search, graphs, rules, cells, dynamic):
    for _name, (_query, _sql) in _module.REGISTRY.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLE_SQL[_name] = _sql
