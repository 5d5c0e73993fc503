"""All core queries and the SQL they are compared with."""

from __future__ import annotations

from stratamem.plans import histories, retrieval, streams, writes

MODULES = (retrieval, writes, histories, streams)


def core_queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def core_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
