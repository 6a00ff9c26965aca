"""The registered queries of the core and their SQL."""

from __future__ import annotations

from skein.plans import events, groups, ingest, mail, retrieval, state, taxonomy, texts

MODULES = (mail, taxonomy, groups, events, retrieval, state, texts, ingest)
QUERIES: dict = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
