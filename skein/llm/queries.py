"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from skein.llm import p1_split, p2_near_duplicates, p3_neighbours, p4_clusters, p5_own_text, p6_personal, p7_leaks, p8_mix, p9_quality

MODULES = (p1_split, p2_near_duplicates, p3_neighbours, p4_clusters, p5_own_text, p6_personal, p7_leaks, p8_mix, p9_quality)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLE_SQL.update(getattr(_m, "ORACLE_SQL", {}))
