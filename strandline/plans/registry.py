"""All registered queries of the core, with the SQL that must give the same rows."""

from __future__ import annotations

from strandline.plans import checks, graph, measure, orphans, parse, records, score, search

MODULES = [orphans, parse, search, measure, score, graph, checks, records]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
