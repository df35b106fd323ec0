"""Every query of the library proper, and the SQL that gives the same rows."""

from __future__ import annotations

from lumenpair.plans import etl, fields, layout, products, relations, rules, signals

MODULES = (fields, relations, rules, etl, products, layout, signals)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
ENTRY = fields.c2_dates
