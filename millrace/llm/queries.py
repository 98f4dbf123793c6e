"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from millrace.llm import addresses, encodings, leakage, mixing, names, personal, truncation

MODULES = (truncation, encodings, addresses, names, leakage, mixing, personal)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: q for m in MODULES for name, q in getattr(m, "ORACLES", {}).items()}
