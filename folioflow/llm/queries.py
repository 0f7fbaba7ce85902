"""The named queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from folioflow.llm import containers, languages, leakage, percentiles, personal, pieces, scans, sentences, vectors

_MODULES = (personal, percentiles, vectors, scans, pieces, languages, containers, leakage, sentences)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
