"""All core queries and their SQL."""

from . import aggregates, governance, graphs, joins, lifecycle, references, sources, streams, texts, windows

_MODULES = (references, graphs, joins, aggregates, windows, texts, streams, sources, lifecycle, governance)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
