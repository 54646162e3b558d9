"""All queries of the subpackage and their SQL."""

from . import cutoff, formatting, leaks, mixing, pairs, pii, spam

_MODULES = (formatting, pii, pairs, cutoff, leaks, mixing, spam)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
