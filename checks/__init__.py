"""Registered queries, each next to the SQL that states the same result."""

from checks import catalog, features, planning, profiling, sources

QUERY_MODULES = [profiling, features, planning, catalog, sources]
