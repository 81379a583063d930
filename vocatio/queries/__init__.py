"""Registered queries of the library: name to (query, DuckDB SQL or none)."""

from vocatio.queries import landing, matching, planned, profiles, reshape, tables, text

REGISTERED = text.QUERIES | tables.QUERIES | matching.QUERIES | profiles.QUERIES | planned.QUERIES | reshape.QUERIES | landing.QUERIES
