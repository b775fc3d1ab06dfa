"""Queries of the note-corpus operators and the SQL that tells the same rows."""

from __future__ import annotations

from .plans import activity, corpus, extraction, graph, report, search, streaming

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (extraction, corpus, report, graph, search, activity, streaming):
    QUERIES |= _part.Q.queries
    ORACLE_SQL |= _part.Q.oracles
