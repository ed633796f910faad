"""Registered queries: name -> (function of session and folder, DuckDB SQL or None)."""

from __future__ import annotations

from . import event_queries, evidence_queries, factor_queries, source_queries

QUERIES: dict = event_queries.QUERIES | factor_queries.QUERIES | evidence_queries.QUERIES | source_queries.QUERIES
