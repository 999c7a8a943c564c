"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import advice_queries, circuit_queries, evidence_queries, feature_queries, ingest_queries, layer_queries, netlist_queries, network_queries, relational_queries, store_queries, stream_queries, text_queries, training_queries

_PLANS = (netlist_queries, feature_queries, text_queries, advice_queries, relational_queries, ingest_queries, store_queries, training_queries, layer_queries, network_queries, circuit_queries, stream_queries, evidence_queries)

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _plan in _PLANS:
    QUERIES |= _plan.QUERIES
    ORACLE_SQL |= _plan.ORACLE_SQL
