"""Registered queries of the merge engine and their SQL counterparts."""

from tributary.plans import ingest, oracle, queries, records

QUERIES = {**queries.QUERIES, **records.QUERIES, **ingest.QUERIES}
ORACLE_SQL = {**oracle.ORACLE_SQL, **records.ORACLE_SQL, **ingest.ORACLE_SQL}

FLAGSHIP = "q27_interactions"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
