"""Names of the engine's queries, and the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import mining_queries, model_queries, review_queries

QUERIES: dict = review_queries.QUERIES | mining_queries.QUERIES | model_queries.QUERIES
ORACLES: dict[str, str] = review_queries.ORACLES | mining_queries.ORACLES | model_queries.ORACLES
