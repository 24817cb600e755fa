"""All queries of the core by name, and their SQL."""

from tamarack.plans import rank_queries, release_queries, text_queries

QUERIES = text_queries.QUERIES | rank_queries.QUERIES | release_queries.QUERIES
ORACLES = text_queries.ORACLES | rank_queries.ORACLES | release_queries.ORACLES
