"""All queries of the engine's own operators, by their inventory names."""

from docketry.plans import legal_queries, more_queries, rank_queries, service_queries, text_queries  # noqa: F401
from docketry.plans.fixtures import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
