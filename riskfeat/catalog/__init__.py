"""Named queries over the driver tables, with their SQL counterparts."""

from riskfeat.catalog import flagship_queries, learner_queries, relational_queries, scalar_queries  # noqa: F401
from riskfeat.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
