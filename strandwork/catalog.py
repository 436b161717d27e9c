"""Registered queries of the graph operators, and their SQL."""

from strandwork.plans import graph_queries, log_queries, scalar_queries, table_queries  # noqa: F401
from strandwork.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
