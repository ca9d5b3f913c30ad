"""All queries of the relational part."""

from . import expression_queries, operator_queries, sql_queries, tpch  # noqa: F401  each registers its queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
