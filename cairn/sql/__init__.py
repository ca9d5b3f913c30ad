"""The SQL front door."""

from .handler import QueryHandler, QueryResult

__all__ = ["QueryHandler", "QueryResult"]
