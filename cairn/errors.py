"""What can go wrong, one exception for each status of a database or statement."""

from __future__ import annotations


class EngineError(Exception):
    """Any failure that the engine itself reports."""


class TableExists(EngineError):
    """A table of that name is registered."""


class NoSuchTable(EngineError):
    """No table of that name is registered."""


class NoSuchDatabase(EngineError):
    """The database folder isn't there and wasn't to be created."""


class InvalidData(EngineError):
    """Rows that don't fit: a wrong number of fields, a value that isn't of its column's type, or no rows."""


class SchemaMismatch(EngineError):
    """Rows of another schema than the table's."""


class StatementError(EngineError):
    """A statement that can't be parsed, resolved or run, or not exactly one statement."""
