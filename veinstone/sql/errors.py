"""Errors, with the place in the query where there is one."""

from __future__ import annotations


class SqlError(Exception):
    """Base of all errors of the engine; start and end are offsets into the query."""

    def __init__(self, message: str, start: int | None = None, end: int | None = None):
        super().__init__(message if start is None else f"{message} at position {start}")
        self.message, self.start, self.end = message, start, end


class ParseError(SqlError):
    """The query can't be read."""


class InvalidLiteralError(ParseError):
    """A number, string or identifier is malformed or never ends."""


class UnexpectedCharError(ParseError):
    """A character starts no token."""


class UnknownFunctionError(ParseError):
    """No function has this name."""


class UnsupportedError(ParseError):
    """Known SQL that this dialect leaves out."""


class PlanError(SqlError):
    """The query reads well but can't be planned."""


class TableNotFoundError(PlanError):
    """No table has this name."""


class ColumnNotFoundError(PlanError):
    """No column in scope has this name."""


class ArgumentError(PlanError):
    """A function can't take this argument."""
