"""Errors that callers may show to whoever sent the statement."""

from __future__ import annotations


class QueryError(Exception):
    """A statement, table or setting that cannot be used as it is."""


class SyntaxFault(QueryError):
    """A statement that cannot be read; line and column count from 1, in bytes."""

    def __init__(self, line: int, column: int, message: str) -> None:
        super().__init__(f"{line}:{column}: {message}")
        self.line, self.column, self.message = line, column, message
