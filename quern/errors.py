"""Errors of this package."""


class QueryError(ValueError):
    """A query that can't be meant: unknown operator, malformed filter, duplicate alias."""


class CursorBehindRetention(RuntimeError):
    """A change-stream cursor is older than the oldest change that is kept."""


class ManifestError(ValueError):
    """A manifest with a missing or wrong entry."""
