"""Exceptions of the engine."""


class UnsupportedSPARQL(Exception):
    """A SPARQL feature outside the engine's language."""


class SparqlSyntaxError(Exception):
    """Text that is neither a query nor an update."""


class DeleteInsertConflict(Exception):
    """A quad that an update needs isn't there, or another writer committed first."""


class UnknownGraph(Exception):
    """A graph that the dataset doesn't have."""


class BadToken(Exception):
    """A continuation token that isn't one, or belongs to another query."""
