"""What can go wrong, by kind."""


class EngineError(Exception):
    """The base of all."""


class QueryParseError(EngineError, ValueError):
    """A query string that has no reading (HTTP would say 400)."""


class LimitError(EngineError, ValueError):
    """A limit or offset out of range (422)."""


class MissingIndex(EngineError, FileNotFoundError):
    """No index at the path (503)."""


class IncompatibleSchema(EngineError, TypeError):
    """An index whose tables have other columns or types than this engine's."""


class CrawlError(EngineError):
    """A page that can't be fetched or parsed."""


class SpoolError(EngineError):
    """A sealed segment that can't be read whole."""
