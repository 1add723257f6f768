"""Exceptions, one for each part of the engine."""


class EngineError(Exception):
    """Base of all errors raised here."""


class ConfigError(EngineError):
    """A configuration that cannot be read or holds wrong values."""


class ManifestError(EngineError):
    """A manifest that cannot be read or lacks required fields."""


class ParseError(EngineError):
    """A file that cannot be parsed, is too large or unsafe."""


class ChunkError(EngineError):
    """A document that cannot be cut into chunks."""


class EmbeddingError(EngineError):
    """Vectors that cannot be made, or not as many as texts."""


class StoreError(EngineError):
    """A store that cannot be read or written."""


class StoreConflict(StoreError):
    """A change that other writers kept from being made."""


class SearchError(EngineError):
    """A search that cannot be answered."""


class CompileError(EngineError):
    """A context that cannot be compiled."""


class TemplateError(CompileError):
    """A template that is missing or holds an unknown name."""


class PluginError(EngineError):
    """A provider that is unknown or registered twice."""


class PipelineError(EngineError):
    """A step of ingestion that failed."""


class CatalogError(EngineError):
    """A device catalog that cannot be read."""


class BenchmarkError(EngineError):
    """A question set or report that cannot be read or made."""
