"""Errors by the part of the engine that raises them."""


class TextloomError(Exception):
    """Any error of this library."""


class TextError(TextloomError):
    """Cleaning, chunking or tokenising."""


class CodecError(TextloomError):
    """Payload encoding or decoding."""


class FrameError(TextloomError):
    """Reading or writing the frame store."""


class EmbeddingError(TextloomError):
    """Embedding texts."""


class SearchError(TextloomError):
    """Vector search: unequal dimensions, nothing to search."""


class StorageError(TextloomError):
    """Reading or writing a memory's tables."""


class PdfError(TextloomError):
    """PDF extraction."""


class ConfigError(TextloomError):
    """A setting out of range."""
