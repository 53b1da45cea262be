"""Errors of the public interface."""


class PalimpsestError(Exception):
    """Anything the engine reports on purpose."""


class InvalidRequest(PalimpsestError, ValueError):
    """An argument is not among those allowed."""


class StorageError(PalimpsestError):
    """A table could not be read or written."""


class RetrievalError(PalimpsestError):
    """A search could not be answered."""


class ExtractionError(PalimpsestError):
    """A model's answer could not be used."""
