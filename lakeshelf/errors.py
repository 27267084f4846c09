"""Errors that callers can rely on."""


class ShelfError(Exception):
    """Base of all errors raised here."""


class NotFoundError(ShelfError):
    """No record or content with that id."""


class ValidationError(ShelfError, ValueError):
    """An argument that can't be accepted."""


class ClosedError(ShelfError):
    """The shelf isn't open."""


class NotSupportedError(ShelfError):
    """An input of an unknown form."""


class QuotaError(ShelfError):
    """The storage below is full."""


def translate_storage_error(error: Exception) -> ShelfError:
    """A shelf error for what the storage below raised."""
    if isinstance(error, ShelfError):
        return error
    text = f"{type(error).__name__}: {error}"
    full = any(mark in text for mark in ("No space left", "Quota", "DSQuotaExceeded", "ENOSPC"))
    return (QuotaError if full else ShelfError)(text)
