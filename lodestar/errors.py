"""Errors by kind."""


class CollectionError(Exception):
    """Base of all errors that callers can act on."""


class InvalidArgument(CollectionError):
    pass


class NotFound(CollectionError):
    pass


class AlreadyExists(CollectionError):
    pass


class ResourceExhausted(CollectionError):
    pass


class Conflict(CollectionError):
    """Another writer committed the same version first; nothing of this write is visible."""


class Corrupt(CollectionError):
    """What was stored isn't what was to be stored; nothing of it is visible."""
