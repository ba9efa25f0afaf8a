"""Errors of the library."""


class PanelError(Exception):
    """Any failure that the library reports."""


class InvalidArgument(PanelError):
    """A parameter or table does not fit the request."""


class IoError(PanelError):
    """A file cannot be read or is malformed."""


class InvalidKmer(PanelError):
    """A k-mer holds a character other than A, C, G, T."""
