"""Errors of the row format."""


class RowFormatError(ValueError):
    """Any fault of a schema, a value or a file."""


class SchemaError(RowFormatError):
    """A schema that cannot be parsed or mapped."""


class EncodeError(RowFormatError):
    """A value that its schema cannot hold."""


class DecodeError(RowFormatError):
    """Bytes that are not of their schema."""


class ContainerError(RowFormatError):
    """A file that is no container, or a damaged one."""
