"""Errors raised on the driver before any job starts."""


class IntakeError(ValueError):
    """Base of every error this package raises for bad input."""


class UnsupportedFormat(IntakeError):
    """The file extension has no reader."""


class BadEncoding(IntakeError):
    """The file is not UTF-8."""


class BadFilter(IntakeError):
    """A filter names an unknown column or operator, or its literal does not fit the column."""


class BadSort(IntakeError):
    """The sort column or direction is unknown."""


class WriteRejected(IntakeError):
    """A read-only query tried to write."""


class Conflict(IntakeError):
    """The record is not in a state that allows the transition."""


class ValidationFailed(IntakeError):
    """The staged load did not pass validation."""
