"""Errors that callers may catch."""


class AccordantError(Exception):
    """Any error of this package."""


class ConfigurationError(AccordantError):
    """A job that can't be run as it is described."""


class InputError(AccordantError):
    """A table that can't be read or lacks a column."""


class BackendUnavailableError(AccordantError):
    """An optional dependency that isn't installed."""
