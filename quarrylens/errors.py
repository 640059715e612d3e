"""Errors that users of the engine see."""


class AnalysisError(Exception):
    """The analysis cannot start or go on."""


class ConfigError(AnalysisError):
    """A setting is out of its range or a configuration cannot be read."""


class ExportError(AnalysisError):
    """A diagram format is unknown or its tool is missing."""
