"""Errors that a session reports and survives."""


class EngineError(Exception):
    """Any error of a statement."""


class ParseError(EngineError):
    """The statement's text is not of the dialect."""


class BindError(EngineError):
    """The statement is well formed, but its names or types do not fit."""
