"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised here."""


class ParseError(EngineError):
    """The statement is not in the grammar."""


class Unsupported(EngineError):
    """The statement is understood and refused."""


class TypeMismatch(EngineError):
    """Operands or columns of types that do not go together."""


class UnknownName(EngineError):
    """No such table, column, schema or constraint."""


class AmbiguousName(EngineError):
    """A name that means more than one column."""


class Conflict(EngineError):
    """A duplicate key, or a transaction that another one overtook."""


class ConstraintViolation(EngineError):
    """A row that NOT NULL, CHECK, UNIQUE or FOREIGN KEY forbids."""


class ResourceLimit(EngineError):
    """A statement beyond a limit; nothing is truncated."""
