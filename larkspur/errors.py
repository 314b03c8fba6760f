"""Errors a statement can end with."""


class EngineError(Exception):
    """Base of all errors raised for a statement."""


class ParseError(EngineError):
    """The text is not a statement of the language."""


class SemanticError(EngineError):
    """A name, domain or shape does not fit the catalog."""


class ConstraintError(EngineError):
    """A primary or foreign key would be violated; nothing was changed."""


class ConflictError(EngineError):
    """Another engine has changed the stored catalog; nothing of this change is kept."""


class ProcedureError(EngineError):
    """A stored procedure could not be compiled or run."""
