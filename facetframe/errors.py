"""Errors raised while a plan is being described, before any Spark job runs."""


class ValidationError(ValueError):
    """The request does not fit the table: unknown column, wrong type, bad operand."""


class EmptyDataError(ValueError):
    """Raised only in ``strict`` mode, where the operator is allowed to run a job."""
