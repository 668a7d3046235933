"""DB-API exception classes, and the mapping from Spark's exceptions to them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class Warning(Exception):  # noqa: A001
    """DB-API Warning."""


class Error(Exception):
    """Base of all errors of this engine."""


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class IntegrityError(DatabaseError):
    pass


class InternalError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


class NotSupportedError(DatabaseError):
    pass


class ParserException(ProgrammingError):
    pass


class BinderException(ProgrammingError):
    pass


class CatalogException(ProgrammingError):
    pass


class InvalidInputException(ProgrammingError):
    pass


class ConversionException(DataError):
    pass


class OutOfRangeException(DataError):
    pass


class TypeMismatchException(DataError):
    pass


class IOException(OperationalError):
    pass


class ConnectionException(OperationalError):
    pass


class TransactionException(OperationalError):
    pass


class NotImplementedException(NotSupportedError):
    pass


#: What Spark's error condition starts with, and the class that stands for it.
_CONDITIONS = [
    ("PARSE_SYNTAX_ERROR", ParserException),
    ("TABLE_OR_VIEW_NOT_FOUND", CatalogException),
    ("TABLE_OR_VIEW_ALREADY_EXISTS", CatalogException),
    ("SCHEMA_NOT_FOUND", CatalogException),
    ("UNRESOLVED_ROUTINE", CatalogException),
    ("UNRESOLVED", BinderException),
    ("AMBIGUOUS", BinderException),
    ("MISSING_AGGREGATION", BinderException),
    ("DATATYPE_MISMATCH", BinderException),
    ("CAST_INVALID_INPUT", ConversionException),
    ("CANNOT_PARSE", ConversionException),
    ("CAST_OVERFLOW", OutOfRangeException),
    ("ARITHMETIC_OVERFLOW", OutOfRangeException),
    ("NUMERIC_VALUE_OUT_OF_RANGE", OutOfRangeException),
    ("DIVIDE_BY_ZERO", DataError),
    ("PATH_NOT_FOUND", IOException),
    ("PATH_ALREADY_EXISTS", IOException),
    ("FAILED_READ_FILE", IOException),
    ("UNSUPPORTED", NotImplementedException),
]


def translate(error: BaseException) -> BaseException:
    """The error of this engine that stands for one of Spark's; others as they are."""
    from pyspark.errors import AnalysisException, ParseException, PySparkException

    if isinstance(error, Error) or not isinstance(error, PySparkException):
        return error
    condition = error.getCondition() or ""
    for start, kind in _CONDITIONS:
        if condition.startswith(start):
            return kind(str(error))
    if isinstance(error, ParseException):
        return ParserException(str(error))
    return (BinderException if isinstance(error, AnalysisException) else OperationalError)(str(error))


@contextmanager
def translated() -> Iterator[None]:
    try:
        yield
    except Exception as error:
        if (own := translate(error)) is error:
            raise
        raise own from error
