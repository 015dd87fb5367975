"""What the engine raises."""

import re


class EngineError(Exception):
    """Base class."""


class ParseError(EngineError):
    """The text is not in the dialect."""


class PlanningError(EngineError):
    """The text is in the dialect but doesn't fit the tables or the rules of names."""


def _kind(name: str, doc: str) -> type[PlanningError]:
    return type(name, (PlanningError,), {"__doc__": doc, "__module__": __name__})


InvalidLateralJoin = _kind("InvalidLateralJoin", "LATERAL stands where nothing to its left can be seen.")
NonAliasedDerivedTable = _kind("NonAliasedDerivedTable", "A query in FROM has no alias.")
NonUniqueJoinLeafName = _kind("NonUniqueJoinLeafName", "Two tables of one FROM have one name.")
NonExistentTableQualification = _kind("NonExistentTableQualification", "A column is qualified by a name that no FROM around it has.")
InvalidWildcardQualification = _kind("InvalidWildcardQualification", "T.* names no table of its own FROM.")
NonExistentColumn = _kind("NonExistentColumn", "No FROM around it has this column.")
AmbiguousColumnRef = _kind("AmbiguousColumnRef", "Several columns of one FROM have this name.")
TablesDNE = _kind("TablesDNE", "There is no such table.")
InvalidUpdate = _kind("InvalidUpdate", "An UPDATE inside a query, of a key column, or of a column twice.")
InvalidInsert = _kind("InvalidInsert", "An INSERT inside a query, without all key columns, or with rows of another length.")
InvalidDelete = _kind("InvalidDelete", "A DELETE inside a query.")
InvalidColumnRef = _kind("InvalidColumnRef", "A qualified column that the named table doesn't have.")
InvalidSelectClause = _kind("InvalidSelectClause", "Aggregates and other items in one select list.")
RequiredColumnDNE = _kind("RequiredColumnDNE", "A written column isn't in the table.")
InvalidDDL = _kind("InvalidDDL", "A table or column is already there, or isn't.")


class QueryTypeError(EngineError):
    """Operands of types that the operator doesn't take."""


class QueryRuntimeError(EngineError):
    """A fault of the data: a key twice, a subquery without exactly one row, an aggregate that is too large."""


class QueryEvalError(QueryTypeError):
    """An expression that a row's values make fail: division by zero, a number that is too large."""


class Cancelled(EngineError):
    """The request was cancelled before it committed."""


ONE_ROW = "a subquery in an expression has exactly one row"
AGGREGATE_SIZE = "an aggregate doesn't fit its type"


def of_spark(e: BaseException) -> BaseException:
    """The dialect's error for what Spark raised when it computed rows; anything else as it is."""
    text, seen, cause = str(e), 0, getattr(e, "_origin", None) or e
    cause = getattr(cause, "java_exception", cause)
    while cause is not None and hasattr(cause, "getCause") and seen < 50:
        text, cause, seen = f"{text}\n{cause.getMessage()}", cause.getCause(), seen + 1
    if isinstance(e, EngineError):
        return e
    for words in (ONE_ROW, AGGREGATE_SIZE):
        if words in text:
            return QueryRuntimeError(words)
    if found := re.search(r"DIVIDE_BY_ZERO|REMAINDER_BY_ZERO|\w*OVERFLOW\w*|CAST_INVALID_INPUT|NUMERIC_VALUE_OUT_OF_RANGE", text):
        return QueryEvalError(found[0])
    if re.search(r"cancelled (as )?part of cancelled job group|SPARK_JOB_CANCELLED|Job \d+ cancelled", text):
        return Cancelled("the request's jobs were cancelled")
    return e
