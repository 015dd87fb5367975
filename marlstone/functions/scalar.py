"""Types and columns of the dialect's operators. Types must fit exactly; nothing is converted.

Besides int, boolean and string, columns of registered files may have other types of Spark; they
take part where their kind (number or not) fits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.errors import AGGREGATE_SIZE, QueryTypeError

_WHOLE = {"tinyint", "smallint", "int", "bigint"}
_REAL = {"float", "double"}
NULL = "void"


def is_number(t: str) -> bool:
    return t in _WHOLE or t in _REAL or t.startswith("decimal")


def is_whole(t: str) -> bool:
    return t in _WHOLE


def _wider(a: str, b: str) -> str:
    if a == NULL or b == NULL:
        return b if a == NULL else a
    if a in _WHOLE and b in _WHOLE:
        return "bigint" if "bigint" in (a, b) else "int"
    return "double" if a != b or a in _REAL else a


def _kind(t: str) -> str:
    return "number" if is_number(t) else t


def _need(ok: bool, op: str, *types: str) -> None:
    if not ok:
        raise QueryTypeError(f"{op} doesn't take {' and '.join(types)}")


def unary_type(op: str, t: str) -> str:
    if op in ("IS NULL", "IS NOT NULL"):
        return "boolean"
    if op == "NOT":
        _need(t in ("boolean", NULL), op, t)
        return "boolean"
    _need(is_number(t) or t == NULL, f"unary {op}", t)
    return "int" if t == NULL else t


def binary_type(op: str, a: str, b: str) -> str:
    if op in ("AND", "OR"):
        _need({a, b} <= {"boolean", NULL}, op, a, b)
        return "boolean"
    if op == "<=>":
        return "boolean"
    if op in ("=", "<>", "<", ">", "<=", ">="):
        _need(NULL in (a, b) or _kind(a) == _kind(b), op, a, b)
        return "boolean"
    if op == "||":
        _need({a, b} <= {"string", NULL}, op, a, b)
        return "string"
    _need(all(is_number(t) or t == NULL for t in (a, b)), op, a, b)
    t = _wider(a, b)
    return "int" if t == NULL else t



def unary(op: str, x: Column, t: str) -> Column:
    if op == "IS NULL":
        return x.isNull()
    if op == "IS NOT NULL":
        return x.isNotNull()
    if op == "NOT":
        return ~x.cast("boolean")
    x = x.cast("int") if t == NULL else x
    return -x if op == "-" else x


def binary(op: str, x: Column, y: Column, a: str, b: str, null_and: bool = False) -> Column:
    """Whole numbers divide towards zero; division and remainder by zero fail; a comparison with NULL is NULL.
    ``null_and``: so is AND of anything with NULL, FALSE too."""
    if op == "<=>":
        # values of different kinds are never equal, NULL equals NULL
        return x.eqNullSafe(y) if NULL in (a, b) or _kind(a) == _kind(b) else x.isNull() & y.isNull()
    out = binary_type(op, a, b)
    if op in ("AND", "OR"):
        x, y = x.cast("boolean"), y.cast("boolean")
        if op == "AND" and null_and:
            return F.when(x.isNotNull() & y.isNotNull(), x & y)
        return x & y if op == "AND" else x | y
    if op == "||":
        return F.concat(x.cast("string"), y.cast("string"))
    if op in ("=", "<>", "<", ">", "<=", ">="):
        return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    x, y = (v.cast("int") if t == NULL else v for v, t in ((x, a), (y, b)))
    if op == "/":
        return F.call_function("div", x, y).cast(out) if is_whole(out) else x / y
    return {"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op]


def aggregate_type(name: str, t: str, own: bool = False) -> str:
    """``own``: all tables were made by DDL, so whole numbers are of 32 bits."""
    whole = "int" if own else "bigint"
    if name == "COUNT":
        return whole
    _need(is_number(t) or t == NULL, name, t)
    return "double" if t in _REAL or t.startswith("decimal") else whole


def aggregate(name: str, x: Column, t: str, distinct: bool, out: str) -> Column:
    """An aggregate as its type ``out``; one that doesn't fit fails."""
    x = x.cast("int") if t == NULL and name != "COUNT" else x
    n = F.count_distinct(x) if distinct else F.count(x)
    total = None if name == "COUNT" else F.sum_distinct(x) if distinct else F.sum(x)
    return finished(name, total, n, t, out)


def finished(name: str, total: Column | None, n: Column | None, t: str, out: str) -> Column:
    """An aggregate from the sum and the number of its values."""
    value = _finished(name, total, n, t)
    if out != "int":
        return value
    fits = value.isNull() | value.between(-(1 << 31), (1 << 31) - 1)
    return F.when(fits, value).otherwise(F.raise_error(F.lit(AGGREGATE_SIZE)).cast("bigint")).cast("int")


def _finished(name: str, total: Column | None, n: Column | None, t: str) -> Column:
    """AVG of whole numbers is their sum divided by their number, towards zero."""
    if name == "COUNT":
        return n
    if name == "SUM":
        return total
    if is_whole(t) or t == NULL:
        return F.call_function("div", total, F.nullif(n, F.lit(0).cast("bigint")))
    return total / F.nullif(n, F.lit(0).cast("bigint"))


def literal_type(value: object) -> str:
    return NULL if value is None else "boolean" if isinstance(value, bool) else "int" if isinstance(value, int) else "string"
