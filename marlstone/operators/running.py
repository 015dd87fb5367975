"""Correlated aggregates that compare by one inequality, without pairs of rows and bindings.

``(SELECT COUNT(x) FROM t WHERE t.a = outer.a AND t.v < outer.b)`` asks for the total of those rows of
a group that lie before a bound. Rows, summed up by group and value, and bindings are dealt by group
and value into ranges of about equal numbers, whose limits come from the rows of least hashes. In a
range, sorted, the sum so far is each binding's answer; a group that goes on over several ranges gets
the totals of its earlier ones as rows of their own, at the start of the range. So neither one large
group nor a correlation by inequality alone falls to one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import scalar
from marlstone.plans import ast
from marlstone.plans.bind import BoundQuery, children, references, subqueries

_RANGES = 256  # a power of two
_SAMPLE = 8192
_TURNED = {"=": "=", "<=>": "<=>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
#: what a line of a range is, in the order of lines with equal values
_CARRIED, _FIRST, _SECOND = 0, 1, 2


@dataclass
class Pair:
    """``mine`` of a row compared with ``theirs`` of a binding, both as ``type``."""

    mine: object
    op: str
    theirs: object
    type: str


@dataclass
class Shape:
    bound: Pair | None = None
    equal: list[Pair] = field(default_factory=list)
    mine: list = field(default_factory=list)  # conditions on rows alone
    theirs: list = field(default_factory=list)  # on bindings alone


def never_fails(e: object) -> bool:
    """May it be computed for rows that the query wouldn't have asked it for?"""
    if isinstance(e, ast.Subquery):
        return False
    arithmetic = isinstance(e, ast.Binary) and e.op in ("+", "-", "*", "/", "%") or isinstance(e, ast.Unary) and e.op == "-"
    if arithmetic and (e.op in ("/", "%") or e.type not in ("float", "double")):
        return False
    return all(map(never_fails, children(e)))


def _common(a: str, b: str) -> str | None:
    """The type in which Spark compares, where both sides can be cast to it alone."""
    if a == b:
        return None if a == scalar.NULL or a.startswith(("map", "array", "struct")) else a
    if scalar.is_whole(a) and scalar.is_whole(b):
        return "bigint"
    return "double" if "double" in (a, b) and (scalar.is_whole(a) or scalar.is_whole(b)) else None


def shape(q: BoundQuery) -> Shape | None:
    """The parts of such a query; None for any other."""
    out = Shape()
    for e, _ in q.items:
        summed = e.name == "COUNT" or scalar.is_whole(e.arg.type) or e.arg.type in ("float", "double", scalar.NULL)
        if e.distinct or not summed or not never_fails(e.arg) or references(e.arg) & q.free:
            return None
    for c in q.where:
        needed = references(c)
        if any(True for _ in subqueries(c)):
            return None
        if not needed & q.free:
            out.mine.append(c)
            continue
        if needed <= q.free:
            out.theirs.append(c)
            continue
        if not isinstance(c, ast.Binary) or c.op not in _TURNED:
            return None
        mine, op, theirs = c.left, c.op, c.right
        if references(mine) <= q.free:
            mine, op, theirs = theirs, _TURNED[op], mine
        if references(mine) & q.free or not references(theirs) <= q.free:
            return None
        if not (common := _common(mine.type, theirs.type)):
            return None
        pair = Pair(mine, op, theirs, common)
        if op in ("=", "<=>"):
            out.equal.append(pair)
        elif out.bound:
            return None
        else:
            out.bound = pair
    return out if out.bound else None


def totals(q: BoundQuery, s: Shape, rows: DataFrame, bindings: DataFrame, column: Callable[[object], SparkColumn], fresh: Callable[[str], str]) -> DataFrame:
    """The bindings' columns and the query's output for every binding whose bound isn't NULL, if rows or bindings share its group.

    ``rows`` and ``bindings`` have passed the conditions on them alone.
    """
    free, op = bindings.columns, s.bound.op
    keys, value, kind, place, limits = [fresh("k") for _ in s.equal] or [fresh("k")], fresh("v"), fresh("t"), fresh("p"), fresh("l")

    def grouped(df: DataFrame, side: str) -> DataFrame:
        if not s.equal:
            return df.withColumn(keys[0], F.lit(0))
        df = df.withColumns({k: column(getattr(p, side)).cast(p.type) for k, p in zip(keys, s.equal, strict=True)})
        for k, p in zip(keys, s.equal, strict=True):
            df = df.where(F.col(k).isNotNull()) if p.op == "=" else df
        return df

    def met(df: DataFrame, other: DataFrame) -> DataFrame:
        """Lines whose group is on the other side too: only for these may something that can fail be computed."""
        renamed = {k: fresh("k") for k in keys}
        other = other.select(*(F.col(k).alias(r) for k, r in renamed.items())).distinct()
        same = F.lit(True)
        for k, r in renamed.items():
            same &= F.col(k).eqNullSafe(F.col(r))
        return df.join(other, same, "left_semi")

    rows, bindings = grouped(rows, "mine"), grouped(bindings, "theirs")
    if not never_fails(s.bound.mine):
        rows = met(rows, bindings)
    if not never_fails(s.bound.theirs):
        bindings = met(bindings, rows)
    rows = rows.withColumn(value, column(s.bound.mine).cast(s.bound.type))
    bindings = bindings.withColumn(value, column(s.bound.theirs).cast(s.bound.type))

    # conditions on a value that can fail would move before ``met``: rows without one count as nothing instead
    parts: dict[str, tuple[SparkColumn, str]] = {}
    names: list[tuple[str | None, str | None]] = []
    for e, _ in q.items:
        x = F.when(F.col(value).isNotNull(), column(e.arg))
        total, n = None if e.name == "COUNT" else fresh("s"), None if e.name == "SUM" else fresh("n")
        if total:
            wide = "double" if e.arg.type in ("float", "double") else "decimal(38,0)"
            parts[total] = F.sum(x.cast("double" if wide == "double" else "decimal(20,0)")).cast(wide), wide
        if n:
            parts[n] = F.count(x), "bigint"
        names.append((total, n))
    rows = rows.groupBy(*keys, value).agg(*(x.alias(name) for name, (x, _) in parts.items()))

    strict = op in ("<", ">")
    row, binding = (_SECOND, _FIRST) if strict else (_FIRST, _SECOND)
    nothing = [F.lit(None).cast(bindings.schema[c].dataType).alias(c) for c in free]
    lines = rows.select(*keys, value, F.lit(row).alias(kind), *nothing, *parts).union(
        bindings.select(*keys, value, F.lit(binding).alias(kind), *free, *(F.lit(None).cast(t).alias(name) for name, (_, t) in parts.items()))
    )

    # one line for each remainder of a hash that has no chance in it: every reading of the plan draws the same limits
    hashed, mark, at = fresh("h"), fresh("h"), F.struct(F.struct(*keys).alias("group"), F.col(value).alias("value"))
    drawn = lines.withColumn(hashed, F.xxhash64(kind, *keys, value, *free))
    least = drawn.groupBy(F.pmod(hashed, F.lit(_SAMPLE))).agg(F.min(hashed).alias(mark)).select(mark)
    drawn = drawn.join(F.broadcast(least), F.col(hashed) == F.col(mark), "left_semi").agg(F.sort_array(F.collect_list(at)).alias("all"))
    drawn = F.broadcast(drawn.select(F.transform(F.sequence(F.lit(1), F.lit(_RANGES - 1)), lambda i: F.get("all", F.floor(i * F.size("all") / _RANGES).cast("int"))).alias(limits)))

    def before(df: DataFrame, name: str, x: SparkColumn, holds: Callable[[SparkColumn, SparkColumn], SparkColumn]) -> DataFrame:
        """``df`` with the number of limits that hold for ``x``, all of which come first: a binary search, in steps that Spark compiles."""
        columns, mine = df.columns, fresh("x")
        df, n = df.withColumn(mine, x).crossJoin(drawn), F.lit(0)
        for i in range(1, _RANGES.bit_length()):
            step, found = _RANGES >> i, fresh("b")
            df = df.withColumn(found, n + F.when(holds(F.get(limits, n + (step - 1)), F.col(mine)), F.lit(step)).otherwise(0))
            n = F.col(found)
        return df.select(*columns, n.alias(name))

    lines = before(lines, place, at, lambda limit, x: limit <= x)

    ends = lines.where(F.col(kind) == row).groupBy(*keys, place).agg(*(F.sum(name).cast(t).alias(name) for name, (_, t) in parts.items()))
    end = fresh("e")
    if op in ("<", "<="):
        ends = before(ends, end, F.struct(*keys), lambda limit, x: limit["group"] <= x)
        later = F.when(F.col(place) < F.col(end), F.sequence(F.col(place) + 1, F.col(end)))
    else:
        ends = before(ends, end, F.struct(*keys), lambda limit, x: limit["group"] < x)
        later = F.when(F.col(place) > F.col(end), F.sequence(F.col(end), F.col(place) - 1))
    # a condition on ``end``, one that explode() implies too, would move before the search and write out all its steps, each twice in the next
    ends = ends.withColumn(place, F.explode_outer(later)).where(F.col(place).isNotNull())
    carried = ends.select(*keys, F.lit(None).cast(s.bound.type).alias(value), F.lit(_CARRIED).alias(kind), *nothing, *parts, place)

    order = F.col(value).asc_nulls_last() if op in ("<", "<=") else F.col(value).desc_nulls_last()
    so_far = Window.partitionBy(place, *keys).orderBy(F.col(kind) != _CARRIED, order, kind).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = lines.select(*keys, value, kind, *free, *parts, place).union(carried).withColumns({name: F.sum(name).over(so_far) for name in parts})
    answers = answers.where((F.col(kind) == binding) & F.col(value).isNotNull())

    made = []
    for (e, c), (total, n) in zip(q.items, names, strict=True):
        whole = total and parts[total][1] != "double"
        made.append(scalar.finished(e.name, F.col(total).cast("bigint") if whole else total and F.col(total), n and F.coalesce(n, F.lit(0).cast("bigint")), e.arg.type, e.type).alias(c.internal))
    return answers.select(*free, *made)
