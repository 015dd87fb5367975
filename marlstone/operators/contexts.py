"""Queries evaluated for all their outer bindings at once.

A query that uses outer columns is not run once per outer row: the distinct bindings of those columns
are a relation, the query is computed for that relation as a whole, and its result is joined back.
So subqueries nest and skip levels freely, each distinct binding counts once, and Spark sees joins
and aggregations only, whose equality conditions it finds itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone import errors
from marlstone.functions import scalar
from marlstone.operators import running
from marlstone.plans import ast
from marlstone.plans.bind import BoundJoin, BoundQuery, Column, Leaf, references, subqueries

_numbers = count()


def fresh(prefix: str = "x") -> str:
    return f"{prefix}{next(_numbers)}"


def all_true(conditions: list[SparkColumn]) -> SparkColumn:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


class Lowering:
    """``rows``: a table's DataFrame by its name. ``strict``: a subquery in an expression has exactly one row. ``null_and``: see ``scalar.binary``."""

    def __init__(self, rows: Callable[[str], DataFrame], strict: bool = True, null_and: bool = False):
        self.rows, self.strict, self.null_and = rows, strict, null_and

    # expressions

    def column(self, e: object, known: dict[object, SparkColumn]) -> SparkColumn:
        if isinstance(e, Column):
            return F.col(e.internal)
        if isinstance(e, ast.Literal):
            return F.lit(e.value)
        if isinstance(e, ast.Name):
            return F.col(e.bound.internal)
        if isinstance(e, ast.Unary):
            return scalar.unary(e.op, self.column(e.arg, known), e.arg.type)
        if isinstance(e, ast.Binary):
            return scalar.binary(e.op, self.column(e.left, known), self.column(e.right, known), e.left.type, e.right.type, self.null_and)
        if isinstance(e, ast.Aggregate):
            return scalar.aggregate(e.name, self.column(e.arg, known), e.arg.type, e.distinct, e.type)
        return known[e]

    def attach(self, df: DataFrame, expressions: list) -> tuple[DataFrame, dict[object, SparkColumn]]:
        """Adds a column for every subquery in the expressions, by what its rows of ``df`` bind."""
        known: dict[object, SparkColumn] = {}
        for node in [s for e in expressions if not isinstance(e, Column) for s in subqueries(e)]:
            q: BoundQuery = node.bound
            value, n = fresh("v"), fresh("n")
            keys = sorted(q.free)
            rows = self.query(q, df.select(*keys).distinct() if keys else None)
            renamed = [fresh("k") for _ in keys]
            rows = rows.select(*(F.col(k).alias(r) for k, r in zip(keys, renamed, strict=True)), F.col(q.out[0].internal).alias(value))
            if not q.single:
                rows = rows.groupBy(*renamed).agg(F.count(F.lit(1)).alias(n), F.first(value).alias(value))
            if keys:
                df = df.join(rows, all_true([F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, renamed, strict=True)]), "left").drop(*renamed)
            else:
                df = df.crossJoin(F.broadcast(rows))  # one row
            known[node] = F.col(value)
            if not q.single:
                wrong = F.raise_error(F.lit(errors.ONE_ROW)).cast(q.out[0].type)
                one = F.when(F.col(n) == 1, F.col(value))
                none = F.coalesce(F.col(n), F.lit(0)) == 0
                known[node] = one.otherwise(wrong) if self.strict else one.when(none, F.lit(None)).otherwise(wrong)
        return df, known

    def filtered(self, df: DataFrame, conditions: list) -> DataFrame:
        """Conditions without subqueries go first."""
        plain = [c for c in conditions if not any(True for _ in subqueries(c))]
        if plain:
            df = df.where(all_true([self.column(c, {}).cast("boolean") for c in plain]))
        rest = [c for c in conditions if c not in plain]
        if rest:
            before = df.columns
            df, known = self.attach(df, rest)
            df = df.where(all_true([self.column(c, known).cast("boolean") for c in rest])).select(*before)
        return df

    # FROM

    def leaf(self, leaf: Leaf, bindings: DataFrame | None) -> DataFrame:
        if leaf.table is not None:
            df = self.rows(leaf.table).select(*(F.col(f"`{c.name}`").alias(c.internal) for c in leaf.columns))
            return bindings.crossJoin(df) if bindings is not None else df
        q = leaf.query
        names = [F.col(o.internal).alias(c.internal) for o, c in zip(q.out, leaf.columns, strict=True)]
        keys = sorted(q.free)
        if not keys:
            df = self.query(q, None).select(*names)
            return bindings.crossJoin(df) if bindings is not None else df
        df = self.query(q, bindings.select(*keys).distinct())
        renamed = {k: fresh("k") for k in keys}
        df = df.select(*(F.col(k).alias(r) for k, r in renamed.items()), *names)
        return bindings.join(df, all_true([F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()])).drop(*renamed.values())

    def _needs(self, tree: object, outer: set[str]) -> bool:
        """Does something below use outer columns?"""
        if isinstance(tree, Leaf):
            return bool(tree.query and tree.query.free & outer)
        return self._needs(tree.left, outer) or self._needs(tree.right, outer) or any(references(c) & outer for c in tree.on)

    def source(self, tree: object, bindings: DataFrame | None) -> DataFrame:
        """The rows of a FROM; with ``bindings``, their columns and the rows for each of them."""
        if isinstance(tree, Leaf):
            return self.leaf(tree, bindings)
        outer = set(bindings.columns) if bindings is not None else set()
        side_of = {"inner": "left", "left": "left", "right": "right"}.get(tree.kind, "both")

        def lowered(part: object, side: str) -> DataFrame:
            own = bindings is not None and (side_of in (side, "both") or self._needs(part, outer))
            return self.source(part, bindings if own else None)

        lateral = isinstance(tree.right, Leaf) and tree.right.lateral
        left = lowered(tree.left, "left")
        if lateral and tree.right.query.free:
            return self._lateral(left, tree)
        right = lowered(tree.right, "right")
        both = sorted(outer & set(left.columns) & set(right.columns))
        renamed = {k: fresh("k") for k in both}
        right = right.select(*(F.col(c).alias(renamed.get(c, c)) for c in right.columns))
        same = [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]
        out = self.join(tree, left, right, same)
        if tree.kind == "right":
            return out.drop(*both).withColumnsRenamed({r: k for k, r in renamed.items()})
        if tree.kind == "full":
            out = out.withColumns({k: F.coalesce(F.col(k), F.col(r)) for k, r in renamed.items()})
        return out.drop(*renamed.values())

    def _lateral(self, left: DataFrame, tree: BoundJoin) -> DataFrame:
        leaf: Leaf = tree.right
        keys = sorted(leaf.query.free)
        right = self.query(leaf.query, left.select(*keys).distinct())
        renamed = {k: fresh("k") for k in keys}
        right = right.select(*(F.col(k).alias(r) for k, r in renamed.items()), *(F.col(o.internal).alias(c.internal) for o, c in zip(leaf.query.out, leaf.columns, strict=True)))
        return self.join(tree, left, right, [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]).drop(*renamed.values())

    def join(self, tree: BoundJoin, left: DataFrame, right: DataFrame, same: list[SparkColumn]) -> DataFrame:
        plain = [c for c in tree.on if not any(True for _ in subqueries(c))]
        asking = [c for c in tree.on if c not in plain]
        conditions = same + [self.column(c, {}).cast("boolean") for c in plain]
        if tree.kind == "inner":
            out = left.join(right, all_true(conditions)) if conditions else left.crossJoin(right)
            return self.filtered(out, asking)
        if not asking:
            return left.join(right, all_true(conditions), tree.kind)
        one_side: list[SparkColumn] = []
        two_sides = []
        for c in asking:
            needed = references(c)
            if needed <= set(left.columns):
                left, name = self._computed(left, c)
                one_side.append(F.col(name))
            elif needed <= set(right.columns):
                right, name = self._computed(right, c)
                one_side.append(F.col(name))
            else:
                two_sides.append(c)
        conditions += one_side
        if not two_sides:
            return left.join(right, all_true(conditions), tree.kind)
        return self._by_both(tree.kind, left, right, conditions, two_sides)

    def _computed(self, df: DataFrame, e: object) -> tuple[DataFrame, str]:
        before, name = df.columns, fresh("j")
        df, known = self.attach(df, [e])
        return df.select(*before, self.column(e, known).cast("boolean").alias(name)), name

    def _by_both(self, kind: str, left: DataFrame, right: DataFrame, conditions: list[SparkColumn], asking: list) -> DataFrame:
        """Outer join on subqueries that use both sides: the bindings for which they hold are joined first."""
        needed = set().union(*map(references, asking))
        lk, rk = sorted(needed & set(left.columns)), sorted(needed & set(right.columns))
        bindings = left.join(right, all_true(conditions)) if conditions else left.crossJoin(right)
        held = self.filtered(bindings.select(*lk, *rk).distinct(), asking)
        names = {k: fresh("h") for k in lk + rk}
        held = held.select(*(F.col(k).alias(n) for k, n in names.items()))

        def with_held(side: DataFrame, keys: list[str]) -> DataFrame:
            return side.join(held, all_true([F.col(k).eqNullSafe(F.col(names[k])) for k in keys])) if keys else side.crossJoin(held)

        def match(keys: list[str]) -> SparkColumn:
            return all_true(conditions + [F.col(k).eqNullSafe(F.col(names[k])) for k in keys])

        columns = left.columns + right.columns
        if kind == "right":
            return with_held(left, lk).join(right, match(rk), "right").select(*columns)
        out = left.join(with_held(right, rk), match(lk), "left").select(*columns)
        if kind == "full":
            alone = right.join(with_held(left, lk), match(rk), "left_anti")
            out = out.unionByName(alone.select(*(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), *right.columns))
        return out

    # queries

    def query(self, q: BoundQuery, bindings: DataFrame | None) -> DataFrame:
        """The query's output columns, with ``bindings`` (exactly the outer columns it uses, distinct) for each of these."""
        keys = sorted(q.free)
        if q.aggregates and keys and not self._needs(q.source, q.free) and (shape := running.shape(q)):
            return self._for_each(q, bindings, self._running(q, shape, bindings))
        df = self.filtered(self.source(q.source, bindings if keys else None), q.where)
        exprs = [e for e, _ in q.items]
        df, known = self.attach(df, exprs)
        made = [self.column(e, known).alias(c.internal) for e, c in q.items]
        if not q.aggregates:
            df = df.select(*keys, *made)
        elif not keys:
            df = df.agg(*made)
        else:
            df = self._for_each(q, bindings, df.groupBy(*keys).agg(*made))
        return df.distinct() if q.distinct else df

    def _running(self, q: BoundQuery, shape: running.Shape, bindings: DataFrame) -> DataFrame:
        rows = self.filtered(self.source(q.source, None), shape.mine)
        return running.totals(q, shape, rows, self.filtered(bindings, shape.theirs), lambda e: self.column(e, {}), fresh)

    def _for_each(self, q: BoundQuery, bindings: DataFrame, groups: DataFrame) -> DataFrame:
        """Aggregates of all bindings from those of the ones that have rows."""
        keys = sorted(q.free)
        renamed = {k: fresh("k") for k in keys}
        groups = groups.select(*(F.col(k).alias(r) for k, r in renamed.items()), *(c.internal for c in q.out))
        df = bindings.join(groups, all_true([F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]), "left")
        counts = {c.internal: c.type for e, c in q.items if e.name == "COUNT"}
        return df.select(*keys, *(F.coalesce(c.internal, F.lit(0)).cast(counts[c.internal]).alias(c.internal) if c.internal in counts else F.col(c.internal) for c in q.out))
