"""The engine: requests of the dialect over a catalog of versioned tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import errors
from marlstone.functions import scalar
from marlstone.operators.contexts import Lowering, fresh
from marlstone.plans import ast
from marlstone.plans.bind import Binder, BoundQuery, Frame, conjuncts
from marlstone.plans.parser import parse
from marlstone.sources.catalog import Catalog, Table

_DDL = (ast.CreateTable, ast.AlterTable, ast.DropTable)
#: The driver's tables with their keys.
PARQUET_KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",)}


@dataclass
class Result:
    """``header``: names of the columns, None for a nameless one, possibly repeated; ``rows``: a bag in this order."""

    header: list[str | None]
    rows: DataFrame

    def collect(self) -> list[tuple]:
        try:
            return [tuple(r) for r in self.rows.collect()]
        except Exception as e:
            raise errors.of_spark(e) from e

    def named(self) -> DataFrame:
        """Rows under their names; a nameless or repeated one gets its position."""
        return self.rows.toDF(*(n if n and self.header.count(n) == 1 else f"{n or 'column'}_{i + 1}" for i, n in enumerate(self.header)))

    def counted(self) -> DataFrame:
        """The different rows with their count, a nameless column as ``<nameless>``."""
        inner = [f"c{i}" for i in range(len(self.header))]
        return self.rows.toDF(*inner).groupBy(*inner).agg(F.count(F.lit(1)).alias("n")).select("n", *inner).toDF("count", *(n or "<nameless>" for n in self.header))


class Engine:
    """``strict``: a subquery in an expression must have exactly one row (else none counts as NULL).
    ``null_and``: AND with NULL is NULL, ``FALSE AND NULL`` too."""

    def __init__(self, spark: SparkSession, root: str | None = None, strict: bool = True, null_and: bool = False):
        self.spark, self.strict, self.null_and, self.catalog = spark, strict, null_and, Catalog(spark, root)
        self._lock = Lock()
        self._running: dict[str, bool] = {}  # requests by id: cancelled?

    @classmethod
    def over(cls, spark: SparkSession, folder: str, **options) -> Engine:
        """An engine over the Parquet tables of a folder; a table's files are looked at when a request names it."""
        engine = cls(spark, **options)
        for name, keys in PARQUET_KEYS.items():
            engine.catalog.register(name, lambda name=name: spark.read.parquet(f"{folder}/{name}.parquet"), keys)
        return engine

    # requests

    def execute(self, text: str, request: str | None = None, at: int | None = None, marks: dict[str, list[int]] | None = None) -> Result:
        """Runs a request: one DDL statement, or statements that commit together; the last one's result.

        All changed tables are computed before anything is committed, so a request that fails changes
        nothing. With an id in ``request`` it can be cancelled meanwhile, and a SELECT's rows are
        computed before this returns. ``at``: a commit's number; the tables as of it are read, and
        can't be changed. ``marks`` are committed with the changes, or alone if there are none.
        """
        statements = parse(text)
        ddl = any(isinstance(s, _DDL) for s in statements)
        if ddl and (len(statements) > 1 or at is not None):
            raise errors.ParseError("a change of tables is a request of its own, of the tables as they are")
        with self._request(request, text):
            if ddl:
                changed, result = self._ddl(statements[0])
            else:
                transaction = Transaction(self, at)
                for s in statements:
                    result = transaction.run(s)
                changed = transaction.changed
            if at is not None and changed:
                raise errors.QueryRuntimeError("an older version can't be changed")
            if request and not changed and result.header:
                result = self._computed(result)
            if changed or marks:
                prepared = self.catalog.prepare(changed, faults=not ddl)
                with self._lock:  # a cancel comes before this or finds the request committed
                    if not self._running.get(request, False):
                        self.catalog.install(prepared, marks or {})
                        return result
                self.catalog.discard(prepared)
            if self._running.get(request, False):
                raise errors.Cancelled(request)
        return result

    @contextmanager
    def _request(self, request: str | None, text: str) -> Iterator[None]:
        if request is None:
            yield
            return
        context = self.spark.sparkContext
        with self._lock:
            if request in self._running:
                raise errors.QueryRuntimeError(f"the request {request} is running")
            self._running[request] = False
        context.setJobGroup(request, text[:200], interruptOnCancel=True)
        try:
            yield
        except Exception as e:
            if self._running[request] or isinstance(errors.of_spark(e), errors.Cancelled):
                raise errors.Cancelled(request) from e
            raise errors.of_spark(e) from e
        finally:
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(name, None)
            with self._lock:
                self._running.pop(request)

    def cancel(self, request: str) -> bool:
        """Stops a running request that hasn't committed; it raises Cancelled and changes nothing. False: there is none."""
        with self._lock:
            if request not in self._running:
                return False
            self._running[request] = True
        self.spark.sparkContext.cancelJobGroup(request)
        return True

    def _computed(self, result: Result) -> Result:
        """The rows as they are now, in a table of their own."""
        inner = tuple((f"c{i}", t) for i, (_, t) in enumerate(result.rows.dtypes))
        rows = result.rows.toDF(*(c for c, _ in inner))
        held = self.catalog.prepare({"results": Table(inner, (), rows)})["results"]
        return Result(result.header, held.rows)

    def run_script(self, text: str) -> Iterator[Result]:
        """Requests separated by lines ``-- Separate``, one after the other."""
        for part in re.split(r"(?im)^\s*--\s*separate\s*$", text):
            if part.strip():
                yield self.execute(part)

    def tables(self) -> DataFrame:
        return self.catalog.describe()

    def describe(self, table: str) -> DataFrame:
        return self.catalog.describe(table)

    def split(self, table: str, parts: int) -> None:
        self.catalog.split(table, parts)

    # DDL

    def _empty(self, columns: list[tuple[str, str]]) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns))

    def _ddl(self, s: object) -> tuple[dict[str, Table | None], Result]:
        table = self.catalog.tables.get(s.table)
        if isinstance(s, ast.CreateTable):
            if table:
                raise errors.InvalidDDL(f"{s.table} is there")
            # keys first, both parts by name
            columns = sorted(s.columns, key=lambda c: (c[0] not in s.keys, c[0]))
            new = Table(tuple(columns), tuple(sorted(s.keys)), self._empty(columns))
        elif not table:
            raise errors.InvalidDDL(f"{s.table} isn't there")
        elif isinstance(s, ast.DropTable):
            new = None
        elif s.add:
            name, kind = s.add
            if name in table.types():
                raise errors.InvalidDDL(f"{name} is there")
            values = sorted([c for c in table.columns if c[0] not in table.keys] + [(name, kind)])
            columns = tuple([c for c in table.columns if c[0] in table.keys] + values)
            rows = table.rows.withColumn(name, F.lit(None).cast(kind)).select(*(f"`{c}`" for c, _ in columns))
            new = replace(table, columns=columns, rows=rows, version=table.version + 1, depth=table.depth + 1)
        else:
            if s.drop not in table.types() or s.drop in table.keys:
                raise errors.InvalidDDL(f"{s.drop} isn't there or is a key")
            columns = tuple(c for c in table.columns if c[0] != s.drop)
            new = replace(table, columns=columns, rows=table.rows.drop(s.drop), version=table.version + 1, depth=table.depth + 1)
        return {s.table: new}, self._nothing()

    def _nothing(self) -> Result:
        return Result([], self.spark.createDataFrame([], "none string").select())


class Transaction:
    """Statements that see what those before them wrote; nothing is committed here."""

    def __init__(self, engine: Engine, at: int | None = None):
        self.engine, self.spark = engine, engine.spark
        self.tables = engine.catalog.tables if at is None else engine.catalog.at(at)
        self.changed: dict[str, Table | None] = {}

    def run(self, q: ast.Query, ctes: dict | None = None) -> Result:
        """A statement. Queries that WITH names may be changes too: they run in turn, and the name stands for their result."""
        binder, ctes, body = Binder(self.tables), dict(ctes or {}), q
        stages = any(_changes(inner) for inner in _named(q))
        while isinstance(body, ast.Query):
            for name, inner in body.ctes:
                if not stages:
                    ctes[name] = binder.query(inner, ctes, None)
                    continue
                result = self.run(inner, ctes)  # what it reads is as of now, whatever later ones change
                hidden = f"{name}\0{len(self.tables)}"
                names = [n or f"\0{i}" for i, n in enumerate(result.header)]
                inside = [f"c{i}" for i in range(len(names))]
                held = Table(tuple(zip(inside, (t for _, t in result.rows.dtypes), strict=True)), (), result.rows.toDF(*inside), own=all(t.own for t in self.tables._held.values() if isinstance(t, Table)))
                self.tables = self.tables.changed({hidden: held})
                binder = Binder(self.tables)
                leaf = binder.table_leaf(hidden, name)
                items = [(c, binder.column(n if n[0] != "\0" else None, c.type)) for c, n in zip(leaf.columns, names, strict=True)]
                ctes[name] = BoundQuery(out=[c for _, c in items], source=leaf, items=items, own=held.own)
            body = body.body
        lowering = Lowering(lambda n: self.tables[n].rows, self.engine.strict, self.engine.null_and)
        if isinstance(body, ast.Insert):
            return self._insert(body)
        if isinstance(body, ast.Update):
            return self._update(body, binder, ctes, lowering)
        if isinstance(body, ast.Delete):
            return self._delete(body, binder, ctes, lowering)
        bound = binder.select(body, ctes, None)
        rows = lowering.query(bound, None)
        return Result([c.name for c in bound.out], rows.select(*(c.internal for c in bound.out)))

    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise errors.TablesDNE(name)
        return self.tables[name]

    def _write(self, name: str, rows: DataFrame) -> None:
        old = self.tables[name]
        rows = rows.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in old.columns))
        self.changed[name] = replace(old, rows=rows, version=old.version + 1, depth=old.depth + 1)
        self.tables = self.tables.changed({name: self.changed[name]})

    # INSERT

    def _insert(self, s: ast.Insert) -> Result:
        table = self._table(s.table)
        types = table.types()
        for c in s.columns:
            if c not in types:
                raise errors.RequiredColumnDNE(c)
        if len(set(s.columns)) < len(s.columns) or not set(table.keys) <= set(s.columns) or any(len(r) != len(s.columns) for r in s.rows):
            raise errors.InvalidInsert(s.table)
        rows = [[_constant(e) for e in r] for r in s.rows]
        for r in rows:
            for c, v in zip(s.columns, r, strict=True):
                if v is None and c in table.keys:
                    raise errors.QueryTypeError(f"{c} is a key and can't be NULL")
                if v is not None and not _fits(scalar.literal_type(v), types[c]):
                    raise errors.QueryTypeError(f"{c} is of type {types[c]}")
        keys = [tuple(r[s.columns.index(k)] for k in table.keys) for r in rows]
        if len(set(keys)) < len(keys):
            raise errors.QueryRuntimeError("a key stands twice in VALUES")
        new = self.spark.createDataFrame(rows, ", ".join(f"`{c}` {_python_type(types[c])}" for c in s.columns))
        new = new.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) for c in s.columns))
        held = table.rows.select(*(f"`{k}`" for k in table.keys)) if table.keys else table.rows.select(F.lit(1))
        if not (held.join(F.broadcast(new), list(table.keys), "left_semi") if table.keys else held).isEmpty():
            raise errors.QueryRuntimeError("a row with this key is there")
        full = new.select(*(F.col(f"`{c}`") if c in s.columns else F.lit(None).cast(t).alias(c) for c, t in table.columns))
        self._write(s.table, table.rows.unionByName(full))
        return Result(list(s.columns), new)

    # UPDATE and DELETE

    def _hit(self, name: str, alias: str, where: object, more: list, binder: Binder, ctes: dict, lowering: Lowering):
        """The table's rows under internal names with a column that says which ones the WHERE meets, and subqueries' columns."""
        leaf = binder.table_leaf(name, alias)
        frame = Frame([leaf], set(), None)
        conditions = conjuncts(where)
        for e in conditions:
            if binder.type(e, frame, ctes) not in ("boolean", scalar.NULL):
                raise errors.QueryTypeError("a condition isn't boolean")
        for e in more:
            binder.type(e, frame, ctes)
        df = lowering.leaf(leaf, None)
        df, known = lowering.attach(df, conditions + more)
        hit = fresh("hit")
        met = F.lit(True)
        for e in conditions:
            met = met & F.coalesce(lowering.column(e, known).cast("boolean"), F.lit(False))
        return leaf, df.withColumn(hit, met), F.col(hit), known

    def _update(self, s: ast.Update, binder: Binder, ctes: dict, lowering: Lowering) -> Result:
        table = self._table(s.table)
        types, targets = table.types(), [c for c, _ in s.sets]
        for c in targets:
            if c not in types:
                raise errors.RequiredColumnDNE(c)
        if len(set(targets)) < len(targets) or set(targets) & set(table.keys):
            raise errors.InvalidUpdate(s.table)
        leaf, df, hit, known = self._hit(s.table, s.alias, s.where, [e for _, e in s.sets], binder, ctes, lowering)
        values = {}
        for c, e in s.sets:
            if not _fits(e.type, types[c]):
                raise errors.QueryTypeError(f"{c} is of type {types[c]}, its new value of type {e.type}")
            values[c] = lowering.column(e, known).cast(types[c])
        new = df.select(*(F.when(hit, values[c.name]).otherwise(F.col(c.internal)).alias(c.name) if c.name in values else F.col(c.internal).alias(c.name) for c in leaf.columns))
        shown = [*table.keys, *targets]
        by_name = {c.name: F.col(c.internal) for c in leaf.columns}
        touched = df.where(hit).select(*(values.get(c, by_name[c]).alias(fresh("o")) for c in shown))
        self._write(s.table, new)
        return Result(shown, touched)

    def _delete(self, s: ast.Delete, binder: Binder, ctes: dict, lowering: Lowering) -> Result:
        self._table(s.table)
        leaf, df, hit, _ = self._hit(s.table, s.alias, s.where, [], binder, ctes, lowering)
        self._write(s.table, df.where(~hit).select(*(F.col(c.internal).alias(c.name) for c in leaf.columns)))
        return self.engine._nothing()


def _named(q: object) -> Iterator[ast.Query]:
    """The queries that a statement's WITH lists name, outermost first."""
    while isinstance(q, ast.Query):
        for _, inner in q.ctes:
            yield inner
            yield from _named(inner)
        q = q.body


def _changes(q: object) -> bool:
    while isinstance(q, ast.Query):
        q = q.body
    return isinstance(q, (ast.Insert, ast.Update, ast.Delete))


def _fits(given: str, wanted: str) -> bool:
    return given == scalar.NULL or given == wanted or scalar.is_number(given) and scalar.is_number(wanted)


def _python_type(t: str) -> str:
    return "bigint" if scalar.is_whole(t) else "double" if scalar.is_number(t) else t


def _constant(e: object) -> object:
    """The value of an expression of literals."""
    if isinstance(e, ast.Literal):
        return e.value
    if isinstance(e, ast.Unary) and e.op in ("+", "-"):
        v = _constant(e.arg)
        scalar.unary_type(e.op, scalar.literal_type(v))
        return v if v is None or e.op == "+" else -v
    raise errors.QueryTypeError("VALUES takes constants")
