"""Correlated aggregates by one inequality: against brute force, and at a size at which pairs of rows and bindings take too long."""

import operator
import random
import threading

import pytest

from marlstone import errors
from marlstone.engine import Engine

N = 60_000
OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def some(n, seed):
    r = random.Random(seed)
    maybe = lambda v: None if r.random() < 0.1 else v
    return [(i, maybe(r.choice([1, 1, 1, 2, 3])), maybe(r.randint(-30, 30)), maybe(r.choice([0.0, -0.0, float("nan"), float("inf"), r.randint(-9, 9) / 4])), maybe(r.choice("abcé") + str(r.randint(0, 9)))) for i in range(n)]


ROWS, BINDINGS = some(500, 1), some(60, 2)


@pytest.fixture(scope="module")
def engine(spark):
    out = Engine(spark)
    for name, rows in (("a", ROWS), ("b", BINDINGS), ("none", [])):
        df = spark.createDataFrame(rows, ", ".join(f"{name}_{c}" for c in ("k bigint", "g int", "v int", "d double", "s string")))
        out.catalog.register(name, lambda df=df: df, (f"{name}_k",))
    many = spark.range(N, numPartitions=4).selectExpr("id AS m_k", "1 AS m_g")
    out.catalog.register("m", lambda: many, ("m_k",))
    bounds = spark.range(N, numPartitions=4).selectExpr("id AS o_k", "1 AS o_g")
    out.catalog.register("o", lambda: bounds, ("o_k",))
    return out


def holds(op, x, y):
    """As Spark compares: NaN equals itself and is above all numbers."""
    if x is None or y is None:
        return False
    key = lambda v: (v != v, 0 if v != v else v)
    return OPS[op](key(x), key(y))


@pytest.mark.parametrize("op,column", [("<", "v"), ("<=", "d"), (">", "s"), (">=", "d")])
def test_against_brute_force(engine, op, column):
    at = {"v": 2, "d": 3, "s": 4}[column]
    text = f"SELECT b_k, (SELECT COUNT(a_d) FROM a WHERE a_g = b_g AND a_{column} {op} b_{column}) AS n, (SELECT SUM(a_v) FROM a WHERE b_{column} {op} a_{column} AND a_k > 99) AS s, (SELECT AVG(a_v) FROM a WHERE a_g <=> b_g AND a_{column} {op} b_{column}) AS m FROM b"
    expected = []
    for b in BINDINGS:
        n = sum(a[3] is not None for a in ROWS if a[1] is not None and a[1] == b[1] and holds(op, a[at], b[at]))
        s = [a[2] for a in ROWS if a[0] > 99 and holds(op, b[at], a[at]) and a[2] is not None]
        m = [a[2] for a in ROWS if a[1] == b[1] and holds(op, a[at], b[at]) and a[2] is not None]
        expected.append((b[0], n, sum(s) if s else None, int(sum(m) / len(m)) if m else None))
    assert sorted(engine.execute(text).collect()) == expected


def test_no_rows_and_no_bindings(engine):
    text = "SELECT b_k, (SELECT COUNT(none_v) FROM none WHERE none_v < b_v) AS n, (SELECT SUM(none_v) FROM none WHERE none_g = b_g AND none_v > b_v) AS s FROM b"
    assert sorted(engine.execute(text).collect()) == [(b[0], 0, None) for b in BINDINGS]
    assert engine.execute("SELECT none_k, (SELECT COUNT(*) FROM a WHERE a_v < none_v) AS n FROM none").collect() == []


def test_what_can_fail_is_only_computed_where_both_sides_meet(engine):
    # zeros are in both tables, and no group 51 to 53
    text = "SELECT b_k, (SELECT COUNT(*) FROM a WHERE a_g = b_g + {} AND a_k < 100 / b_v) AS n FROM b"
    assert {r[1] for r in engine.execute(text.format(50)).collect()} == {0}
    with pytest.raises(errors.QueryEvalError):
        engine.execute(text.format(0)).collect()


def within(engine, text, seconds=90):
    """The rows of a request, which is cancelled when it takes longer."""
    timer = threading.Timer(seconds, engine.cancel, [text])
    timer.start()
    try:
        return sorted(engine.execute(text, request=text).collect(), key=lambda r: (r[0] is None, r))
    finally:
        timer.cancel()


def test_one_large_group(engine):
    got = within(engine, "SELECT o_k, (SELECT COUNT(*) FROM m WHERE m_g = o_g AND m_k < o_k) AS n FROM o")
    assert got == [(i, i) for i in range(N)]


def test_inequality_alone(engine):
    got = within(engine, "SELECT o_k, (SELECT SUM(m_k) FROM m WHERE m_k > o_k) AS n FROM o")
    assert got == [(i, N * (N - 1) // 2 - i * (i + 1) // 2 if i < N - 1 else None) for i in range(N)]


@pytest.mark.parametrize("kind", ["LEFT", "FULL"])
def test_on_of_outer_joins(engine, kind):
    """As join_on_subquery_left_both and join_on_subquery_full_both ask; by pairs it takes minutes."""
    got = within(engine, f"SELECT A.x, o_k FROM (SELECT m_g AS x FROM m WHERE m_k = 7) AS A {kind} JOIN o ON o_g = A.x AND (SELECT COUNT(m_k) FROM m WHERE m_g = A.x AND m_k < o_k * 10) > 1000")
    assert got == [(1, i) for i in range(101, N)] + ([(None, i) for i in range(101)] if kind == "FULL" else [])


def test_spark_compiles_every_stage(engine, spark):
    """A condition on the search's outcome, moved before it, becomes a method too long to compile."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = engine.execute("SELECT A.x, o_k FROM (SELECT m_g AS x FROM m WHERE m_k = 7) AS A FULL JOIN o ON o_g = A.x AND (SELECT COUNT(m_k) FROM m WHERE m_g = A.x AND m_k < o_k * 10) > 1000").collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert len(got) == N
