"""Requests over three small tables with exact headers and bags, requests that must fail, and what failing ones leave behind."""

import threading
import time

import pytest

from marlstone import errors
from marlstone.engine import Engine

#: A harbour: berths, the ships that call at it, and cargo by ship and hold.
SETUP = [
    "CREATE TABLE berth (code VARCHAR PRIMARY KEY, depth INT, covered BOOLEAN)",
    "CREATE TABLE ship (imo INT PRIMARY KEY, flag VARCHAR, draught INT, berth VARCHAR)",
    "CREATE TABLE cargo (imo INT, hold INT, goods STRING, tons INT, PRIMARY KEY (imo, hold))",
    "INSERT INTO berth (code, depth, covered) VALUES ('north', 14, FALSE), ('south', 9, TRUE), ('pier', NULL, NULL)",
    "INSERT INTO ship (imo, flag, draught, berth) VALUES (901, 'NO', 8, 'south'), (902, 'PA', 13, 'north'), (903, 'NO', 11, NULL), (904, NULL, 6, 'south')",
    "INSERT INTO cargo (imo, hold, goods, tons) VALUES (901, 1, 'timber', 400), (901, 2, 'paper', 150), (902, 1, 'ore', 900), (904, 3, 'paper', NULL)",
]


@pytest.fixture(scope="module")
def base(spark):
    engine = Engine(spark)
    for s in SETUP:
        engine.execute(s)
    return engine


@pytest.fixture
def engine(spark, base):
    """The tables afresh; versions never change, so they are shared."""
    out = Engine(spark)
    out.catalog.tables = base.catalog.tables
    return out


def bag(rows):
    return sorted(rows, key=repr)


GOOD = [
    ("SELECT * FROM cargo WHERE tons > 300", ["hold", "imo", "goods", "tons"], [(1, 901, "timber", 400), (1, 902, "ore", 900)]),
    ("SELECT draught * 2 - 1 AS x, draught, -draught FROM ship WHERE flag = 'PA'", ["x", "draught", None], [(25, 13, -13)]),
    ("SELECT *, depth + 1, B.code FROM berth AS B WHERE covered", ["code", "covered", "depth", None, "code"], [("south", True, 9, 10, "south")]),
    ("SELECT * FROM berth AS B JOIN (SELECT flag, berth FROM ship WHERE draught < 7) AS S ON S.berth = B.code", ["code", "covered", "depth", "flag", "berth"], [("south", True, 9, None, "south")]),
    ("SELECT code FROM berth WHERE depth IS NULL", ["code"], [("pier",)]),
    ("SELECT code FROM berth WHERE NOT covered OR depth < 10", ["code"], [("north",), ("south",)]),
    ("SELECT imo FROM ship WHERE flag >= 'O' AND draught % 2 = 1", ["imo"], [(902,)]),
    ("SELECT (7 - 2) * 3 / 4 % 3, -7 / 2, 'a' || 'b', NULL <=> NULL, 2 <=> NULL, 1 = NULL FROM berth WHERE depth = 9", [None] * 6, [(0, -3, "ab", True, False, None)]),
    ("SELECT FALSE AND NULL, NULL OR TRUE, NULL AND TRUE FROM berth WHERE depth = 9", [None] * 3, [(False, True, None)]),
    ("SELECT SUM(tons), COUNT(tons), COUNT(*), AVG(tons) FROM cargo", [None] * 4, [(1450, 3, 4, 483)]),
    ("SELECT COUNT(DISTINCT goods) AS kinds, SUM(DISTINCT hold) AS h FROM cargo", ["kinds", "h"], [(3, 6)]),
    ("SELECT SUM(tons), COUNT(tons), AVG(tons) FROM cargo WHERE hold > 9", [None] * 3, [(None, 0, None)]),
    ("SELECT DISTINCT flag FROM ship", ["flag"], [("NO",), ("PA",), (None,)]),
    ("SELECT S.imo, C.goods FROM ship AS S LEFT JOIN cargo AS C ON C.imo = S.imo AND C.hold < 3", ["imo", "goods"], [(901, "paper"), (901, "timber"), (902, "ore"), (903, None), (904, None)]),
    ("SELECT imo, code FROM ship RIGHT JOIN berth ON berth = code AND draught < 8", ["imo", "code"], [(904, "south"), (None, "north"), (None, "pier")]),
    ("SELECT imo, code FROM ship FULL JOIN berth ON draught > depth", ["imo", "code"], [(902, "south"), (903, "south"), (901, None), (904, None), (None, "north"), (None, "pier")]),
    ("SELECT A.imo, B.imo FROM ship AS A, ship AS B WHERE A.flag = B.flag AND A.imo < B.imo", ["imo", "imo"], [(901, 903)]),
    ("SELECT COUNT(*) FROM berth CROSS JOIN ship", [None], [(12,)]),
    ("SELECT S.imo, T.total FROM ship AS S JOIN LATERAL (SELECT SUM(tons) AS total FROM cargo AS C WHERE C.imo = S.imo) AS T", ["imo", "total"], [(901, 550), (902, 900), (903, None), (904, None)]),
    ("SELECT S.imo, T.goods FROM ship AS S LEFT JOIN LATERAL (SELECT goods FROM cargo AS C WHERE C.imo = S.imo AND C.tons > S.draught * 40) AS T", ["imo", "goods"], [(901, "timber"), (902, "ore"), (903, None), (904, None)]),
    ("SELECT D.n FROM (SELECT COUNT(*) AS n FROM cargo) AS D JOIN (berth AS X JOIN berth AS Y ON X.depth > Y.depth)", ["n"], [(4,)]),
    ("SELECT B.code, S.imo FROM berth AS B LEFT JOIN ship AS S ON (SELECT COUNT(*) FROM cargo AS C WHERE C.imo = S.imo AND C.tons > B.depth * 50) = 1", ["code", "imo"], [("north", 902), ("south", 902), ("pier", None)]),
    ("SELECT B.code, S.imo FROM berth AS B FULL JOIN ship AS S ON B.code = S.berth AND (SELECT COUNT(*) FROM cargo AS C WHERE C.imo = S.imo) = 2", ["code", "imo"], [("south", 901), ("north", None), ("pier", None), (None, 902), (None, 903), (None, 904)]),
    ("SELECT imo FROM ship AS S WHERE (SELECT COUNT(*) FROM cargo AS C WHERE C.imo = S.imo AND (SELECT depth FROM berth AS B WHERE B.code = S.berth) < C.tons) > 1", ["imo"], [(901,)]),
    ("SELECT code, (SELECT SUM(draught) FROM ship AS S WHERE S.berth = B.code) AS d FROM berth AS B", ["code", "d"], [("north", 13), ("south", 14), ("pier", None)]),
    ("WITH deep AS (SELECT code, depth AS d FROM berth WHERE depth > 8), two AS (SELECT X.code FROM deep AS X JOIN deep AS Y ON X.d < Y.d) SELECT * FROM two", ["code"], [("south",)]),
    ("WITH ship AS (SELECT code AS imo FROM berth) SELECT imo FROM ship WHERE imo <> 'pier'", ["imo"], [("north",), ("south",)]),
]


@pytest.mark.parametrize("text,header,rows", GOOD)
def test_select(engine, text, header, rows):
    result = engine.execute(text)
    assert result.header == header
    assert bag(result.collect()) == bag(rows)


BAD = [
    ("SELECT imo FROM ship RIGHT JOIN LATERAL (SELECT code FROM berth) AS L", errors.InvalidLateralJoin),
    ("SELECT imo FROM ship FULL JOIN LATERAL (SELECT code FROM berth) AS L", errors.InvalidLateralJoin),
    ("SELECT imo FROM ship CROSS JOIN LATERAL (SELECT code FROM berth) AS L", errors.InvalidLateralJoin),
    ("SELECT code FROM LATERAL (SELECT code FROM berth) AS L", errors.InvalidLateralJoin),
    ("SELECT code FROM (SELECT code FROM berth)", errors.NonAliasedDerivedTable),
    ("SELECT 1 FROM berth JOIN ship AS berth", errors.NonUniqueJoinLeafName),
    ("SELECT quay.code FROM berth", errors.NonExistentTableQualification),
    ("SELECT berth.flag FROM berth", errors.InvalidColumnRef),
    ("SELECT quay.* FROM berth", errors.InvalidWildcardQualification),
    ("SELECT flag FROM berth", errors.NonExistentColumn),
    ("SELECT imo FROM ship JOIN cargo ON tons = 1", errors.AmbiguousColumnRef),
    ("SELECT a FROM quay", errors.TablesDNE),
    ("UPDATE ship SET imo = 1", errors.InvalidUpdate),
    ("UPDATE ship SET flag = 'X', flag = 'Y'", errors.InvalidUpdate),
    ("UPDATE ship SET mast = 1", errors.RequiredColumnDNE),
    ("UPDATE ship SET draught = 'deep'", errors.QueryTypeError),
    ("INSERT INTO cargo (imo, goods) VALUES (1, 'x')", errors.InvalidInsert),
    ("INSERT INTO cargo (imo, hold, goods) VALUES (1, 2)", errors.InvalidInsert),
    ("INSERT INTO berth (code, mast) VALUES ('x', 2)", errors.RequiredColumnDNE),
    ("INSERT INTO berth (code) VALUES (NULL)", errors.QueryTypeError),
    ("INSERT INTO berth (code, depth) VALUES ('x', TRUE)", errors.QueryTypeError),
    ("INSERT INTO berth (code, depth) VALUES ('x', (SELECT COUNT(*) FROM ship))", errors.QueryTypeError),
    ("INSERT INTO berth (code) VALUES ('pier')", errors.QueryRuntimeError),
    ("INSERT INTO berth (code) VALUES ('x'), ('x')", errors.QueryRuntimeError),
    ("SELECT imo FROM ship WHERE (UPDATE ship SET flag = 'X') = 1", errors.InvalidUpdate),
    ("SELECT imo FROM (DELETE FROM ship) AS D", errors.InvalidDelete),
    ("SELECT imo FROM (INSERT INTO berth (code) VALUES ('x')) AS D", errors.InvalidInsert),
    ("SELECT COUNT(imo), flag FROM ship", errors.InvalidSelectClause),
    ("SELECT flag + 1 FROM ship", errors.QueryTypeError),
    ("SELECT imo FROM ship WHERE draught", errors.QueryTypeError),
    ("SELECT imo FROM ship WHERE flag = 3", errors.QueryTypeError),
    ("SELECT SUM(flag) FROM ship", errors.QueryTypeError),
    ("SELECT (SELECT imo, flag FROM ship) FROM berth", errors.QueryRuntimeError),
    ("SELECT flag FROM ship GROUP BY flag", errors.ParseError),
    ("SELECT flag FROM ship ORDER BY flag", errors.ParseError),
    ("SELECT flag FROM ship LIMIT 1", errors.ParseError),
    ("SELECT MIN(draught) FROM ship", errors.ParseError),
    ("SELECT code FROM berth UNION SELECT flag FROM ship", errors.ParseError),
    ("SELECT SUM(draught) OVER () FROM ship", errors.ParseError),
    ("CREATE TABLE ship (a INT PRIMARY KEY)", errors.InvalidDDL),
    ("CREATE TABLE quay (a REAL PRIMARY KEY)", errors.ParseError),
    ("DROP TABLE quay", errors.InvalidDDL),
    ("ALTER TABLE ship DROP COLUMN imo", errors.InvalidDDL),
    ("ALTER TABLE ship ADD COLUMN flag INT", errors.InvalidDDL),
    ("DROP TABLE ship; SELECT code FROM berth", errors.ParseError),
]


@pytest.mark.parametrize("text,error", BAD)
def test_fails(engine, text, error):
    with pytest.raises(error):
        engine.execute(text)


FAULTS = [
    ("draught / (draught - 8)", errors.QueryEvalError),
    ("draught % (draught - 8)", errors.QueryEvalError),
    ("draught * 2147483647", errors.QueryEvalError),
    ("(SELECT depth FROM berth)", errors.QueryRuntimeError),
    ("(SELECT depth FROM berth WHERE code = 'none')", errors.QueryRuntimeError),
    ("(SELECT SUM(tons * 2000000) FROM cargo WHERE tons > 500) + (SELECT SUM(tons * 2000000) FROM cargo AS D WHERE tons > 500)", errors.QueryEvalError),
    ("(SELECT SUM(tons * 2000000) FROM cargo WHERE tons > 300)", errors.QueryRuntimeError),
]


@pytest.mark.parametrize("expression,error", FAULTS)
@pytest.mark.parametrize("rooted", [False, True])
def test_a_fault_of_the_data_changes_nothing(spark, base, tmp_path, expression, error, rooted):
    engine = Engine(spark, root=f"file://{tmp_path}/t" if rooted else None)
    if rooted:
        engine.catalog.install(engine.catalog.prepare(dict(base.catalog.tables)))
    else:
        engine.catalog.tables = base.catalog.tables
    with pytest.raises(error):
        engine.execute(f"SELECT {expression} FROM ship").collect()
    for text in (f"UPDATE ship SET draught = {expression}", f"UPDATE berth SET depth = 1; UPDATE ship SET draught = {expression}; SELECT code FROM berth"):
        with pytest.raises(error):
            engine.execute(text)
        assert engine.execute("SELECT SUM(draught), SUM(depth) FROM ship, berth WHERE code <> 'pier'").collect() == [(76, 92)]
    # the next change goes through, for another reader too
    engine.execute("UPDATE ship SET draught = draught + 1")
    for e in [engine, *([Engine(spark, root=f"file://{tmp_path}/t")] if rooted else [])]:
        assert e.execute("SELECT SUM(draught) FROM ship").collect() == [(42,)]


def test_lenient_subqueries_and_null_and(spark, base):
    engine = Engine(spark, strict=False, null_and=True)
    engine.catalog.tables = base.catalog.tables
    assert engine.execute("SELECT (SELECT depth FROM berth WHERE code = 'none') FROM ship WHERE imo = 901").collect() == [(None,)]
    assert engine.execute("SELECT FALSE AND covered, FALSE AND TRUE FROM berth WHERE code = 'pier'").collect() == [(None, False)]
    without = "SELECT code FROM berth WHERE NOT (FALSE AND covered)"
    assert bag(engine.execute(without).collect()) == [("north",), ("south",)] and len(base.execute(without).collect()) == 3


def test_widths(engine, spark):
    whole = lambda text, e: [t for _, t in e.execute(text).rows.dtypes]
    assert whole("SELECT COUNT(*), SUM(tons), AVG(tons) FROM cargo", engine) == ["int"] * 3
    assert whole("SELECT COUNT(*), SUM(n) FROM (SELECT tons AS n FROM cargo) AS D", engine) == ["int"] * 2
    assert whole("SELECT COUNT(*), SUM(n_regionkey) FROM nation", Engine.over(spark, "/root/testdata/sf0.001")) == ["bigint"] * 2


def test_files_are_opened_when_named(spark):
    engine = Engine.over(spark, "/nowhere")
    engine.execute("CREATE TABLE t (k INT PRIMARY KEY)")
    engine.execute("INSERT INTO t (k) VALUES (1)")
    assert engine.execute("SELECT k FROM t").collect() == [(1,)]
    with pytest.raises(Exception, match="nowhere"):
        engine.execute("SELECT n_name FROM nation")


def test_changes_and_results(engine):
    r = engine.execute("UPDATE ship SET draught = draught - 1, flag = 'DK' WHERE berth = 'south'")
    assert (r.header, bag(r.collect())) == (["imo", "draught", "flag"], [(901, 7, "DK"), (904, 5, "DK")])
    r = engine.execute("INSERT INTO berth (depth, code) VALUES (-2, 'slip')")
    assert (r.header, r.collect()) == (["depth", "code"], [(-2, "slip")])
    r = engine.execute("DELETE FROM berth WHERE covered IS NULL AND depth IS NULL")
    assert (r.header, r.collect()) == ([], [])
    assert bag(engine.execute("SELECT code, depth FROM berth").collect()) == [("north", 14), ("slip", -2), ("south", 9)]


def test_transaction(engine):
    with pytest.raises(errors.QueryRuntimeError):
        engine.execute("DELETE FROM cargo; INSERT INTO berth (code) VALUES ('north')")
    assert engine.execute("SELECT COUNT(*) FROM cargo").collect() == [(4,)]
    r = engine.execute("DELETE FROM berth WHERE code = 'pier'; INSERT INTO berth (code) VALUES ('pier'); UPDATE berth SET depth = 3 WHERE depth IS NULL; SELECT code, depth FROM berth WHERE (SELECT COUNT(*) FROM berth AS C) = 3")
    assert bag(r.collect()) == [("north", 14), ("pier", 3), ("south", 9)]


def test_changes_that_with_names(engine):
    r = engine.execute("WITH old AS (SELECT imo, tons AS before FROM cargo), up AS (UPDATE cargo SET tons = tons + 1 WHERE hold = 1) SELECT up.imo, up.tons, before FROM up JOIN old ON old.imo = up.imo AND before > 200")
    assert (r.header, bag(r.collect())) == (["imo", "tons", "before"], [(901, 401, 400), (902, 901, 900)])
    assert engine.execute("SELECT SUM(tons) FROM cargo").collect() == [(1452,)]
    r = engine.execute("WITH gone AS (DELETE FROM cargo WHERE imo = 901) UPDATE ship SET draught = (SELECT COUNT(*) FROM cargo AS C WHERE C.imo = ship.imo)")
    assert bag(r.collect()) == [(901, 0), (902, 1), (903, 0), (904, 1)]


def test_versions(engine):
    before = engine.catalog.number
    engine.execute("DELETE FROM cargo WHERE hold = 1")
    engine.execute("DELETE FROM cargo WHERE hold = 2")
    count = "SELECT COUNT(*) FROM cargo"
    assert [engine.execute(count, at=before + k).collect() for k in range(3)] == [[(4,)], [(2,)], [(1,)]]
    with pytest.raises(errors.QueryRuntimeError):
        engine.execute("DELETE FROM cargo", at=before)
    with pytest.raises(errors.QueryRuntimeError):
        engine.execute(count, at=before + 9)


def test_versions_outlive_the_engine(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    engine = Engine(spark, root=root)
    for s in ("CREATE TABLE `odd name` (k INT PRIMARY KEY, v INT)", 'INSERT INTO `odd name` (k, v) VALUES (1, 2), (2, 3)', 'UPDATE `odd name` SET v = v + 1 WHERE k = 2'):
        engine.execute(s)
    again = Engine(spark, root=root)
    assert bag(again.execute('SELECT * FROM `odd name`').collect()) == [(1, 2), (2, 4)]
    assert bag(again.execute('SELECT * FROM `odd name`', at=2).collect()) == [(1, 2), (2, 3)]
    assert again.execute('SELECT * FROM `odd name`', at=1).collect() == []
    # another writer got there first
    again.execute('DELETE FROM `odd name`')
    with pytest.raises(errors.QueryRuntimeError, match="another writer"):
        engine.execute('DELETE FROM `odd name` WHERE k = 1')


def test_a_long_series_of_changes_keeps_plans_short(engine):
    for _ in range(12):
        engine.execute("UPDATE ship SET draught = draught + 1")
    plan = engine.catalog.tables["ship"].rows._jdf.queryExecution().optimizedPlan().toString()
    assert engine.execute("SELECT SUM(draught) FROM ship").collect() == [(86,)] and plan.count("\n") < 4


def test_dropped_column_stays_lost(engine):
    for s in ("ALTER TABLE cargo DROP COLUMN tons", "ALTER TABLE cargo ADD COLUMN tons INT"):
        engine.execute(s)
    assert engine.execute("SELECT SUM(tons), COUNT(imo) FROM cargo").collect() == [(None, 4)]


def test_script_metadata_and_counted_rows(engine):
    results = list(engine.run_script("SELECT code FROM berth WHERE depth = 9\n-- Separate\nSELECT COUNT(code) FROM berth;"))
    assert [r.collect() for r in results] == [[("south",)], [(3,)]]
    assert [tuple(r) for r in engine.describe("cargo").collect()] == [("cargo", "hold", "int", True), ("cargo", "imo", "int", True), ("cargo", "goods", "string", False), ("cargo", "tons", "int", False)]
    shown = engine.execute("SELECT flag, 1 FROM ship").counted()
    assert shown.columns == ["count", "flag", "<nameless>"] and bag(map(tuple, shown.collect())) == [(1, "PA", 1), (1, None, 1), (2, "NO", 1)]


def slow(engine, spark):
    """A table that takes its time."""
    n = spark.range(200_000, numPartitions=64).selectExpr("CAST(id AS INT) AS k", "CAST(id % 7 AS INT) AS v")
    engine.catalog.register("big", lambda: n, ("k",))
    return "(SELECT COUNT(*) FROM big AS X JOIN big AS Y ON X.k * Y.k % 1000003 < X.v - 5)"


@pytest.mark.parametrize("text", ["SELECT {} FROM ship", "UPDATE ship SET draught = 1 WHERE {} = 0"])
def test_cancel(engine, spark, text):
    text, seen = text.format(slow(engine, spark)), []

    def work():
        try:
            engine.execute(text, request="r1")
        except errors.Cancelled as e:
            seen.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(600):
        if engine._running and spark.sparkContext.statusTracker().getJobIdsForGroup("r1"):
            break
        time.sleep(0.1)
    assert engine.cancel("r1")
    thread.join(60)
    assert len(seen) == 1 and not engine.cancel("r1") and not engine._running
    # the name is free again, and nothing of the cancelled request clings to later ones
    assert engine.execute("UPDATE ship SET draught = draught + 1; SELECT SUM(draught) FROM ship", request="r1").collect() == [(42,)]
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_cancel_of_nothing(engine):
    assert not engine.cancel("r2")
    assert engine.execute("DELETE FROM berth; SELECT COUNT(*) FROM berth", request="r2").collect() == [(0,)]


def test_stream_of_requests(spark, base, tmp_path):
    from marlstone.streaming.requests import execute_stream

    root, schema, failed = f"file://{tmp_path}/root", "n int, request string", []
    engine = Engine(spark, root=root)
    engine.catalog.install(engine.catalog.prepare(dict(base.catalog.tables)))
    texts = ["INSERT INTO berth (code, depth) VALUES ('new', 1)", "UPDATE berth SET depth = depth + 1 WHERE code = 'new'", "SELECT nothing FROM berth", "UPDATE berth SET depth = depth * 5 WHERE code = 'new'"]
    spark.createDataFrame(list(enumerate(texts)), schema).coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(engine):
        query = execute_stream(engine, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", failed=lambda t, e: failed.append((t, type(e))))
        query.processAllAvailable()
        query.stop()
        return engine.execute("SELECT depth FROM berth WHERE code = 'new'").collect()

    assert run(engine) == [(10,)] and failed == [(texts[2], errors.NonExistentColumn)]
    # a crash before Spark noted the batch: it comes again, to an engine that reads the tables from their root
    for part in ("commits",):
        for file in (tmp_path / "state" / part).iterdir():
            file.unlink()
    assert run(Engine(spark, root=root)) == [(10,)] and len(failed) == 1
