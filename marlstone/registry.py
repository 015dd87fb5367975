"""Registered queries of the dialect over the driver's tables, with DuckDB's SQL for each.

Where the two texts differ, it is by the dialect's rules: whole numbers divide towards zero, AVG of
whole numbers too, and transactions are written for DuckDB as the SELECT of their outcome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.engine import Engine
from marlstone.errors import QueryEvalError

#: name -> (request, DuckDB's SQL; None: the same text)
SELECTS: dict[str, tuple[str, str | None]] = {
    "scan_project": ("SELECT n_name, n_regionkey AS region FROM nation", None),
    "scan_star": ("SELECT * FROM region", None),
    "star_mixed": ("SELECT n_name AS again, N.*, n_nationkey + 1 AS next FROM nation AS N", None),
    "qualified_star": ("SELECT R.*, n_name FROM nation AS N JOIN region AS R ON N.n_regionkey = R.r_regionkey", None),
    "alias_arith": ("SELECT p_partkey, p_size * 2 + 1 - p_size AS x, -(p_size) AS neg FROM part", None),
    "const_project": ("SELECT 1 AS one, 'x' AS s, TRUE AS t, r_regionkey FROM region", None),
    "filter_cmp": ("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <> 20 AND p_size < 40", None),
    "filter_bool3vl": ("SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 2 WHERE NOT (r_regionkey = 3) OR n_nationkey < 3", None),
    "filter_null": ("SELECT n_nationkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 2 WHERE r_name IS NULL", None),
    "filter_not_null": ("SELECT n_nationkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 2 WHERE r_name IS NOT NULL", None),
    "filter_nullsafe": (
        "SELECT n_nationkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 2 WHERE r_regionkey <=> NULL OR r_regionkey <=> 3",
        "SELECT n_nationkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 2 WHERE r_regionkey IS NOT DISTINCT FROM NULL OR r_regionkey IS NOT DISTINCT FROM 3",
    ),
    "bool_project": ("SELECT p_partkey, p_size > 20 AS big, p_size > 20 AND p_size < 30 AS mid, NOT p_size = 7 AS other, (p_size > 3) OR NULL AS maybe FROM part", None),
    "int_div_mod": ("SELECT p_partkey, p_size / 7 AS d, (0 - p_size) / 7 AS nd, p_size % 7 AS m, (0 - p_size) % 7 AS nm FROM part", "SELECT p_partkey, p_size // 7 AS d, (0 - p_size) // 7 AS nd, p_size % 7 AS m, (0 - p_size) % 7 AS nm FROM part"),
    "unary_ops": ("SELECT n_nationkey, -n_nationkey AS a, +n_nationkey AS b, NOT (n_nationkey > 3) AS c FROM nation", None),
    "str_concat": ("SELECT n_name || '-' || r_name AS both, n_name || NULL AS none FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT n_name || '-' || r_name AS both, CAST(NULL AS VARCHAR) AS none FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "str_compare": ("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name < 'Customer#000000100'", None),
    "agg_count": ("SELECT COUNT(p_size) AS n, COUNT(p_brand) AS brands FROM part WHERE p_size > 10", None),
    "agg_count_null": ("SELECT COUNT(r_name) AS n, COUNT(n_name) AS all_rows FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 2", None),
    "agg_sum": ("SELECT SUM(l_linenumber) AS s, SUM(l_linenumber * 2 + 1) AS t FROM lineitem", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS s, CAST(SUM(l_linenumber * 2 + 1) AS BIGINT) AS t FROM lineitem"),
    "agg_avg_int": ("SELECT AVG(p_size) AS a, AVG(0 - p_size) AS b FROM part", "SELECT CAST(SUM(p_size) AS BIGINT) // COUNT(p_size) AS a, CAST(SUM(0 - p_size) AS BIGINT) // COUNT(p_size) AS b FROM part"),
    "agg_distinct": ("SELECT COUNT(DISTINCT p_size) AS n, SUM(DISTINCT p_size) AS s, AVG(DISTINCT p_size) AS a FROM part", "SELECT COUNT(DISTINCT p_size) AS n, CAST(SUM(DISTINCT p_size) AS BIGINT) AS s, CAST(SUM(DISTINCT p_size) AS BIGINT) // COUNT(DISTINCT p_size) AS a FROM part"),
    "agg_empty": ("SELECT COUNT(p_size) AS n, SUM(p_size) AS s, AVG(p_size) AS a FROM part WHERE p_size > 1000", "SELECT COUNT(p_size) AS n, CAST(SUM(p_size) AS BIGINT) AS s, CAST(NULL AS BIGINT) AS a FROM part WHERE p_size > 1000"),
    "agg_expr_arg": (
        "SELECT SUM(n_regionkey * (SELECT COUNT(r_regionkey) FROM region)) AS s FROM nation",
        "SELECT CAST(SUM(n_regionkey * (SELECT COUNT(r_regionkey) FROM region)) AS BIGINT) AS s FROM nation",
    ),
    "agg_in_expression": ("SELECT r_regionkey, (SELECT COUNT(n_nationkey) FROM nation) * 2 AS n FROM region", None),
    "select_distinct": ("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", None),
    "join_inner_equi": ("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey", None),
    "join_inner_theta": ("SELECT A.n_nationkey AS a, B.n_nationkey AS b FROM nation AS A JOIN nation AS B ON A.n_nationkey < B.n_nationkey AND A.n_regionkey = B.n_regionkey", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'", None),
    "join_right": ("SELECT s_suppkey, n_name FROM supplier RIGHT OUTER JOIN nation ON s_nationkey = n_nationkey AND s_suppkey < 20", None),
    "join_full": ("SELECT s_suppkey, n_nationkey FROM supplier FULL OUTER JOIN nation ON s_nationkey = n_nationkey AND n_regionkey > 1", None),
    "join_full_theta": ("SELECT A.r_regionkey AS a, B.r_regionkey AS b FROM region AS A FULL OUTER JOIN region AS B ON A.r_regionkey > B.r_regionkey + 2", None),
    "join_cross": ("SELECT n_name, r_name FROM nation CROSS JOIN region", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_no_on": ("SELECT n_name, r_name FROM nation JOIN region", "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    "join_self": ("SELECT A.c_custkey AS a, B.c_custkey AS b FROM customer AS A JOIN customer AS B ON A.c_custkey + 1 = B.c_custkey", None),
    "join_nested_tree": ("SELECT c_custkey, n_name, r_name FROM customer JOIN (nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3) ON c_nationkey = n_nationkey", None),
    "join_multiplicity": ("SELECT A.c_mktsegment AS s FROM customer AS A JOIN nation AS N ON A.c_nationkey = N.n_regionkey", None),
    "join_derived": ("SELECT c_custkey, T.k FROM customer JOIN (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') AS T ON c_custkey = T.k", None),
    "join_lateral": ("SELECT c_custkey, L.n FROM customer JOIN LATERAL (SELECT COUNT(o_orderkey) AS n FROM orders WHERE o_custkey = c_custkey) AS L", "SELECT c_custkey, L.n FROM customer JOIN LATERAL (SELECT COUNT(o_orderkey) AS n FROM orders WHERE o_custkey = c_custkey) AS L ON TRUE"),
    "join_left_lateral": ("SELECT c_custkey, L.k FROM customer LEFT JOIN LATERAL (SELECT o_orderkey AS k FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS L ON TRUE", None),
    "join_on_subquery_inner": ("SELECT n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey AND (SELECT COUNT(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) > 55", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE (SELECT COUNT(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) > 55"),
    "join_on_subquery_left_one_side": (
        "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND (SELECT COUNT(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) > 55",
        "SELECT n_name, s_suppkey FROM (SELECT *, (SELECT COUNT(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS k FROM nation) LEFT JOIN supplier ON s_nationkey = n_nationkey AND k > 55",
    ),
    "join_on_subquery_left_both": (
        "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND (SELECT COUNT(c_custkey) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey < s_suppkey * 10) > 12",
        "SELECT n_name, s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE (SELECT COUNT(c_custkey) FROM customer WHERE c_nationkey = s_nationkey AND c_custkey < s_suppkey * 10) > 12) ON s_nationkey = n_nationkey",
    ),
    "join_on_subquery_full_both": (
        "SELECT n_name, s_suppkey FROM nation FULL JOIN supplier ON s_nationkey = n_nationkey AND (SELECT COUNT(c_custkey) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey < s_suppkey * 10) > 12",
        "SELECT n_name, s_suppkey FROM nation FULL JOIN (SELECT *, (SELECT COUNT(c_custkey) FROM customer WHERE c_nationkey = s_nationkey AND c_custkey < s_suppkey * 10) AS k FROM supplier) ON s_nationkey = n_nationkey AND k > 12",
    ),
    "sub_uncorr": ("SELECT p_partkey FROM part WHERE p_size > (SELECT AVG(p_size) FROM part)", "SELECT p_partkey FROM part WHERE p_size > (SELECT SUM(p_size) // COUNT(p_size) FROM part)"),
    "sub_corr_eq": ("SELECT O.o_orderkey FROM orders AS O WHERE O.o_totalprice > (SELECT AVG(o_totalprice) FROM orders AS P WHERE P.o_custkey = O.o_custkey)", None),
    "sub_corr_noneq": ("SELECT n_nationkey, (SELECT COUNT(r_regionkey) FROM region WHERE r_regionkey < n_regionkey) AS n FROM nation", None),
    "sub_in_projection": ("SELECT c_custkey, (SELECT COUNT(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer", None),
    "sub_one_row": ("SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region FROM nation", None),
    "sub_nested": (
        "SELECT r_name FROM region WHERE (SELECT COUNT(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey AND (SELECT COUNT(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) > 3) > 1",
        None,
    ),
    "sub_skip_level": (
        "SELECT r_regionkey, (SELECT COUNT(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey AND (SELECT COUNT(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey > r_regionkey * 20) > 1) AS n FROM region",
        None,
    ),
    "sub_with_cte": (
        "SELECT c_custkey FROM customer WHERE (WITH mine AS (SELECT o_totalprice AS t FROM orders WHERE o_custkey = c_custkey) SELECT COUNT(t) FROM mine WHERE t > 100000) > 5",
        "SELECT c_custkey FROM customer WHERE (SELECT COUNT(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) > 5",
    ),
    "sub_with_join": ("SELECT n_nationkey, (SELECT COUNT(o_orderkey) FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) AS n FROM nation", None),
    "cte_basic": ("WITH a AS (SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 3) SELECT n_name FROM a WHERE n_regionkey > 0", None),
    "cte_chain": ("WITH a AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), b AS (SELECT k, r FROM a WHERE r > 1) SELECT b.k, r_name FROM b JOIN region ON b.r = r_regionkey", None),
    "cte_twice": ("WITH a AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation) SELECT X.k AS x, Y.k AS y FROM a AS X JOIN a AS Y ON X.r = Y.r AND X.k < Y.k", None),
    "cte_nested_shadow": (
        "WITH nation AS (SELECT r_regionkey AS k FROM region) SELECT T.k FROM (WITH nation AS (SELECT k + 100 AS k FROM nation) SELECT k FROM nation) AS T JOIN nation ON T.k = nation.k + 100",
        "SELECT r_regionkey + 100 AS k FROM region",
    ),
    "star_over_join": ("SELECT * FROM nation AS N JOIN region AS R ON N.n_regionkey = R.r_regionkey", None),
    "star_over_outer_join": ("SELECT * FROM (SELECT r_regionkey AS a, r_name AS b FROM region) AS T LEFT JOIN (SELECT n_nationkey AS c, n_regionkey AS d FROM nation WHERE n_nationkey < 4) AS U ON T.a = U.d", None),
    "star_repeated": (
        "SELECT *, r_regionkey + 1, * FROM region",
        "SELECT r_regionkey AS r_regionkey_1, r_name AS r_name_2, r_regionkey + 1 AS column_3, r_regionkey AS r_regionkey_4, r_name AS r_name_5 FROM region",
    ),
    "agg_count_rows": ("SELECT COUNT(*) AS n FROM nation WHERE n_regionkey > 1", None),
    "alias_shadow": ("SELECT N.n_name FROM nation AS N WHERE (SELECT COUNT(N.r_regionkey) FROM region AS N WHERE N.r_regionkey = n_regionkey) = 1", "SELECT n_name FROM nation"),
}

_KEYED = "CREATE TABLE {t} (k INT PRIMARY KEY, name VARCHAR, r INT)"
_NATIONS = "INSERT INTO t(k, name, r) VALUES (1,'a',0),(2,'b',1),(3,'c',1),(4,'d',NULL)"
#: name -> (requests, the last of which gives the rows; DuckDB's SQL)
SCRIPTS: dict[str, tuple[list[str], str]] = {
    "txn_insert_select": ([_KEYED.format(t="t"), _NATIONS, "SELECT T.k, N.n_name FROM t AS T JOIN nation AS N ON T.k = N.n_nationkey"], "SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey BETWEEN 1 AND 4"),
    "txn_update_rw": (
        ["UPDATE nation SET n_regionkey = n_regionkey + 10 WHERE n_nationkey < 5; UPDATE nation SET n_regionkey = n_regionkey * 2 WHERE n_regionkey > 9; SELECT n_nationkey, n_regionkey FROM nation"],
        "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN (n_regionkey + 10) * 2 ELSE n_regionkey END AS n_regionkey FROM nation",
    ),
    "update_result": (["UPDATE nation SET n_name = n_name || '!' WHERE n_regionkey = 1"], "SELECT n_nationkey, n_name || '!' AS n_name FROM nation WHERE n_regionkey = 1"),
    "update_subquery": (
        ["UPDATE nation AS N SET n_regionkey = (SELECT COUNT(c_custkey) FROM customer WHERE c_nationkey = N.n_nationkey) WHERE n_nationkey > 20; SELECT n_nationkey, n_regionkey FROM nation"],
        "SELECT n_nationkey, CASE WHEN n_nationkey > 20 THEN CAST((SELECT COUNT(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS INT) ELSE n_regionkey END AS n_regionkey FROM nation",
    ),
    "change_in_with": (
        ["WITH b AS (SELECT n_nationkey AS k, n_name AS old FROM nation), a AS (UPDATE nation SET n_name = n_name || '!' WHERE n_regionkey = 1) SELECT a.n_nationkey, a.n_name, old FROM a JOIN b ON a.n_nationkey = b.k"],
        "SELECT n_nationkey, n_name || '!' AS n_name, n_name AS old FROM nation WHERE n_regionkey = 1",
    ),
    "txn_delete": (["DELETE FROM nation WHERE n_regionkey = 2; SELECT n_nationkey, n_name FROM nation"], "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2"),
    "delete_subquery": (["DELETE FROM customer WHERE (SELECT COUNT(o_orderkey) FROM orders WHERE o_custkey = c_custkey) > 9; SELECT c_custkey FROM customer"], "SELECT c_custkey FROM customer WHERE (SELECT COUNT(o_orderkey) FROM orders WHERE o_custkey = c_custkey) <= 9"),
    "txn_multi_stage": (
        ["INSERT INTO region(r_regionkey, r_name) VALUES (77, 'NEW'); UPDATE nation SET n_regionkey = 77 WHERE n_nationkey > 22; DELETE FROM region WHERE r_regionkey = 0; SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"],
        "SELECT n_name, CASE WHEN n_nationkey > 22 THEN 'NEW' WHEN r_regionkey = 0 THEN NULL ELSE r_name END AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "ddl_add_drop_col": (
        [_KEYED.format(t="t"), _NATIONS, "ALTER TABLE t ADD COLUMN price INT", "UPDATE t SET price = k * 10 WHERE k > 2", "ALTER TABLE t DROP COLUMN r", "ALTER TABLE t ADD COLUMN r INT", "SELECT * FROM t"],
        "SELECT * FROM (VALUES (1,'a',NULL,CAST(NULL AS INT)),(2,'b',NULL,NULL),(3,'c',30,NULL),(4,'d',40,NULL)) v(k, name, price, r)",
    ),
    "ddl_drop_create": ([_KEYED.format(t="t"), _NATIONS, "DROP TABLE t", _KEYED.format(t="t"), "INSERT INTO t(k) VALUES (9)", "SELECT k, name FROM t"], "SELECT 9 AS k, CAST(NULL AS VARCHAR) AS name"),
}


def _select(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine.over(spark, sf_dir).execute(text).named()


def _script(requests: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine.over(spark, sf_dir)
        for r in requests:
            result = engine.execute(r)
        return result.named()

    return run


def describe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine.over(spark, sf_dir).describe("region").select("column", "type", "is_key")


def split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.over(spark, sf_dir)
    engine.split("orders", 4)
    return engine.execute("SELECT o_orderkey FROM orders WHERE o_orderkey > 100").named()


def batch_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = "CREATE TABLE t (k INT PRIMARY KEY, v INT);\n-- Separate\nINSERT INTO t (k, v) VALUES (1, 5), (2, 7);\n-- separate\nUPDATE t SET v = v * k; SELECT k, v, r_name FROM t JOIN region ON k = r_regionkey"
    return list(Engine.over(spark, sf_dir).run_script(script))[-1].named()


def counted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine.over(spark, sf_dir).execute("SELECT n_regionkey, n_regionkey * 0 FROM nation").counted().withColumnRenamed("<nameless>", "zero")


def older_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.over(spark, sf_dir)
    engine.execute("UPDATE nation SET n_regionkey = 9 WHERE n_nationkey > 3")
    engine.execute("DELETE FROM nation WHERE n_regionkey = 9")
    return engine.execute("SELECT n_nationkey, n_regionkey FROM nation", at=1).named()


def failed_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there after a request that a row of the data made fail."""
    engine = Engine.over(spark, sf_dir)
    try:
        engine.execute("DELETE FROM region; UPDATE nation SET n_regionkey = 10 / (n_nationkey - 7)")
    except QueryEvalError:
        pass
    return engine.execute("SELECT n_nationkey, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey").named()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _select(t) for k, (t, _) in SELECTS.items()} | {k: _script(r) for k, (r, _) in SCRIPTS.items()}
    return out | {"describe_tables": describe_tables, "split_scan": split_scan, "batch_script": batch_script, "counted_rows": counted_rows, "older_version": older_version, "failed_change": failed_change}


def oracle_sql() -> dict[str, str]:
    out = {k: s or t for k, (t, s) in SELECTS.items()} | {k: s for k, (_, s) in SCRIPTS.items()}
    return out | {
        "describe_tables": "SELECT * FROM (VALUES ('r_regionkey', 'int', TRUE), ('r_name', 'string', FALSE)) v(\"column\", type, is_key)",
        "batch_script": "SELECT k, v, r_name FROM (VALUES (1, 5), (2, 14)) t(k, v) JOIN region ON k = r_regionkey",
        "counted_rows": "SELECT COUNT(*) AS count, n_regionkey, 0 AS zero FROM nation GROUP BY n_regionkey",
        "older_version": "SELECT n_nationkey, CASE WHEN n_nationkey > 3 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation",
        "failed_change": "SELECT n_nationkey, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        "split_scan": "SELECT o_orderkey FROM orders WHERE o_orderkey > 100",
    }
