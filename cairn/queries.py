"""Named queries, one or more for each operator, and the DuckDB SQL that each is held against."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.engine import Engine
from cairn.errors import EngineError

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: (text in the dialect, SQL for DuckDB; None: the same text)
TEXTS: dict[str, tuple[str, str | None]] = {
    # scan, projection, arithmetic
    "scan_star": ("SELECT * FROM nation", None),
    "scan_star_join": ("SELECT * FROM region JOIN nation ON r_regionkey = n_regionkey", None),
    "scan_star_mixed": ("SELECT n_name AS first_name, * FROM nation", None),
    "scan_prune": ("SELECT l_orderkey FROM lineitem", None),
    "scan_text": ("SELECT doc_id, source, n_chars FROM documents", None),
    "scan_other_types": ("SELECT o_orderkey, o_orderdate FROM orders", None),
    "project_arith": ("SELECT l_orderkey, l_quantity + 1 AS q1, l_quantity - l_tax AS q2, l_extendedprice * l_discount AS q3 FROM lineitem", None),
    "project_int_arith": ("SELECT p_partkey + 1 AS a, p_size - 3 AS b, p_size * p_size AS c FROM part", "SELECT p_partkey + 1 AS a, CAST(p_size - 3 AS INTEGER) AS b, CAST(p_size * p_size AS INTEGER) AS c FROM part"),
    "project_constants": ("SELECT n_nationkey, 7 AS seven, 2.5 AS half, 'it''s' AS word FROM nation", "SELECT n_nationkey, 7 AS seven, CAST(2.5 AS DOUBLE) AS half, 'it''s' AS word FROM nation"),
    "project_negative": ("SELECT s_suppkey, s_acctbal * -1 AS owed FROM supplier WHERE s_acctbal > -500.5", None),
    "project_precedence": ("SELECT p_partkey, p_size + 2 * 3 - 4 AS a, (p_size + 2) * (3 - 4) AS b FROM part", "SELECT p_partkey, CAST(p_size + 2 * 3 - 4 AS INTEGER) AS a, CAST((p_size + 2) * (3 - 4) AS INTEGER) AS b FROM part"),
    "int_divide": ("SELECT p_partkey, p_size / 7 AS q FROM part", "SELECT p_partkey, CAST(p_size // 7 AS INTEGER) AS q FROM part"),
    "int_divide_negative": ("SELECT p_partkey, (p_size - 25) / 4 AS q FROM part", "SELECT p_partkey, CAST(trunc((p_size - 25) / 4) AS INTEGER) AS q FROM part"),
    "int_divide_zero": ("SELECT p_partkey, p_size / (p_size - p_size) AS q FROM part", "SELECT p_partkey, CAST(NULL AS INTEGER) AS q FROM part"),
    "float_divide": ("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem", None),
    "float_divide_zero": ("SELECT s_suppkey, s_acctbal / (s_acctbal - s_acctbal) AS q FROM supplier WHERE s_acctbal > 0", "SELECT s_suppkey, CAST('Infinity' AS DOUBLE) AS q FROM supplier WHERE s_acctbal > 0"),
    "mixed_promotion": ("SELECT l_orderkey, l_linenumber + l_quantity AS s FROM lineitem", None),
    "alias_table": ("SELECT n.n_name AS name FROM nation AS n WHERE n.n_regionkey = 1", None),
    # predicates
    "filter_eq": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7", None),
    "filter_ne": ("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", None),
    "filter_ne_other_spelling": ("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'O'", None),
    "filter_lt": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5", None),
    "filter_le": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 5", None),
    "filter_gt": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45.5", None),
    "filter_ge": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 46", None),
    "filter_flipped": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE 5 > l_quantity", None),
    "filter_varchar_eq": ("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", None),
    "filter_varchar_range": ("SELECT n_name FROM nation WHERE n_name > 'NATION_2'", None),
    "filter_columns": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = l_partkey", None),
    "filter_mixed_types": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= l_quantity", None),
    "filter_and": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05 AND l_returnflag = 'R'", None),
    "filter_or": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 OR l_tax > 0.07", None),
    "filter_not": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_quantity > 10", None),
    "filter_nested": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 10 OR l_discount < 0.02) AND (l_linestatus = 'O' OR l_tax = 0.01)", None),
    "filter_null_drops": ("SELECT p_partkey FROM part WHERE p_size / (p_size - 1) < 2", "SELECT p_partkey FROM part WHERE p_size // nullif(p_size - 1, 0) < 2"),
    "filter_null_or": ("SELECT p_partkey FROM part WHERE p_size / (p_size - 1) > 100 OR p_size < 3", "SELECT p_partkey FROM part WHERE p_size // nullif(p_size - 1, 0) > 100 OR p_size < 3"),
    "zone_skip_all": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_orderkey > 99999999", None),
    "zone_skip_none": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_orderkey > -1", None),
    "zone_skip_varchar": ("SELECT COUNT(*) AS n FROM lineitem WHERE l_returnflag > 'Z'", None),
    # aggregates
    "agg_count_star": ("SELECT COUNT(*) AS n FROM lineitem", None),
    "agg_count_col": ("SELECT COUNT(l_shipdate) AS n, COUNT(l_returnflag) AS m FROM lineitem", None),
    "agg_sum_int": ("SELECT SUM(p_size) AS s, SUM(p_partkey) AS t FROM part", "SELECT CAST(SUM(p_size) AS BIGINT) AS s, CAST(SUM(p_partkey) AS BIGINT) AS t FROM part"),
    "agg_sum_float": ("SELECT SUM(l_quantity) AS s FROM lineitem", None),
    "agg_avg_int": ("SELECT AVG(p_size) AS a FROM part", None),
    "agg_avg_float": ("SELECT AVG(l_quantity) AS a FROM lineitem", None),
    "agg_minmax_int": ("SELECT MIN(l_linenumber) AS a, MAX(l_orderkey) AS b FROM lineitem", None),
    "agg_minmax_float": ("SELECT MIN(c_acctbal) AS a, MAX(c_acctbal) AS b FROM customer", None),
    "agg_minmax_varchar": ("SELECT MIN(c_name) AS a, MAX(c_mktsegment) AS b FROM customer", None),
    "agg_empty": ("SELECT COUNT(*) AS n, COUNT(l_tax) AS m, SUM(l_linenumber) AS s, AVG(l_tax) AS a, MIN(l_returnflag) AS x, MAX(l_quantity) AS y FROM lineitem WHERE l_orderkey < 0", "SELECT COUNT(*) AS n, COUNT(l_tax) AS m, CAST(SUM(l_linenumber) AS BIGINT) AS s, AVG(l_tax) AS a, MIN(l_returnflag) AS x, MAX(l_quantity) AS y FROM lineitem WHERE l_orderkey < 0"),
    "agg_repeated": ("SELECT COUNT(*) AS a, COUNT(*) AS b, MAX(p_size) AS c, MAX(p_size) AS d FROM part", None),
    "group_single": ("SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS s FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag", None),
    "group_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MIN(l_shipdate_day) AS d FROM shipped GROUP BY l_returnflag, l_linestatus", None),
    "group_no_agg": ("SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_key_hidden": ("SELECT COUNT(*) AS n, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_key_expression": ("SELECT p_size * 2 + 1 AS twice, 5 AS five, COUNT(*) AS n FROM part GROUP BY p_size", "SELECT CAST(p_size * 2 + 1 AS INTEGER) AS twice, 5 AS five, COUNT(*) AS n FROM part GROUP BY p_size"),
    "group_empty": ("SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_orderkey < 0 GROUP BY l_returnflag", None),
    "having_key": ("SELECT n_name, COUNT(*) AS n FROM nation GROUP BY n_name HAVING n_name > 'NATION_2'", None),
    "having_constant": ("SELECT COUNT(*) AS n FROM nation HAVING 1 = 0", None),
    # joins
    "join_inner": ("SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey", None),
    "join_inner_word": ("SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey", None),
    "join_multi_key": ("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'", None),
    "join_comma_two_keys": ("SELECT a.l_orderkey, b.l_linenumber FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_linenumber < b.l_linenumber", None),
    "join_comma_late_link": ("SELECT c_custkey, r_name FROM customer, region, nation WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey", None),
    "join_three_way": ("SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", None),
    "join_nested": ("SELECT c_name, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey", None),
    "join_mixed_forms": ("SELECT o_orderkey, n_name, s_name FROM orders JOIN customer ON o_custkey = c_custkey, nation, supplier WHERE c_nationkey = n_nationkey AND s_nationkey = n_nationkey AND s_suppkey < 4", None),
    "join_self": ("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_fanout": ("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey", None),
    "join_mixed_key_types": ("SELECT p_partkey, l_orderkey FROM part JOIN lineitem ON p_size = l_quantity WHERE l_orderkey < 40", None),
    "join_filter_pushdown": ("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 AND n_regionkey = 2", None),
    "join_group_agg": ("SELECT n_name, COUNT(*) AS n, MAX(c_acctbal) AS most, MIN(c_name) AS first_name FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY n_name HAVING n_name > 'NATION_1'", None),
    # the benchmark's battery, on these tables
    "battery_count_star": ("SELECT COUNT(*) AS n FROM lineitem", None),
    "battery_sum": ("SELECT SUM(l_quantity) AS s FROM lineitem", None),
    "battery_projection": ("SELECT event_id, event_type FROM events", None),
    "battery_selection": ("SELECT l_orderkey FROM lineitem WHERE l_extendedprice > 50000", None),
    "battery_join": ("SELECT c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000", None),
    "battery_group_by": ("SELECT event_type, COUNT(value) AS n FROM events GROUP BY event_type", None),
    "battery_aggregate_multi": ("SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS s, MIN(l_quantity) AS a, MAX(l_quantity) AS b FROM lineitem GROUP BY l_returnflag", None),
    "prune_narrow": ("SELECT MAX(l_tax) AS a FROM lineitem", None),
    "prune_wide": ("SELECT MAX(l_tax) AS a, MAX(l_quantity) AS b, MAX(l_extendedprice) AS c, MAX(l_discount) AS d, MAX(l_partkey) AS e, MAX(l_suppkey) AS f FROM lineitem", None),
    "join_scaling": ("SELECT c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey", None),
    **{f"selectivity_{t}": (f"SELECT COUNT(*) AS n FROM lineitem WHERE l_extendedprice < {t}", None) for t in (1000, 10000, 25000, 50000, 75000, 99990)},
}
#: Views that a query needs beside the tables: for Spark as DataFrame expressions of a table, for DuckDB as SQL.
SHIPPED = ["l_returnflag", "l_linestatus", "year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS l_shipdate_day"]


def session(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> Engine:
    engine = Engine(spark)
    for t in names:
        engine.register_parquet(t, f"{sf_dir}/{t}.parquet")
    return engine


def named_in(text: str) -> tuple[str, ...]:
    """The tables that a text speaks of; the others' footers need not be read."""
    words = set(text.replace(",", " ").replace("(", " ").split())
    return tuple(t for t in TABLES if t in words)


def of(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir, named_in(text)).sql(text)


def over_shipped(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A registered DataFrame as a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        return engine.register("shipped", spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*SHIPPED)).sql(text)

    return run


#: Small tables with NULLs and odd numbers, which the given tables lack: columns and rows.
FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "nums": ("k int, i int, f float", [(1, 1, 1.0), (1, None, None), (None, 5, 2.5), (None, 6, None), (2, None, None), (3, -7, 0.5), (3, 0, -1.5)]),
    "users": ("id int, name string", [(1, "alice"), (2, "bob"), (2, "bobby"), (None, "nobody"), (4, None)]),
    "visits": ("id int, user_id int", [(10, 1), (11, 1), (12, 2), (13, None), (14, 9), (None, 4)]),
    "odds": ("id int, x double", [(1, 1.0), (2, -0.0), (3, 0.0), (4, math.inf), (5, -math.inf), (6, math.nan), (7, None), (8, 5.5)]),
    "strings": ("s string", [("Zed",), ("abc",), ("",), ("prefix-shared-1",), ("prefix-shared-2",), ("\u00e9t\u00e9",), (None,)]),
    "nothing": ("i int, f float, s string", []),
}
#: As TEXTS, over FIXTURES.
FIXTURE_TEXTS: dict[str, tuple[str, str | None]] = {
    "null_join_keys": ("SELECT name, visits.id AS visit FROM users JOIN visits ON users.id = user_id", None),
    "null_join_comma": ("SELECT a.id AS one, b.id AS other FROM visits a, visits b WHERE a.user_id = b.user_id AND a.id <> b.id", None),
    "null_agg_int": ("SELECT COUNT(*) AS n, COUNT(i) AS m, SUM(i) AS s, AVG(i) AS a, MIN(i) AS x, MAX(i) AS y FROM nums", "SELECT COUNT(*) AS n, COUNT(i) AS m, CAST(SUM(i) AS BIGINT) AS s, AVG(i) AS a, MIN(i) AS x, MAX(i) AS y FROM nums"),
    "null_agg_float": ("SELECT COUNT(f) AS m, SUM(f) AS s, AVG(f) AS a, MIN(f) AS x, MAX(f) AS y FROM nums", "SELECT COUNT(f) AS m, SUM(CAST(f AS DOUBLE)) AS s, AVG(CAST(f AS DOUBLE)) AS a, MIN(f) AS x, MAX(f) AS y FROM nums"),
    "null_agg_varchar": ("SELECT COUNT(*) AS n, COUNT(s) AS m, MIN(s) AS x, MAX(s) AS y FROM strings", None),
    "null_agg_none_left": ("SELECT COUNT(i) AS m, SUM(i) AS s, AVG(f) AS a, MIN(f) AS x, MAX(i) AS y FROM nums WHERE k = 2", "SELECT COUNT(i) AS m, CAST(SUM(i) AS BIGINT) AS s, AVG(CAST(f AS DOUBLE)) AS a, MIN(f) AS x, MAX(i) AS y FROM nums WHERE k = 2"),
    "null_agg_no_rows": ("SELECT COUNT(*) AS n, SUM(i) AS s, AVG(f) AS a, MIN(s) AS x FROM nothing", "SELECT COUNT(*) AS n, CAST(SUM(i) AS BIGINT) AS s, AVG(CAST(f AS DOUBLE)) AS a, MIN(s) AS x FROM nothing"),
    "null_groups": ("SELECT k, COUNT(*) AS n, COUNT(i) AS m, SUM(i) AS s, MIN(f) AS x FROM nums GROUP BY k", "SELECT k, COUNT(*) AS n, COUNT(i) AS m, CAST(SUM(i) AS BIGINT) AS s, MIN(f) AS x FROM nums GROUP BY k"),
    "null_groups_two_keys": ("SELECT k, f, COUNT(*) AS n FROM nums GROUP BY k, f", None),
    "null_having": ("SELECT k, COUNT(*) AS n FROM nums GROUP BY k HAVING k > 1 OR k < 0", None),
    "null_logic_or": ("SELECT i FROM nums WHERE i > 0 OR f > 0 OR k = 2", None),
    "null_logic_and": ("SELECT k, i FROM nums WHERE NOT (i > 0 AND f > 0)", None),
    "null_arithmetic": ("SELECT k, i + 1 AS a, i * k AS b, f - 0.5 AS c, -7 / i AS d FROM nums", "SELECT k, CAST(i + 1 AS INTEGER) AS a, CAST(i * k AS INTEGER) AS b, CAST(f - CAST(0.5 AS FLOAT) AS FLOAT) AS c, CAST(CASE WHEN i <> 0 THEN trunc(-7 / i) END AS INTEGER) AS d FROM nums"),
    "nan_compares_greatest": ("SELECT id FROM odds WHERE x > 5", None),
    "nan_equals_itself": ("SELECT id FROM odds WHERE x = x", None),
    "nan_not_less": ("SELECT id FROM odds WHERE NOT x < 5.5", None),
    "zeros_are_equal": ("SELECT a.id AS one, b.id AS other FROM odds a JOIN odds b ON a.x = b.x WHERE a.x = 0", None),
    "nan_extremes": ("SELECT MIN(x) AS low, COUNT(x) AS n FROM odds WHERE x < 1 OR x > 5", None),
    "bytes_order_strings": ("SELECT s FROM strings WHERE s >= 'abc' AND s <> 'prefix-shared-1'", None),
    "default_names": ("SELECT k, COUNT(*), COUNT(i), SUM(i), MAX(f), k + 1 FROM nums GROUP BY k", 'SELECT k, COUNT(*) AS "count", COUNT(i) AS count_1, CAST(SUM(i) AS BIGINT) AS "sum", MAX(f) AS "max", CAST(k + 1 AS INTEGER) AS _c5 FROM nums GROUP BY k'),
    "default_names_star": ("SELECT *, i, i - 1 FROM nums", "SELECT k, i, f, i AS i_1, CAST(i - 1 AS INTEGER) AS _c4 FROM nums"),
    "strict_null_logic": ("SELECT k, i, f FROM nums WHERE i > 0 OR f > 0 OR k = 2", "SELECT k, i, f FROM nums WHERE k IS NOT NULL AND i IS NOT NULL AND f IS NOT NULL AND (i > 0 OR f > 0 OR k = 2)"),
}
#: Statements, and rows of each, that the queries over inserted rows load.
STATEMENTS, EACH = 98, 60


def fixture_sql(name: str) -> str:
    """A table of FIXTURES for a WITH clause of DuckDB."""
    schema, rows = FIXTURES[name]
    columns = [c.strip().split() for c in schema.split(",")]
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"'{v}'"
    kinds = {"int": "INTEGER", "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR"}
    each = [" , ".join(f"CAST({cell(v)} AS {kinds[k]}) AS {n}" for v, (n, k) in zip(r, columns, strict=True)) for r in rows or [(None,) * len(columns)]]
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT {x}" for x in each) + (")" if rows else " LIMIT 0)")


def over_fixtures(name: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, strict_null_logic=name.startswith("strict"))
        for t, (schema, rows) in FIXTURES.items():
            engine.register(t, spark.createDataFrame(rows, schema))
        return engine.sql(text)

    return run


def create_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE, INSERT and SELECT in a session of their own."""
    engine = Engine(spark)
    engine.execute("CREATE TABLE users (id int4, name varchar, score float4)")
    engine.execute("INSERT INTO users VALUES (1, 'alice', 1.5), (2, 'bob', 2.5)")
    engine.execute("INSERT INTO users (score, name, id) VALUES (-0.25, 'it''s', 15)")
    return engine.sql("SELECT id, name, score FROM users WHERE id > 1")


def new_folder(spark: SparkSession) -> str:
    """For a table's files: in spark.checkpoint.dir, or in a temporary folder where there is one machine only."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise EngineError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/base-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="base-")


def inserted(spark: SparkSession, path: str | None, statements: int = STATEMENTS, each: int = EACH) -> Engine:
    """An engine whose table `events` has rows from many INSERT statements; with a path, in a folder, opened again afterwards."""
    engine = Engine(spark, path)
    engine.execute("CREATE TABLE events (id int4, category varchar, amount float4)")
    for s in range(statements):
        rows = (f"({i}, 'cat{i % 20}', {i % 1000}.5)" for i in range(s * each, (s + 1) * each))
        engine.execute("INSERT INTO events VALUES " + ", ".join(rows))
    return Engine(spark, path) if path else engine


INSERTED = "SELECT category, COUNT(*) AS n, SUM(amount) AS total, MAX(id) AS last FROM events WHERE id > 10 GROUP BY category"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: over_shipped(t) if "FROM shipped" in t else of(t) for n, (t, _) in TEXTS.items()}
QUERIES |= {n: over_fixtures(n, t) for n, (t, _) in FIXTURE_TEXTS.items()} | {
    "create_insert_select": create_insert_select,
    "insert_many": lambda spark, sf_dir: inserted(spark, None).sql(INSERTED),
    "insert_folder": lambda spark, sf_dir: inserted(spark, new_folder(spark)).sql(INSERTED),
}
INSERTED_SQL = f"SELECT 'cat' || (i % 20) AS category, COUNT(*) AS n, SUM(CAST(i % 1000 AS DOUBLE) + 0.5) AS total, CAST(MAX(i) AS INTEGER) AS last FROM range({STATEMENTS * EACH}) AS t (i) WHERE i > 10 GROUP BY i % 20"
ORACLE_SQL: dict[str, str] = {n: sql or t for n, (t, sql) in TEXTS.items()} | {
    "group_multi": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(MIN(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)) AS INTEGER) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "create_insert_select": "SELECT CAST(id AS INTEGER) AS id, name, CAST(score AS FLOAT) AS score FROM (VALUES (2, 'bob', 2.5), (15, 'it''s', -0.25)) AS users (id, name, score)",
    "insert_many": INSERTED_SQL,
    "insert_folder": INSERTED_SQL,
}
ORACLE_SQL |= {n: "WITH " + ", ".join(map(fixture_sql, FIXTURES)) + f" {sql or t}" for n, (t, sql) in FIXTURE_TEXTS.items()}
