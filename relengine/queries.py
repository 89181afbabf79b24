"""Named queries over the standard tables: each in the dialect, with the same in ANSI SQL beside it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relengine.session import Session
from relengine.storage import shared_root

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session in which the tables of a folder are registered; its own databases go to the shared folder, if there is one."""
    s = Session(spark)
    for name in TABLES:
        s.register(name, lambda name=name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return s


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def plain(dialect: str, sql: str | None = None) -> Query:
    """A query whose text serves both, unless the second differs."""
    return Query(lambda spark, d: session(spark, d).sql(dialect), sql or dialect)


def script(statements: str, last: str | Callable[[Session], DataFrame], sql: str) -> Query:
    """Statements on stored copies of nation and part, then a query; only the tables that they name are copied."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        s = session(spark, d)
        s.execute_script(
            "CREATE DATABASE d; CREATE TABLE nations (n_nationkey NUMERIC(4), n_name CHAR(25), n_regionkey NUMERIC(2));"
            "CREATE TABLE parts (p_partkey NUMERIC(12), p_name CHAR(60), p_brand CHAR(16), p_size NUMERIC(4));"
        )
        for name, source in (("nations", "nation"), ("parts", "part")):
            if name in statements or isinstance(last, str) and name in last:
                s.load(name, s.external(source))
        s.execute_script(statements)
        return s.sql(last) if isinstance(last, str) else last(s)

    return Query(run, sql)


FLAGSHIP = """
SELECT c.c_mktsegment, COUNT(*) AS total, MAX(o.o_orderkey) AS last_key, AVG(l.l_linenumber) AS avg_line
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus = 'F' AND n.n_regionkey = 2
GROUP BY c.c_mktsegment HAVING total > 1
"""
_FLAGSHIP_SQL = FLAGSHIP.replace("HAVING total", "HAVING COUNT(*)").replace("AVG(l.l_linenumber)", "CAST(SUM(l.l_linenumber) // COUNT(l.l_linenumber) AS BIGINT)")

#: part with sizes of 25 as NULL: the base tables hold none.
_SZ = "(SELECT p_partkey, p_brand, nullif(p_size, 25) AS sz FROM part)"


def nulls(tail: str, select: str = "p_partkey, sz", sql_tail: str | None = None, sql_select: str | None = None) -> Query:
    """A query of part with NULL sizes, under the name q."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        s = session(spark, d)
        s.register("q", s.external("part").select("p_partkey", "p_brand", F.expr("nullif(p_size, 25)").alias("sz")))
        return s.sql(f"SELECT {select} FROM q {tail}")

    return Query(run, f"SELECT {sql_select or select} FROM {_SZ} q {sql_tail or tail}".replace("FROM q ", f"FROM {_SZ} q "))


def view(definition: str, select: str, sql: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = session(spark, d)
        s.execute("CREATE DATABASE d;")
        s.execute_script(definition)
        return s.sql(select)

    return Query(run, sql)


_ANY = "SELECT p_partkey, p_size FROM part WHERE p_size {op} {q} (SELECT {inner} FROM {source} WHERE {where})"


def quantified(op: str, q: str, inner: str = "s_suppkey", source: str = "supplier", where: str = "s_suppkey BETWEEN 20 AND 23") -> Query:
    return plain(_ANY.format(op=op, q=q, inner=inner, source=source, where=where))


QUERIES: dict[str, Query] = {
    "flagship": plain(FLAGSHIP, _FLAGSHIP_SQL),
    "scan_full": plain("SELECT * FROM nation"),
    "project_alias": plain("SELECT n_name AS nm, n_regionkey rk FROM nation"),
    "index_eq": plain("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77"),
    "index_range": plain("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200"),
    **{f"filter_cmp_{n}": plain(f"SELECT p_partkey, p_size FROM part WHERE p_size {op} 25") for n, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))},
    "filter_col_col": plain("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey < l_orderkey"),
    "filter_decimal": plain("SELECT s_suppkey FROM supplier WHERE s_acctbal < -10.5"),
    "filter_in_list": plain("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9)"),
    "filter_between": plain("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12"),
    "filter_like_prefix": plain("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%'"),
    "filter_like_underscore": plain("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_'"),
    "filter_not_like": plain("SELECT p_partkey, p_brand FROM part WHERE NOT p_brand LIKE '%1%'"),
    "filter_is_null": nulls("WHERE sz IS NULL", "p_partkey"),
    "filter_is_not_null": nulls("WHERE sz IS NOT NULL"),
    "filter_eq_null": nulls("WHERE sz = NULL OR NOT sz <> NULL", "p_partkey"),
    "filter_not_3vl": nulls("WHERE NOT (sz = 3 AND p_partkey < 50)"),
    "filter_or_3vl": nulls("WHERE NOT (sz < 10 OR sz > 40) OR p_partkey = 7"),
    "filter_date_range": plain("SELECT o_orderkey FROM orders WHERE o_orderdate >= '19970101' AND o_orderdate < '19970301'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-03-01'"),
    "join_two": plain("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'"),
    "join_three": plain("SELECT l.l_orderkey, l.l_linenumber, c.c_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P'"),
    "join_four": plain(
        "SELECT l.l_orderkey, l.l_linenumber, n.n_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1 AND l.l_linenumber > 5"
    ),
    "join_five": plain(
        "SELECT r.r_name, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"
    ),
    "join_comma": plain("SELECT s.s_suppkey, n.n_name FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = 3"),
    "join_comma_and_on": plain(
        "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s, nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE s.s_nationkey = n.n_nationkey AND r.r_name <> 'ASIA'",
        "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s CROSS JOIN nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE s.s_nationkey = n.n_nationkey AND r.r_name <> 'ASIA'",
    ),
    "join_theta": plain("SELECT a.n_name AS low, b.n_name AS high FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey"),
    "join_self": plain("SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_text_number": plain("SELECT a.n_nationkey, b.r_name FROM nation a, region b WHERE a.n_nationkey > b.r_name", "SELECT a.n_nationkey, b.r_name FROM nation a, region b WHERE CAST(a.n_nationkey AS VARCHAR) > b.r_name"),
    "agg_count_star": plain("SELECT COUNT(*) FROM lineitem", "SELECT COUNT(*) AS count FROM lineitem"),
    "agg_count_col": nulls("", "COUNT(*) AS n, COUNT(sz) AS n_sz"),
    "agg_min": nulls("GROUP BY p_brand", "p_brand, MIN(sz) AS low"),
    "agg_max": nulls("GROUP BY p_brand", "p_brand, MAX(sz) AS high"),
    "agg_sum": nulls("GROUP BY p_brand", "p_brand, SUM(sz) AS total", sql_select="p_brand, CAST(SUM(sz) AS BIGINT) AS total"),
    "agg_avg_int": nulls("GROUP BY p_brand", "p_brand, AVG(sz) AS middle", sql_select="p_brand, CAST(SUM(sz) // COUNT(sz) AS BIGINT) AS middle"),
    "agg_global_empty": plain("SELECT COUNT(*) AS n, MIN(p_size) AS low FROM part WHERE p_size = 1 AND p_size = 2"),
    "group_by_one": plain("SELECT o_orderstatus, COUNT(*) AS n, MAX(o_orderkey) AS last FROM orders GROUP BY o_orderstatus"),
    "group_by_multi": plain("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_by_null_key": nulls("GROUP BY sz", "sz, COUNT(*) AS n"),
    "group_no_agg": plain("SELECT p_brand, p_size FROM part GROUP BY p_brand, p_size"),
    "having_alias": plain("SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING n > 30", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING COUNT(*) > 30"),
    "having_aggregate": plain("SELECT p_brand FROM part GROUP BY p_brand HAVING MAX(p_size) < 50"),
    "having_in_like": plain("SELECT p_brand, MIN(p_size) AS low FROM part GROUP BY p_brand HAVING low IN (1, 2) AND p_brand LIKE 'Brand#%'", "SELECT p_brand, MIN(p_size) AS low FROM part GROUP BY p_brand HAVING MIN(p_size) IN (1, 2) AND p_brand LIKE 'Brand#%'"),
    "having_subquery": plain(
        "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING n > ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 4) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
        "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 4) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    ),
    "distinct_one": plain("SELECT DISTINCT p_brand FROM part"),
    "distinct_multi": plain("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "distinct_grouped": plain("SELECT DISTINCT MIN(p_size) AS low FROM part GROUP BY p_brand"),
    "select_all": plain("SELECT ALL r_name FROM region"),
    "sub_in": plain("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "sub_not_in": plain("SELECT s_suppkey FROM supplier WHERE NOT s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "sub_in_or": plain("SELECT s_suppkey FROM supplier WHERE s_suppkey < 5 OR s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "sub_exists": plain("SELECT r_name FROM region WHERE EXISTS (SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2)"),
    "sub_not_exists": plain("SELECT r_name FROM region WHERE NOT EXISTS (SELECT n_name FROM nation WHERE n_regionkey = 99)"),
    "sub_any_eq": quantified("=", "ANY"),
    "sub_any_ne": quantified("<>", "ANY"),
    "sub_any_lt": quantified("<", "ANY"),
    "sub_any_ge": quantified(">=", "ANY"),
    "sub_all_gt": quantified(">", "ALL"),
    "sub_all_ge": quantified(">=", "ALL"),
    "sub_all_le": quantified("<=", "ALL"),
    "sub_all_ne": quantified("<>", "ALL"),
    "sub_all_empty": quantified(">", "ALL", where="s_suppkey < 0"),
    "sub_any_empty": quantified("=", "ANY", where="s_suppkey < 0"),
    "sub_all_nulls": nulls("WHERE sz > ALL (SELECT sz FROM q WHERE p_partkey < 5) OR NOT sz IN (SELECT sz FROM q WHERE p_partkey < 300)"),
    "from_subquery": plain("SELECT k, nm FROM (SELECT n_nationkey AS k, n_name AS nm FROM nation WHERE n_regionkey = 1) x WHERE k > 3"),
    "from_subquery_nested": plain("SELECT COUNT(*) AS n FROM (SELECT b FROM (SELECT p_brand AS b, p_size AS z FROM part) y WHERE z < 5 GROUP BY b) x"),
    "view_simple": view("CREATE VIEW v AS SELECT * FROM nation n WHERE n.n_regionkey = 1;", "SELECT n_name FROM v WHERE n_nationkey > 2", "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2"),
    "view_projected": view("CREATE VIEW v AS SELECT n_name AS nm, n_regionkey AS rk FROM nation;", "SELECT nm FROM v WHERE rk = 3", "SELECT n_name AS nm FROM nation WHERE n_regionkey = 3"),
    "view_nested": view("CREATE VIEW v AS SELECT n_name AS nm, n_regionkey AS rk FROM nation; CREATE VIEW w AS SELECT nm AS label FROM v WHERE rk = 3;", "SELECT label FROM w", "SELECT n_name AS label FROM nation WHERE n_regionkey = 3"),
    "view_join": view("CREATE VIEW v AS SELECT n_nationkey AS k, n_name AS nm FROM nation WHERE n_regionkey = 3;", "SELECT s.s_suppkey, v.nm FROM supplier s JOIN v ON s.s_nationkey = v.k", "SELECT s_suppkey, n_name AS nm FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3"),
    "view_join_left": view("CREATE VIEW v AS SELECT n_nationkey AS k, n_name AS nm FROM nation WHERE n_regionkey = 3;", "SELECT s.s_suppkey, v.nm FROM v JOIN supplier s ON v.k = s.s_nationkey", "SELECT s_suppkey, n_name AS nm FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 3"),
    "view_grouped": view("CREATE VIEW v AS SELECT p_brand AS b, COUNT(*) AS n FROM part GROUP BY p_brand;", "SELECT MAX(n) AS most FROM v", "SELECT MAX(n) AS most FROM (SELECT COUNT(*) AS n FROM part GROUP BY p_brand)"),
    "sub_same_twice": plain("SELECT p_partkey FROM part WHERE p_size > ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) OR p_size = ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)"),
    "text_quote": nulls("WHERE p_brand = 'it''s' OR sz = 3", "p_partkey"),
    "trim_fn": plain("SELECT TRIM(p_name) AS nm, TRIM(p_size) AS size_text FROM part", "SELECT TRIM(p_name) AS nm, CAST(p_size AS VARCHAR) AS size_text FROM part"),
    "rewrite_contradiction": plain("SELECT p_partkey FROM part WHERE p_size > 5 AND p_size < 3"),
    "rewrite_redundant": plain("SELECT p_partkey FROM part WHERE p_size >= 18 AND p_size > 18 AND p_size <= 24"),
    "rewrite_eq_bounds": plain("SELECT p_partkey FROM part WHERE p_size >= 18 AND p_size <= 18"),
    "rewrite_same_col": nulls("WHERE sz = sz AND sz LIKE sz AND NOT sz < sz", sql_tail="WHERE sz IS NOT NULL"),
    "rewrite_null_conflict": nulls("WHERE sz IS NULL AND sz > 3", "p_partkey"),
    "sys_tables": view("CREATE TABLE a (k NUMERIC(3)); CREATE TABLE b (k NUMERIC(3));", "SELECT name FROM sys_tables", "SELECT * FROM (VALUES ('a'), ('b')) t(name)"),
    "sys_fields": view(
        "CREATE TABLE a (k NUMERIC(6,2), c CHAR(8), d DATE, l LOGICAL);",
        "SELECT name, type, length, decimals, position FROM sys_fields WHERE table_name = 'a'",
        "SELECT * FROM (VALUES ('k', 'N', 6, 2, 1), ('c', 'C', 8, 0, 2), ('d', 'D', 8, 0, 3), ('l', 'L', 1, 0, 4)) t(name, type, length, decimals, position)",
    ),
    "sys_indexes": view("CREATE TABLE a (k NUMERIC(6), c CHAR(8)); CREATE UNIQUE INDEX i ON a (k); CREATE INDEX j ON a (c);", "SELECT * FROM sys_indexes", "SELECT * FROM (VALUES ('i', 'a', 'k', 'Y'), ('j', 'a', 'c', 'N')) t(name, table_name, key_fields, \"unique\")"),
    "sys_views": view("CREATE VIEW v AS SELECT n_name FROM nation;", "SHOW VIEWS", "SELECT 'v' AS name, 'U' AS type"),
    "show_databases": script("CREATE DATABASE e; USE d;", lambda s: s.sql("SHOW DATABASES").select("name", "slot"), "SELECT * FROM (VALUES ('d', 1), ('e', 2)) t(name, slot)"),
    "use_database": script("CREATE DATABASE e; CREATE TABLE nations (k NUMERIC(1)); USE D;", "SELECT n_name FROM nations WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "drop_database": script("CREATE DATABASE e; CREATE TABLE a (k NUMERIC(1)); DROP DATABASE E; CREATE DATABASE f;", "SELECT name, slot FROM sys_databases", "SELECT * FROM (VALUES ('d', 1), ('f', 2)) t(name, slot)"),
    "drop_table": script("CREATE INDEX by_size ON parts (p_size); DROP TABLE parts; CREATE TABLE parts (k NUMERIC(1)); INSERT INTO parts VALUES (1);", "SELECT COUNT(*) AS n FROM parts p, (SELECT name FROM sys_tables) t", "SELECT 2::BIGINT AS n"),
    "drop_table_indexes": script("CREATE INDEX by_size ON parts (p_size); CREATE INDEX by_name ON nations (n_name); DROP TABLE parts;", "SELECT name, table_name FROM sys_indexes", "SELECT 'by_name' AS name, 'nations' AS table_name"),
    "drop_view": view("CREATE VIEW v AS SELECT n_name FROM nation; CREATE VIEW w AS SELECT r_name FROM region; DROP VIEW v;", "SHOW VIEWS", "SELECT 'w' AS name, 'U' AS type"),
    "sys_databases": view("CREATE DATABASE e;", "SELECT name, slot FROM sys_databases", "SELECT * FROM (VALUES ('d', 1), ('e', 2)) t(name, slot)"),
    "dml_insert": script("INSERT INTO nations VALUES (77, 'Nowhere', 9);", "SELECT * FROM nations", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL SELECT 77, 'Nowhere', 9"),
    "dml_insert_cols": script("INSERT INTO nations (n_name, n_nationkey) VALUES (Nowhere, 77);", "SELECT * FROM nations", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL SELECT 77, 'Nowhere', NULL"),
    "dml_update": script("UPDATE parts SET p_size = 99, p_brand = 'New' WHERE p_size < 5 OR p_brand IN (SELECT p_brand FROM parts WHERE p_size = 9);", "SELECT p_partkey, p_brand, p_size FROM parts", "SELECT p_partkey, CASE WHEN h THEN 'New' ELSE p_brand END AS p_brand, CASE WHEN h THEN 99 ELSE p_size END::BIGINT AS p_size FROM (SELECT *, p_size < 5 OR p_brand IN (SELECT p_brand FROM part WHERE p_size = 9) AS h FROM part)"),
    "dml_update_null": script("UPDATE parts SET p_size = NULL WHERE p_size = 25;", "SELECT p_partkey, p_size FROM parts", "SELECT p_partkey, nullif(p_size, 25)::BIGINT AS p_size FROM part"),
    "dml_update_column": script("UPDATE parts SET p_brand = p_size, p_size = NULL WHERE p_size >= 30;", "SELECT p_partkey, p_brand, p_size FROM parts", "SELECT p_partkey, CASE WHEN p_size >= 30 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS p_brand, CASE WHEN p_size < 30 THEN p_size END::BIGINT AS p_size FROM part"),
    "dml_delete": script("DELETE FROM parts WHERE p_size > 10 AND NOT p_size = 20;", "SELECT p_partkey, p_size FROM parts", "SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE NOT (p_size > 10 AND p_size <> 20)"),
    "dml_delete_all": script("DELETE FROM parts;", "SELECT COUNT(*) AS n FROM parts", "SELECT 0::BIGINT AS n"),
    "dml_view_update": script("CREATE VIEW small AS SELECT * FROM parts p WHERE p.p_size < 10; UPDATE small SET p_brand = 'S' WHERE NOT p_brand LIKE '%#1%';", "SELECT p_partkey, p_brand FROM parts", "SELECT p_partkey, CASE WHEN p_size < 10 AND p_brand NOT LIKE '%#1%' THEN 'S' ELSE p_brand END AS p_brand FROM part"),
    "index_clustered": script("CREATE INDEX by_size ON parts (p_size);", "SELECT p_partkey FROM parts WHERE p_size = 7", "SELECT p_partkey FROM part WHERE p_size = 7"),
    "index_clustered_range": script("CREATE INDEX by_size ON parts (p_size);", "SELECT p_partkey, p_size FROM parts WHERE p_size >= 11 AND p_size < 14", "SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_size >= 11 AND p_size < 14"),
    "index_two_columns": script("CREATE INDEX by_both ON parts (p_brand, p_name);", "SELECT p_partkey, p_brand, p_name FROM parts WHERE p_brand = 'Brand#13' AND p_name > 'b'", "SELECT p_partkey, p_brand, p_name FROM part WHERE p_brand = 'Brand#13' AND p_name > 'b'"),
    "index_walk": script("CREATE INDEX by_size ON parts (p_size);", lambda s: s.walk("by_size", low=20, high=22).select("p_partkey", "p_size"), "SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_size BETWEEN 20 AND 22"),
    "index_lookup": script("CREATE INDEX by_brand ON parts (p_brand, p_name);", lambda s: s.lookup("by_brand", "Brand#13").select("p_partkey", "p_brand"), "SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#13'"),
    "index_after_changes": script("CREATE INDEX by_size ON parts (p_size); INSERT INTO parts (p_partkey, p_size) VALUES (-1, 7); UPDATE parts SET p_size = 7 WHERE p_size = 8; DELETE FROM parts WHERE p_size = 7 AND p_brand = 'Brand#13';", lambda s: s.walk("by_size", 6, 8).select("p_partkey", "p_size"), "SELECT p_partkey, least(p_size, 7)::BIGINT AS p_size FROM part WHERE p_size IN (6, 7, 8) AND NOT (p_size IN (7, 8) AND p_brand = 'Brand#13') UNION ALL SELECT -1, 7"),
    "txn_overlay": script("BEGIN; UPDATE parts SET p_size = 1; UPDATE parts SET p_size = 2 WHERE p_brand LIKE '%2'; DELETE FROM parts WHERE p_brand LIKE '%3'; INSERT INTO parts (p_brand, p_size) VALUES ('B', 3);", "SELECT p_size, COUNT(*) AS n FROM parts GROUP BY p_size", "SELECT s::BIGINT AS p_size, COUNT(*) AS n FROM (SELECT CASE WHEN p_brand LIKE '%2' THEN 2 ELSE 1 END AS s FROM part WHERE p_brand NOT LIKE '%3' UNION ALL SELECT 3) GROUP BY s"),
    "txn_rollback": script("BEGIN; DELETE FROM parts; ROLLBACK;", "SELECT COUNT(*) AS n FROM parts", "SELECT COUNT(*) AS n FROM part"),
    "txn_commit": script("BEGIN; UPDATE parts SET p_size = 1 WHERE p_size = 2; DELETE FROM nations WHERE n_regionkey = 1; COMMIT;", "SELECT a.n_name, b.n FROM nations a, (SELECT COUNT(*) AS n FROM parts WHERE p_size = 1) b", "SELECT n_name, (SELECT COUNT(*) FROM part WHERE p_size IN (1, 2)) AS n FROM nation WHERE n_regionkey <> 1"),
}


def _dbf(spark: SparkSession, rows: DataFrame) -> str:
    """A new dBase file of these rows."""
    from relengine.sources.dbf import DbfSource

    spark.dataSource.register(DbfSource)
    root = shared_root(spark)
    path = f"{root if ':' in root else 'file://' + root}.dbf"
    rows.write.format("dbf3").mode("overwrite").save(path)
    return path


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """orders with names that a dBase file takes, and a date and a logical column."""
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS okey", "o_custkey AS cust", "o_orderstatus AS status", "cast(o_totalprice AS decimal(14,2)) AS price", "cast(o_orderdate AS date) AS day", "o_orderstatus = 'F' AS done")


_DBF_SQL = "SELECT o_orderkey::BIGINT AS okey, o_custkey::BIGINT AS cust, o_orderstatus AS status, o_totalprice::DECIMAL(14,2) AS price, o_orderdate::DATE AS day, o_orderstatus = 'F' AS done FROM orders"


def _dbf_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All orders, written to a dBase file and read back."""
    return _sized(spark.read.format("dbf3").load(_dbf(spark, _orders(spark, d))))


def _sized(rows: DataFrame) -> DataFrame:
    """Keys of a dBase file's width as plain whole numbers."""
    return rows.withColumns({"okey": F.col("okey").cast("long"), "cust": F.col("cust").cast("long"), "price": F.col("price").cast("decimal(14,2)")})


def _dbf_append(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one state, then the others appended."""
    rows = _orders(spark, d)
    path = _dbf(spark, rows.filter("done"))
    rows.filter("not done").write.format("dbf3").mode("append").save(path)
    return _sized(spark.read.format("dbf3").load(path))


def _dbf_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Orders of which those of one state are marked as deleted in the file: readers leave them out."""
    path = _dbf(spark, _orders(spark, d).withColumn("_deleted", F.col("done")))
    return _sized(spark.read.format("dbf3").load(path))


QUERIES["dbf_roundtrip"] = Query(_dbf_roundtrip, _DBF_SQL)
QUERIES["dbf_append"] = Query(_dbf_append, _DBF_SQL)
QUERIES["dbf_deleted"] = Query(_dbf_deleted, _DBF_SQL + " WHERE o_orderstatus <> 'F'")
