"""Decisions where the base dialect's behaviour is a limit, a defect or a contract."""

from datetime import date
from decimal import Decimal

import pytest

from relengine.plans.ast import SqlError
from relengine.session import Session


def rows(session, text):
    return sorted((tuple(r) for r in session.sql(text).collect()), key=str)


@pytest.fixture(scope="module")
def s(spark, tmp_path_factory):
    s = Session(spark, str(tmp_path_factory.mktemp("root")))
    s.execute_script("CREATE DATABASE d; CREATE TABLE t (name CHAR(8), n NUMERIC(4), pay NUMERIC(8,2), born DATE, active LOGICAL);")
    s.load("t", spark.createDataFrame(
        [("ann", -7, Decimal("1.50"), date(2024, 1, 2), True), ("bob", 2, Decimal("-2.25"), date(2023, 1, 1), False), ("  ", None, None, None, None), ("100%", 10, Decimal("3.00"), None, True)],
        "name string, n long, pay decimal(8,2), born date, active boolean",
    ))
    return s


def test_average_cuts_towards_zero(s):
    assert rows(s, "SELECT AVG(n) AS m FROM t WHERE n < 5;") == [(-2,)]
    assert rows(s, "SELECT AVG(n) AS m FROM t WHERE n = 99;") == [(None,)]


def test_counts(s):
    assert rows(s, "SELECT COUNT(n) AS a, COUNT(*) AS b FROM t;") == [(3, 4)]
    s.count_nulls = True
    assert rows(s, "SELECT COUNT(n) AS a FROM t;") == [(4,)]
    s.count_nulls = False
    assert rows(s, "SELECT COUNT(*) FROM t;") == [(4,)]
    assert rows(s, "SELECT name FROM t WHERE n IN (SELECT COUNT(*) AS c FROM t WHERE active = T);") == [("bob",)]
    assert rows(s, "SELECT DISTINCT COUNT(*) FROM t;") == [(4,)]


def test_blanks_are_null(s):
    assert rows(s, "SELECT COUNT(*) AS n FROM t WHERE name IS NULL;") == [(1,)]
    assert rows(s, "SELECT MIN(n) AS low, SUM(pay) AS total FROM t;") == [(-7, Decimal("2.25"))]


def test_decimals_and_signs(s):
    assert rows(s, "SELECT name FROM t WHERE pay > 1.25;") == [("100%",), ("ann",)]
    assert rows(s, "SELECT name FROM t WHERE pay < -2;") == [("bob",)]
    assert rows(s, "SELECT name FROM t WHERE n = '-7';") == [("ann",)]


def test_logicals_and_dates(s):
    for literal in ("T", "'T'", "'y'"):
        assert rows(s, f"SELECT name FROM t WHERE active = {literal};") == [("100%",), ("ann",)]
    assert rows(s, "SELECT name FROM t WHERE NOT active = T;") == [("bob",)]
    assert rows(s, "SELECT name FROM t WHERE born >= '20230601';") == [("ann",)]
    assert rows(s, "SELECT name FROM t WHERE born = 20230101;") == [("bob",)]


def test_names_ignore_case(s):
    assert rows(s, "select NAME from T where N = 2;") == [("bob",)]


def test_long_literals_and_likes(s):
    assert rows(s, "SELECT name FROM t WHERE name = 'a much longer text';") == []
    assert rows(s, "SELECT name FROM t WHERE name LIKE '%\\%';") == []
    assert rows(s, "SELECT name FROM t WHERE name LIKE name;") == [("100%",), ("ann",), ("bob",)]
    assert rows(s, "SELECT name FROM t WHERE name LIKE '';") == []
    assert rows(s, "SELECT name FROM t WHERE n LIKE '1_';") == [("100%",)]


def test_contradiction_below_an_aggregate(s):
    assert rows(s, "SELECT COUNT(*) AS c, MAX(n) AS m FROM t WHERE n > 5 AND n < 3;") == [(0, None)]
    assert rows(s, "SELECT name FROM t WHERE NOT (n < n);") == [("100%",), ("ann",), ("bob",)]
    assert rows(s, "SELECT name FROM t WHERE n > 1 AND n > NULL;") == []
    assert rows(s, "SELECT name FROM t WHERE n = 2 AND n = '2';") == [("bob",)]


def test_output_names(s):
    assert s.sql("SELECT MAX(n), COUNT(*) FROM t;").columns == ["n", "count"]
    assert rows(s, "SELECT name, MAX(n) FROM t GROUP BY name HAVING n > 5;") == [("100%", 10)]


def test_errors(s):
    for text in (
        "SELECT nothing FROM t;",
        "SELECT a.name FROM t a, t b WHERE name = 'x';",
        "SELECT name FROM nothing;",
        "CREATE TABLE t (a DATE);",
        "INSERT INTO t VALUES ('a');",
        "INSERT INTO t (name) VALUES ('a name too long');",
        "INSERT INTO t (n) VALUES ('x');",
        "UPDATE t SET n = 99999;",
        "UPDATE t SET n = 1 WHERE t.n = 2;",
        "SELECT SUM(name) AS x FROM t;",
        "USE other;",
        "DROP VIEW v;",
        "COMMIT;",
    ):
        with pytest.raises(SqlError):
            s.sql(text) if text.startswith("SELECT") else s.execute(text)


def test_indexes(spark, tmp_path):
    s = Session(spark, str(tmp_path), enforce_unique=True)
    s.execute_script("CREATE DATABASE d; CREATE TABLE t (k NUMERIC(4), v CHAR(2)); INSERT INTO t VALUES (2, 'b'); INSERT INTO t VALUES (1, 'a'); CREATE UNIQUE INDEX i ON t (k);")
    with pytest.raises(SqlError):
        s.execute("INSERT INTO t VALUES (1, 'c');")
    assert rows(s, "SELECT v FROM t WHERE k = 1;") == [("a",)]
    assert rows(s, "SELECT COUNT(*) AS n FROM t WHERE k = 1 AND v = 'b';") == [(0,)]
    # The predicate of an indexed column holds in grouped queries, too.
    assert rows(s, "SELECT v, COUNT(*) AS n FROM t WHERE k = 2 GROUP BY v;") == [("b", 1)]
    s.execute("DROP DATABASE d;")
    assert rows(s, "SELECT name FROM sys_databases;") == []
