"""Sessions over a small store of boats, voyages and harbours: definitions, queries, changes, views."""

from datetime import date
from decimal import Decimal

import pytest

from relengine.plans.ast import SqlError
from relengine.session import Session
from relengine.shell import answer, render

HARBOURS = [("kiel", "Baltic", 12), ("brest", "Atlantic", 30), ("genoa", "Tyrrhenian", 25), ("visby", "Baltic", 7)]
BOATS = [
    (1, "Merle", "kiel", Decimal("9.50"), date(1998, 5, 1), True),
    (2, "Lune", "brest", Decimal("14.25"), date(2004, 9, 12), True),
    (3, "Aria", "genoa", Decimal("11.00"), date(2011, 2, 28), False),
    (4, "Stella", None, Decimal("7.75"), None, None),
    (5, "Otter", "kiel", Decimal("14.25"), date(2020, 12, 31), False),
]
VOYAGES = [(1, "visby", 3), (1, "kiel", 1), (2, "genoa", 21), (2, "kiel", 9), (5, "visby", 2), (5, "brest", None)]


def rows(session, text):
    return sorted((tuple(r) for r in session.sql(text).collect()), key=str)


def column(session, text):
    return [r[0] for r in rows(session, text)]


@pytest.fixture
def fleet(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    s.execute_script("""
        CREATE DATABASE sea;
        CREATE TABLE harbour (code CHAR(6), waters CHAR(12), berths NUMERIC(3));
        CREATE TABLE boat (id NUMERIC(4), name CHAR(10), home CHAR(6), length NUMERIC(6,2), built DATE, afloat LOGICAL);
        CREATE TABLE voyage (boat NUMERIC(4), goal CHAR(6), days NUMERIC(3));
    """)
    s.load("harbour", spark.createDataFrame(HARBOURS, "code string, waters string, berths int"))
    s.load("boat", spark.createDataFrame(BOATS, "id int, name string, home string, length decimal(6,2), built date, afloat boolean"))
    s.load("voyage", spark.createDataFrame(VOYAGES, "boat int, goal string, days int"))
    return s


def test_queries(fleet):
    assert column(fleet, "SELECT name FROM boat WHERE length > 10 AND afloat = T") == ["Lune"]
    assert column(fleet, "SELECT b.name FROM boat b WHERE b.home IN ('kiel', 'genoa') OR b.built IS NULL") == ["Aria", "Merle", "Otter", "Stella"]
    joined = "SELECT b.name, h.waters, v.days FROM voyage v JOIN boat b ON v.boat = b.id JOIN harbour h ON v.goal = h.code WHERE v.days > 2"
    assert rows(fleet, joined) == [("Lune", "Baltic", 9), ("Lune", "Tyrrhenian", 21), ("Merle", "Baltic", 3)]
    comma = "SELECT b.name, h.waters FROM boat b, harbour h WHERE b.home = h.code AND h.berths < 20"
    assert rows(fleet, comma) == [("Merle", "Baltic"), ("Otter", "Baltic")]
    mixed = "SELECT b.name, g.code FROM harbour g, boat b JOIN harbour h ON b.home = h.code WHERE g.waters = h.waters AND g.code <> h.code"
    assert rows(fleet, mixed) == [("Merle", "visby"), ("Otter", "visby")]
    grouped = "SELECT h.waters, COUNT(*) AS visits, SUM(v.days) AS days, AVG(v.days) AS mean FROM voyage v JOIN harbour h ON v.goal = h.code GROUP BY h.waters"
    assert rows(fleet, grouped) == [("Atlantic", 1, None, None), ("Baltic", 4, 15, 3), ("Tyrrhenian", 1, 21, 21)]
    assert rows(fleet, grouped + " HAVING visits > 1 AND MAX(v.days) < 10") == [("Baltic", 4, 15, 3)]
    assert column(fleet, "SELECT DISTINCT waters FROM harbour WHERE NOT waters LIKE 'A%'") == ["Baltic", "Tyrrhenian"]
    assert rows(fleet, "SELECT TRIM(id) AS label FROM boat WHERE id < 3") == [("1",), ("2",)]


@pytest.mark.parametrize("where, names", [
    ("home = ANY (SELECT code FROM harbour WHERE waters = 'Baltic')", ["Merle", "Otter"]),
    ("NOT home IN (SELECT code FROM harbour WHERE waters = 'Baltic')", ["Aria", "Lune"]),
    ("NOT home IN (SELECT home FROM boat)", []),
    ("length >= ALL (SELECT length FROM boat)", ["Lune", "Otter"]),
    ("length < ANY (SELECT length FROM boat WHERE afloat = T) AND id > 2", ["Aria", "Stella"]),
    ("built > ALL (SELECT built FROM boat WHERE id = 9)", ["Aria", "Lune", "Merle", "Otter", "Stella"]),
    ("EXISTS (SELECT boat, goal FROM voyage WHERE days > 20) AND id = 4", ["Stella"]),
    ("NOT EXISTS (SELECT boat FROM voyage WHERE days > 20)", []),
    ("home = NULL OR NOT home <> NULL", []),
    ("home IS NULL AND afloat IS NULL", ["Stella"]),
])
def test_predicates(fleet, where, names):
    assert column(fleet, f"SELECT name FROM boat WHERE {where}") == names


def test_changes(fleet):
    run = fleet.execute
    assert run("UPDATE boat SET length = 10, name = 'Merle II' WHERE id = 1;").count == 1
    assert run("UPDATE boat SET home = name WHERE id = 3;").count == 1
    assert run("DELETE FROM boat WHERE built > '20100101' AND afloat = F AND home = 'kiel';").count == 1
    assert run("DELETE FROM boat WHERE id = 77;").count == 0
    assert run("INSERT INTO boat (name, id) VALUES ('it''s new', 6);").count == 1
    assert rows(fleet, "SELECT id, name, home, length FROM boat WHERE id <> 2 AND id <> 4") == [(1, "Merle II", "kiel", Decimal("10.00")), (3, "Aria", "Aria", Decimal("11.00")), (6, "it's new", None, None)]
    for bad in ("UPDATE voyage SET goal = 'a harbour far away';", "UPDATE harbour SET code = waters;", "UPDATE boat SET id = 1, ID = 2;", "INSERT INTO voyage VALUES (1, 'x', 1000);"):
        with pytest.raises(SqlError):
            run(bad)
    assert run("DELETE FROM voyage;").count == 6 and rows(fleet, "SELECT COUNT(*) AS n FROM voyage") == [(0,)]


def test_views(fleet):
    fleet.execute_script("""
        CREATE VIEW wet AS SELECT * FROM boat b WHERE b.afloat = T;
        CREATE VIEW berth AS SELECT w.name AS who, h.berths AS places FROM wet w JOIN harbour h ON w.home = h.code;
    """)
    assert rows(fleet, "SELECT who, places FROM berth WHERE places > 12") == [("Lune", 30)]
    assert rows(fleet, "SELECT b.who, v.days FROM berth b, voyage v WHERE v.goal = 'kiel' AND v.days > 5") == [("Lune", 9), ("Merle", 9)]
    assert fleet.execute("UPDATE wet SET home = 'visby' WHERE length < 10;").count == 1
    assert rows(fleet, "SHOW VIEWS") == [("berth", "U"), ("wet", "U")]
    with pytest.raises(SqlError):
        fleet.execute("DELETE FROM berth;")
    fleet.execute("DROP VIEW berth;")
    assert rows(fleet, "SHOW VIEWS") == [("wet", "U")]


def test_definitions(fleet):
    fleet.execute_script("CREATE INDEX by_home ON boat (home); CREATE INDEX by_both ON boat (home, name); CREATE DATABASE lake; CREATE TABLE raft (id NUMERIC(2));")
    assert column(fleet, "SELECT name FROM sys_tables") == ["raft"]
    fleet.execute("USE sea;")
    assert rows(fleet, "SELECT name, key_fields FROM sys_indexes") == [("by_both", "home,name"), ("by_home", "home")]
    assert rows(fleet, "SELECT name, slot FROM sys_databases") == [("lake", 2), ("sea", 1)]
    fleet.execute_script("DROP DATABASE lake; DROP TABLE boat;")
    assert rows(fleet, "SELECT name FROM sys_indexes") == [] and fleet.sql("SHOW DATABASES").count() == 1
    with pytest.raises(SqlError):
        fleet.sql("SELECT name FROM boat")
    fleet.execute("CREATE TABLE boat (id NUMERIC(2));")
    assert rows(fleet, "SELECT COUNT(*) AS n FROM boat") == [(0,)]


def test_ordered_access(fleet):
    fleet.execute_script("CREATE INDEX by_length ON boat (length); CREATE INDEX by_home ON boat (home, name);")
    assert [r.id for r in fleet.walk("by_length").collect()][:3] == [4, 1, 3]
    assert [r.id for r in fleet.walk("by_length", low=9.5, high="11").collect()] == [1, 3]
    assert [r.name for r in fleet.walk("by_home").collect()] == ["Stella", "Lune", "Aria", "Merle", "Otter"]
    assert [r.name for r in fleet.walk("by_home", low=("kiel", "N"), descending=True).collect()] == ["Otter"]
    assert [r.name for r in fleet.lookup("by_home", "kiel").orderBy("name").collect()] == ["Merle", "Otter"]
    assert [r.id for r in fleet.lookup("by_home", "kiel", "Otter").collect()] == [5]
    for bad in ((), ("a", "b", "c")):
        with pytest.raises(SqlError):
            fleet.lookup("by_home", *bad)


def test_printed(fleet):
    assert render(fleet.sql("SELECT name, length FROM boat WHERE id = 2")) == "Lune | 14.25\r\n1 row\r\n"
    assert render(fleet.sql("SELECT code FROM harbour WHERE berths > 100")) == "0 rows\r\n"
    assert answer(fleet.execute("SELECT COUNT(*) FROM voyage;")) == "6\r\n"
    assert answer(fleet.execute("SELECT COUNT(*) AS n FROM voyage WHERE days > 2 AND boat = 2;")) == "2\r\n"
    assert answer(fleet.execute("SELECT COUNT(*) AS n FROM voyage GROUP BY boat HAVING n > 1;")).endswith("3 rows\r\n")
    assert answer(fleet.execute("DELETE FROM voyage WHERE boat = 1;")) == "2 deleted\r\n"
    text = render(fleet.sql("SELECT code FROM harbour"), most=3)
    assert text.count("\r\n") == 5 and "1 more row" in text and text.endswith("4 rows\r\n")
