"""Catalogs under concurrent changes, segments, row numbers and transactions."""

import threading

import pytest

from relengine import storage
from relengine.plans.ast import SqlError
from relengine.session import Session
from relengine.storage import RID, Files, Versions, tier


def rows(session, text):
    return sorted(tuple(r) for r in session.sql(text).collect())


def together(*jobs):
    errors = []

    def run(job):
        try:
            job()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return errors


@pytest.mark.parametrize("local", [True, False])
def test_one_of_many_makes_a_version(spark, tmp_path, local):
    files = Files(spark, str(tmp_path))
    files.local = local  # the second way is that of other stores
    assert files.create(f"{tmp_path}/x.json", "a") and not files.create(f"{tmp_path}/x.json", "b") and files.read(f"{tmp_path}/x.json") == "a"
    assert not [x for x in files.names(str(tmp_path)) if x.startswith("_x")]
    v = Versions(files, str(tmp_path), "v")
    won = []
    if local:
        assert not together(*(lambda i=i: won.append(v.follow(0, str(i))) for i in range(8)))
        assert sum(won) == 1 and v.newest()[0] == 1


def test_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "KEPT", 3)
    v = Versions(Files(spark, str(tmp_path)), str(tmp_path), "v")
    assert all(v.follow(i, f"text {i + 1}") for i in range(10))
    assert v._numbers() == [7, 8, 9, 10] and v.newest() == (10, "text 10") and not v.follow(8, "late")
    with pytest.raises(SqlError):  # its number is free again, but that is no success
        v.follow(2, "much too late")
    assert v.newest() == (10, "text 10")


@pytest.mark.parametrize("tables", [("a", "b"), ("a", "a")])
def test_no_insert_is_lost(spark, tmp_path, tables):
    first = Session(spark, str(tmp_path))
    first.execute_script("CREATE DATABASE d; CREATE TABLE a (k NUMERIC(4)); CREATE TABLE b (k NUMERIC(4));")
    sessions = [Session(spark, str(tmp_path)) for _ in tables]
    for s in sessions:
        s.execute("USE d;")

    def insert(n):
        for i in range(8):
            sessions[n].execute(f"INSERT INTO {tables[n]} VALUES ({10 * n + i});")

    assert together(lambda: insert(0), lambda: insert(1)) == []
    found = [k for t in sorted(set(tables)) for (k,) in rows(first, f"SELECT k FROM {t}")]
    assert sorted(found) == [*range(8), *range(10, 18)]
    for t in set(tables):
        db = first.current()
        own = first.storage.read(db, db.table(t)).select(RID).collect()
        assert len({r[0] for r in own}) == len(own)


def test_concurrent_updates_and_definitions(spark, tmp_path):
    s, other = Session(spark, str(tmp_path)), Session(spark, str(tmp_path))
    s.execute_script("CREATE DATABASE d; CREATE TABLE t (k NUMERIC(4), n NUMERIC(6));")
    s.load("t", spark.createDataFrame([(i, 0) for i in range(6)], "k int, n int"))
    other.execute("USE d;")

    def work(own, low):
        for i in range(3):
            own.execute(f"UPDATE t SET n = {i + 1} WHERE k >= {low} AND k < {low + 3};")
            own.execute(f"CREATE TABLE t{low}_{i} (k NUMERIC(1));")

    assert together(lambda: work(s, 0), lambda: work(other, 3)) == []
    assert rows(s, "SELECT n FROM t") == [(3,)] * 6 and len(rows(s, "SELECT name FROM sys_tables")) == 7
    assert len(s.storage.databases()) == 1
    assert together(*(lambda i=i: Session(spark, str(tmp_path)).execute(f"CREATE DATABASE e{i};") for i in range(4))) == []
    assert sorted(d["slot"] for d in s.storage.databases().values()) == [1, 2, 3, 4, 5]


def test_many_inserts_leave_few_segments(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    s.execute_script("CREATE DATABASE d; CREATE TABLE t (k NUMERIC(4)); CREATE INDEX i ON t (k);")
    for i in range(35):
        s.execute(f"INSERT INTO t VALUES ({(i * 8) % 35});")
    segments = s.current().table("t").segments
    assert len(segments) <= 6 and sum(x.rows for x in segments) == 35
    assert [r.k for r in s.walk("i").collect()] == list(range(35))
    gone = s.vacuum(seconds=-1)
    assert rows(s, "SELECT COUNT(*) AS n FROM t") == [(35,)] and not set(gone) & {x.name for x in segments}
    assert [tier(n) for n in (0, 1, 15, 16, 255, 256)] == [0, 0, 0, 1, 1, 2]


def test_row_numbers_after_loads(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    s.execute_script("CREATE DATABASE d; CREATE TABLE t (k NUMERIC(6), v CHAR(3));")
    assert s.load("t", spark.range(0, 1000, numPartitions=7).selectExpr("id AS k", "'a' AS v")) == 1000
    assert s.load("t", spark.range(5000, 5010).selectExpr("id AS k", "'b' AS v")) == 10
    s.execute("INSERT INTO t VALUES (9999, 'c');")
    db = s.current()
    t = db.table("t")
    own = [r[0] for r in s.storage.read(db, t).select(RID).collect()]
    assert len(set(own)) == len(own) == 1011 and t.next_rid > max(own)
    assert s.load("t", spark.range(3).selectExpr("id AS k"), mode="overwrite") == 3 and rows(s, "SELECT k, v FROM t") == [(0, None), (1, None), (2, None)]
    assert s.load("t", spark.range(0).selectExpr("id AS k")) == 0


def test_a_change_moves_nothing(spark, tmp_path):
    """The rewrite of a table without an index reads the segments that are hit and writes them: no shuffle, no join."""
    s = Session(spark, str(tmp_path))
    s.execute_script("CREATE DATABASE d; CREATE TABLE t (k NUMERIC(6), v CHAR(3));")
    for low in (0, 100):
        s.load("t", spark.range(low, low + 100).selectExpr("id AS k", "'a' AS v"))
    kept = s.current().table("t").segments[1]
    plans = []
    write = s.storage.write
    s.storage.write = lambda db, t, r, *a: plans.append(r._jdf.queryExecution().executedPlan().toString()) or write(db, t, r, *a)
    assert s.execute("UPDATE t SET v = 'x' WHERE k < 10;").count == 10
    assert s.execute("DELETE FROM t WHERE k = 50;").count == 1
    assert len(plans) == 2 and not any("Exchange" in p or "Join" in p for p in plans)
    segments = s.current().table("t").segments
    assert kept in segments and sorted(x.rows for x in segments) == [99, 100]
    assert rows(s, "SELECT v, COUNT(*) AS n FROM t GROUP BY v") == [("a", 189), ("x", 10)]


def test_transactions(spark, tmp_path):
    s, other = Session(spark, str(tmp_path)), Session(spark, str(tmp_path))
    s.execute_script("CREATE DATABASE d; CREATE TABLE t (k NUMERIC(3), v CHAR(4)); INSERT INTO t VALUES (1, 'a'); INSERT INTO t VALUES (2, 'b'); INSERT INTO t VALUES (3, 'c');")
    other.execute("USE d;")
    s.execute("BEGIN;")
    for bad in ("BEGIN;", "CREATE TABLE u (k NUMERIC(3));", "USE d;"):
        with pytest.raises(SqlError):
            s.execute(bad)
    s.execute_script("UPDATE t SET v = 'x' WHERE k = 1; UPDATE t SET v = 'y' WHERE k = 1; DELETE FROM t WHERE k = 2; INSERT INTO t VALUES (4, 'd'); INSERT INTO t VALUES (5, 'e'); DELETE FROM t WHERE k = 5;")
    assert rows(s, "SELECT k, v FROM t;") == [(1, "y"), (3, "c"), (4, "d")]
    assert rows(s, "SELECT COUNT(*) AS n FROM t WHERE k IN (SELECT k FROM t WHERE v = 'd');") == [(1,)]
    assert rows(other, "SELECT k, v FROM t;") == [(1, "a"), (2, "b"), (3, "c")]
    # Another row, changed by another session, is no conflict.
    other.execute("UPDATE t SET v = 'z' WHERE k = 3;")
    other.execute("INSERT INTO t VALUES (9, 'q');")
    s.execute("COMMIT;")
    assert rows(other, "SELECT k, v FROM t;") == [(1, "y"), (3, "z"), (4, "d"), (9, "q")]
    s.execute_script("BEGIN; DELETE FROM t;")
    assert rows(s, "SELECT k FROM t;") == []
    s.execute("ROLLBACK;")
    assert len(rows(s, "SELECT k FROM t;")) == 4
    # The same row is.
    s.execute_script("BEGIN; UPDATE t SET v = 'm' WHERE k = 1;")
    other.execute("UPDATE t SET v = 'n' WHERE k = 1;")
    with pytest.raises(SqlError):
        s.execute("COMMIT;")
    assert s.transaction is not None
    s.execute("ROLLBACK;")
    assert rows(s, "SELECT v FROM t WHERE k = 1;") == [("n",)]
    # So is a table that was dropped and made again meanwhile.
    s.execute_script("BEGIN; DELETE FROM t WHERE k = 1;")
    other.execute_script("DROP TABLE t; CREATE TABLE t (k NUMERIC(3), v CHAR(4));")
    with pytest.raises(SqlError):
        s.execute("COMMIT;")


def test_commits_of_two_sessions(spark, tmp_path):
    """Transactions on different rows of one table both last, whichever comes first."""
    s = Session(spark, str(tmp_path))
    s.execute_script("CREATE DATABASE d; CREATE TABLE t (k NUMERIC(3), v NUMERIC(3));")
    s.load("t", spark.createDataFrame([(i, 0) for i in range(4)], "k int, v int"))
    sessions = [Session(spark, str(tmp_path)) for _ in range(3)]
    for i, x in enumerate(sessions):
        x.execute_script(f"USE d; BEGIN; UPDATE t SET v = {i + 1} WHERE k = {i}; INSERT INTO t VALUES ({10 + i}, {i});")
    assert together(*(lambda x=x: x.execute("COMMIT;") for x in sessions)) == []
    assert rows(s, "SELECT k, v FROM t") == [(0, 1), (1, 2), (2, 3), (3, 0), (10, 0), (11, 1), (12, 2)]
    db = s.current()
    own = [r[0] for r in s.storage.read(db, db.table("t")).select(RID).collect()]
    assert len(set(own)) == len(own)
