import struct
from datetime import date
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from relengine.plans.ast import Field, SqlError
from relengine.sources.dbf import DbfSource, Header, decode, encode, read_header
from relengine.types import struct_field

FIELDS = [Field("name", "C", 8), Field("id", "N", 3), Field("pay", "N", 6, 2), Field("born", "D", 8), Field("ok", "L", 1)]
ROWS = [("alice", 10, Decimal("1.20"), date(2024, 1, 2), True), (None, None, None, None, None), ("bob", -5, Decimal("-1.25"), date(2023, 12, 31), False)]


def test_round_trip(spark, tmp_path):
    from pyspark.sql.types import StructType

    spark.dataSource.register(DbfSource)
    path = str(tmp_path / "people.dbf")
    df = spark.createDataFrame(ROWS, StructType([struct_field(f) for f in FIELDS]))
    df.write.format("dbf3").mode("overwrite").save(path)
    header = read_header(path)
    assert header.records == 3 and header.fields == FIELDS
    raw = open(path, "rb").read()
    assert raw[0] == 3 and raw[header.header_size - 1] == 0x0D and raw[-1] == 0x1A and len(raw) == header.header_size + 3 * header.record_size + 1
    read = lambda **o: sorted(map(tuple, spark.read.format("dbf3").options(**o).load(path).collect()), key=str)
    assert read() == sorted(ROWS, key=str) == read(split="1")
    df.limit(1).write.format("dbf3").mode("append").save(path)
    assert read_header(path).records == 4 and len(read()) == 4


def test_deleted_and_damaged(spark, tmp_path):
    spark.dataSource.register(DbfSource)
    path = tmp_path / "t.dbf"
    fields = [Field("name", "C", 4), Field("id", "N", 3)]
    header = Header(fields, 3, 33 + 64, 8)
    batch = lambda names, ids, **more: pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "id": pa.array(ids, pa.int64()), **more})
    raw = encode(batch(["ann", "bob", "cy"], [1, 2, None], _deleted=[False, True, None]), fields, "ascii")
    assert raw == b" ann   1*bob   2 cy     "
    records = [raw]
    path.write_bytes(header.dump(date(2020, 1, 1)) + b"".join(records) + b"\x1a")
    assert sorted(map(tuple, spark.read.format("dbf3").load(str(path)).collect())) == [("ann", 1), ("cy", None)]
    with pytest.raises(SqlError):
        Header.parse(b"\x02" + path.read_bytes()[1:])
    with pytest.raises(SqlError):
        Header.parse(path.read_bytes()[:40])
    with pytest.raises(SqlError):
        encode(batch(["toolong"], [1]), fields, "ascii")
    with pytest.raises(SqlError):
        encode(batch(["é"], [1]), fields, "ascii")
    assert encode(batch(["é"], [-12]), fields, "latin-1") == " é   -12".encode("latin-1")
    # A record is called back and another one deleted by a rewrite of the marks.
    every = spark.read.format("dbf3").option("deleted", "include").load(str(path))
    assert sorted((r.name, r._deleted) for r in every.collect()) == [("ann", False), ("bob", True), ("cy", False)]
    again = str(tmp_path / "again.dbf")
    every.withColumn("_deleted", every.name == "ann").write.format("dbf3").mode("overwrite").save(again)
    assert sorted(r.name for r in spark.read.format("dbf3").load(again).collect()) == ["bob", "cy"] and read_header(again).records == 3
    assert struct.unpack("<I", path.read_bytes()[4:8]) == (3,)


def test_a_folder_of_files(spark, tmp_path):
    """One file of each task, read as one table; appended to and replaced."""
    spark.dataSource.register(DbfSource)
    to = str(tmp_path / "many")
    rows = spark.range(0, 1000, numPartitions=4).selectExpr("cast(id AS decimal(6,0)) AS id", "concat('n', id) AS name")
    read = lambda: sorted(int(r.id) for r in spark.read.format("dbf3").option("split", "70").load(to).collect())
    write = lambda df, mode: df.write.format("dbf3").option("files", "many").mode(mode).save(to)
    write(rows, "overwrite")
    assert len(list((tmp_path / "many").iterdir())) == 4 and read() == list(range(1000)) and sorted(x.name for x in tmp_path.iterdir()) == ["many"]
    write(rows.filter("id < 5"), "append")
    assert read() == sorted([*range(1000), *range(5)])
    write(rows.filter("id < 0"), "overwrite")
    assert read() == [] and spark.read.format("dbf3").load(to).columns == ["id", "name"]
    with pytest.raises(Exception, match="other fields"):
        write(rows.selectExpr("id AS other"), "append")


def test_numbers():
    """Numbers that no writer of ours makes: signs, bare points, more decimals than declared, and what is no number."""
    fields = [Field("a", "N", 7, 2), Field("b", "N", 5), Field("c", "N", 20)]
    texts = [("+1.5", "+7", "123456789012345678"), ("-.25", "3.9", "1"), ("12.", "-3.9", "-1"), ("1.005", "1e5", ""), ("x", "--1", "9" * 20)]
    raw = b"".join((" " + a.rjust(7) + b.rjust(5) + c.rjust(20)).encode() for a, b, c in texts)
    a, b, c = decode(np.frombuffer(raw, np.uint8).reshape(len(texts), 33), fields, "ascii")
    assert a.to_pylist() == [Decimal("1.50"), Decimal("-0.25"), Decimal("12.00"), Decimal("1.00"), None]
    assert b.to_pylist() == [7, 3, -3, None, None] and c.to_pylist() == [123456789012345678, 1, -1, None, 10**20 - 1]
    batch = pa.RecordBatch.from_arrays([pa.array([1, None]), pa.array([2.6, -1.0]), pa.array([Decimal("1.25"), Decimal("-3")])], names=["a", "b", "c"])
    own = decode(np.frombuffer(encode(batch, fields, "ascii"), np.uint8).reshape(2, 33), fields, "ascii")
    assert [x.to_pylist() for x in own] == [[Decimal("1.00"), None], [3, -1], [1, -3]]
