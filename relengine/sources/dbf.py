"""dBase III tables as a Spark data source, to read and to write.

    spark.dataSource.register(DbfSource)
    spark.read.format("dbf3").load("people.dbf")
    df.write.format("dbf3").mode("overwrite").save("people.dbf")

Format: 32 bytes of header (version 0x03, date, number of records, sizes of header and record), 32
bytes for each field (name, kind, length, decimals), 0x0D, then records of fixed size: a deletion
flag and the fields as text, then 0x1A. Records of fixed size are split by their number, so a
large file is read by many tasks, each by one seek. Deleted records are left out, blanks are NULL,
numbers that are none are NULL, dates and logicals become such. With the option deleted=include all
records come, with a logical column _deleted; written rows of a true _deleted are marked as such. So
a record is deleted, and called back, by a rewrite that changes one column.

Writing. Each task writes its records to a file of its own beside the target; the driver writes the
header when all are known, appends the parts and renames the result over the target, because the
format wants one file. With the option files=many the target is a folder of dBase files, one of
each task, which makes it whole; the driver only moves them, new ones before old ones go. A folder
is read as one table. Lost or repeated tasks leave parts that no commit message names. Values
become text by columns, in Arrow and numpy, not one by one.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from relengine.plans.ast import Field, SqlError
from relengine.types import field_of, struct_field

#: Records of a partition, and of an Arrow batch in it.
SPLIT, BATCH = 1_000_000, 50_000
#: The column that tells whether a record is marked as deleted.
DELETED = "_deleted"
_HEADER = struct.Struct("<B3BIHH20x")
_DESCRIPTOR = struct.Struct("<11sc4xBB14x")


def _open(url: str) -> tuple[pafs.FileSystem, str]:
    parts = urlsplit(url)
    return (pafs.LocalFileSystem(), os.path.abspath(parts.path)) if parts.scheme in ("", "file") else pafs.FileSystem.from_uri(url)


@dataclass
class Header:
    fields: list[Field]
    records: int
    header_size: int
    record_size: int

    @staticmethod
    def parse(raw: bytes) -> Header:
        if len(raw) < 33:
            raise SqlError("the file is too short for a dBase table")
        version, _, _, _, records, header_size, record_size = _HEADER.unpack(raw[:32])
        if version & 0x7F != 3:
            raise SqlError(f"version {version:#04x} is not dBase III")
        fields, at = [], 32
        while at < len(raw) and raw[at] != 0x0D:
            if at + 32 > len(raw):
                raise SqlError("the header ends within a field")
            name, kind, length, decimals = _DESCRIPTOR.unpack(raw[at : at + 32])
            kind = kind.decode("ascii", "replace")
            if kind not in "CNDL":
                raise SqlError(f"fields of kind {kind} are not supported")
            fields.append(Field(name.split(b"\0")[0].decode("ascii", "replace"), kind, length, decimals))
            at += 32
        if at >= len(raw) or not fields or sum(f.length for f in fields) + 1 != record_size or header_size < at + 1:
            raise SqlError("the header is damaged")
        return Header(fields, records, header_size, record_size)

    def dump(self, day: date) -> bytes:
        out = _HEADER.pack(3, day.year - 1900 & 0xFF, day.month, day.day, self.records, self.header_size, self.record_size)
        for f in self.fields:
            out += _DESCRIPTOR.pack(f.name.encode("ascii", "replace")[:10], f.kind.encode(), f.length, f.decimals)
        return out + b"\x0d"


def files_of(url: str) -> list[str]:
    """The paths of the dBase files of a folder, or that of the file itself."""
    fs, path = _open(url)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return [path]
    found = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.File and x.path.lower().endswith(".dbf"))
    if not found:
        raise SqlError(f"{url} holds no dBase file")
    return found


def read_header(url: str, path: str | None = None) -> Header:
    """The header of a file; of a folder that of its first file."""
    fs, _ = _open(url)
    path = path or files_of(url)[0]
    with fs.open_input_stream(path, compression=None) as f:
        raw = f.read(32)
        if len(raw) == 32:
            raw += f.read(max(0, struct.unpack("<H", raw[8:10])[0] - 32))
    return Header.parse(raw)


@dataclass
class Records(InputPartition):
    path: str
    header_size: int
    start: int
    count: int


def decode(raw: np.ndarray, fields: Sequence[Field], encoding: str) -> list[pa.Array]:
    """Columns of a block of live records, one row of bytes for each."""
    out, at = [], 1
    for f in fields:
        own = np.ascontiguousarray(raw[:, at : at + f.length]).view(f"S{f.length}").ravel()
        at += f.length
        if encoding in ("ascii", "utf-8"):
            text = pa.array(own.astype(object)).cast(pa.string()) if len(own) else pa.array([], pa.string())
        else:
            text = pa.array([x.decode(encoding, "replace") for x in own.tolist()], pa.string())
        text = pc.utf8_trim(text, " \0")
        text = pc.if_else(pc.equal(text, ""), None, text)
        if f.kind == "C":
            out.append(text)
        elif f.kind == "L":
            first = pc.utf8_upper(pc.utf8_slice_codeunits(text, 0, 1))
            yes = pc.is_in(first, value_set=pa.array(["T", "Y"]))
            known = pc.is_in(first, value_set=pa.array(["T", "Y", "F", "N"]))
            out.append(pc.if_else(known, yes, None))
        elif f.kind == "D":
            good = pc.fill_null(pc.match_substring_regex(text, r"^\d{8}$"), False)
            parsed = pc.strptime(pc.if_else(good, text, None), format="%Y%m%d", unit="s", error_is_null=True)
            out.append(parsed.cast(pa.date32()))
        else:
            good = pc.fill_null(pc.match_substring_regex(text, r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), False)
            text = pc.utf8_ltrim(pc.if_else(good, text, None), "+")
            whole = f.decimals == 0 and f.length <= 18
            kind = pa.int64() if whole else pa.decimal128(min(f.length, 38), min(f.decimals, 38))
            # As files are written: at most the declared decimals. Others are rounded one by one.
            plain = r"^-?\d+$" if whole else rf"^-?\d+(\.\d{{1,{f.decimals}}})?$" if f.decimals else r"^-?\d+$"
            if pc.all(pc.match_substring_regex(text, plain), min_count=0).as_py() is not False:
                out.append(text.cast(kind))
            else:
                unit = Decimal(1).scaleb(-f.decimals)
                values = [None if x is None else Decimal(x) for x in text.to_pylist()]
                out.append(pa.array([None if x is None else int(x) if whole else x.quantize(unit) for x in values], kind))
    return out


class DbfReader(DataSourceReader):
    def __init__(self, path: str, header: Header, split: int, encoding: str, deleted: bool):
        self.path, self.header, self.split, self.encoding, self.deleted = path, header, split, encoding, deleted

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in files_of(self.path):
            own = read_header(self.path, path)
            if own.fields != self.header.fields:
                raise SqlError(f"{path} has other fields than the first file")
            out += [Records(path, own.header_size, i, min(self.split, own.records - i)) for i in range(0, own.records, self.split)]
        return out or [Records("", 0, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        fs, _ = _open(self.path)
        size = self.header.record_size
        names = [f.name for f in self.header.fields]
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.header_size + partition.start * size)
            left = partition.count
            while left:
                raw = f.read(min(left, BATCH) * size)
                got = len(raw) // size
                if not got:
                    raise SqlError(f"{partition.path} ends before its last record")
                left -= got
                block = np.frombuffer(raw[: got * size], np.uint8).reshape(got, size)
                gone = block[:, 0] == ord("*")
                if self.deleted:
                    yield pa.RecordBatch.from_arrays([*decode(block, self.header.fields, self.encoding), pa.array(gone)], names=[*names, DELETED])
                else:
                    yield pa.RecordBatch.from_arrays(decode(block[~gone], self.header.fields, self.encoding), names=names)


def encode(batch: pa.RecordBatch, fields: Sequence[Field], encoding: str) -> bytes:
    """Records of a batch's rows. Numbers stand at the right of their field, everything else at the left; what doesn't fit is an error.

    The batch has the fields' columns by their place, and a column _deleted or none.
    """
    n = batch.num_rows
    out = np.full((n, 1 + sum(f.length for f in fields)), ord(" "), np.uint8)
    if DELETED in batch.schema.names:
        out[:, 0] = np.where(pc.fill_null(batch.column(DELETED), False).to_numpy(zero_copy_only=False), ord("*"), ord(" "))
    at = 1
    for f, column in zip(fields, (c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != DELETED), strict=True):
        if f.kind == "L":
            text = pc.if_else(column, "T", "F")
        elif f.kind == "D":
            text = pc.strftime(column.cast(pa.date32()), format="%Y%m%d")
        elif f.kind == "N":
            text = _number_texts(column, f)
        else:
            text = column.cast(pa.string())
        if f.kind == "C" and encoding not in ("ascii", "utf-8"):
            raw = [(x or "").encode(encoding) for x in text.to_pylist()]
        else:
            if f.kind == "C" and encoding == "ascii" and pc.any(pc.invert(pc.string_is_ascii(text))).as_py():
                raise SqlError(f"{f.name}: a text is not ASCII; name another encoding")
            raw = pc.fill_null(text.cast(pa.binary()), b"").to_pylist()
        if any(len(x) > f.length for x in raw):
            raise SqlError(f"{f.name}: {next(x for x in raw if len(x) > f.length)!r} is longer than {f.length}")
        if n:
            raw = [x.rjust(f.length) for x in raw] if f.kind == "N" else [x.ljust(f.length) for x in raw]
            out[:, at : at + f.length] = np.frombuffer(b"".join(raw), np.uint8).reshape(n, f.length)
        at += f.length
    return out.tobytes()


def _number_texts(column: pa.Array, f: Field) -> pa.Array:
    """Numbers as texts with the field's decimals."""
    if pa.types.is_floating(column.type):
        return pa.array([None if x is None else f"{x:.{f.decimals}f}" for x in column.to_pylist()], pa.string())
    if pa.types.is_decimal(column.type):
        column = pc.round(column, ndigits=f.decimals) if column.type.scale > f.decimals else column
        column = column.cast(pa.decimal128(38, f.decimals))
    text = column.cast(pa.string())
    return text if not f.decimals or pa.types.is_decimal(column.type) else pc.binary_join_element_wise(text, "." + "0" * f.decimals, "")


@dataclass
class Part(WriterCommitMessage):
    name: str
    records: int


class DbfWriter(DataSourceArrowWriter):
    def __init__(self, path: str, fields: list[Field], overwrite: bool, encoding: str, many: bool):
        self.path, self.fields, self.overwrite, self.encoding, self.many = path, fields, overwrite, encoding, many
        self.run = uuid.uuid4().hex

    def _header(self, records: int) -> Header:
        return Header(self.fields, records, 33 + 32 * len(self.fields), 1 + sum(f.length for f in self.fields))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = _open(self.path)
        folder = f"{path}.{self.run}"
        fs.create_dir(folder, recursive=True)
        name, n = f"{folder}/{uuid.uuid4().hex}", 0
        with fs.open_output_stream(name, compression=None) as out:
            for batch in iterator:
                out.write(encode(batch, self.fields, self.encoding))
                n += batch.num_rows
        if self.many:
            self._whole(fs, f"{name}.dbf", self._header(n), [Part(name, n)])
            name = f"{name}.dbf"
        return Part(name, n)

    def _whole(self, fs: pafs.FileSystem, to: str, header: Header, parts: list[Part], before: tuple[str, Header] | None = None) -> None:
        """A file of a header, the records of another file, if there is one, and those of parts."""
        with fs.open_output_stream(to, compression=None) as out:
            out.write(header.dump(date.today()))
            if before:
                with fs.open_input_file(before[0]) as f:
                    f.seek(before[1].header_size)
                    _copy(f, out, before[1].records * before[1].record_size)
            for m in parts:
                with fs.open_input_file(m.name) as f:
                    _copy(f, out, m.records * header.record_size)
            out.write(b"\x1a")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = _open(self.path)
        parts = [m for m in messages if m is not None and m.records]
        kind = fs.get_file_info(path).type
        if not self.overwrite and kind != pafs.FileType.NotFound and read_header(self.path).fields != self.fields:
            raise SqlError("the rows have other fields than the file")
        if self.many:
            self._commit_folder(fs, path, kind, parts)
        else:
            before = None if self.overwrite or kind != pafs.FileType.File else (path, read_header(self.path))
            temporary = f"{path}.{self.run}.new"
            self._whole(fs, temporary, self._header(sum(m.records for m in parts) + (before[1].records if before else 0)), parts, before)
            fs.move(temporary, path)
        self._clean()

    def _commit_folder(self, fs: pafs.FileSystem, path: str, kind: pafs.FileType, parts: list[Part]) -> None:
        if kind == pafs.FileType.File:
            raise SqlError(f"{self.path} is a file, not a folder")
        old = files_of(self.path) if self.overwrite and kind == pafs.FileType.Directory and any(x.path.lower().endswith(".dbf") for x in fs.get_file_info(pafs.FileSelector(path))) else []
        fs.create_dir(path, recursive=True)
        if not parts:  # the fields of no rows are known, too
            parts = [Part(f"{path}.{self.run}.empty", 0)]
            self._whole(fs, parts[0].name, self._header(0), [])
        for i, m in enumerate(parts):
            fs.move(m.name, f"{path}/part-{self.run}-{i:06d}.dbf")
        for name in old:
            fs.delete_file(name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, path = _open(self.path)
        if fs.get_file_info(f"{path}.{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}.{self.run}")


def _copy(source, to, count: int) -> None:
    while count:
        raw = source.read(min(count, 8 << 20))
        if not raw:
            raise SqlError("a part is shorter than it should be")
        to.write(raw)
        count -= len(raw)


class DbfSource(DataSource):
    """Options: path; split (records of a partition); encoding of texts (ascii); deleted (include); files (many). Fields of written columns follow their metadata, or their type."""

    @classmethod
    def name(cls) -> str:
        return "dbf3"

    def schema(self) -> StructType:
        own = StructType([struct_field(f) for f in read_header(self.options["path"]).fields])
        return own.add(DELETED, "boolean") if self._deleted else own

    @property
    def _deleted(self) -> bool:
        return self.options.get("deleted", "").lower() == "include"

    def reader(self, schema: StructType) -> DataSourceReader:
        header = read_header(self.options["path"])
        return DbfReader(self.options["path"], header, int(self.options.get("split", SPLIT)), self.options.get("encoding", "ascii"), self._deleted)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        fields = [field_of(f) for f in schema.fields if f.name != DELETED]
        for f in fields:
            if len(f.name) > 10:
                raise SqlError(f"{f.name}: names in dBase files have at most 10 letters; rename the column")
        return DbfWriter(self.options["path"], fields, overwrite, self.options.get("encoding", "ascii"), self.options.get("files", "").lower() == "many")
