"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by key over range partitions, so a shard holds a range of keys in order. A task
writes its shard as files of one gzip member for each record, begins a new file when the compressed
size of the current one passes a limit, and makes every header anew: ids from the key and the
payload's digest, a fixed date, digests of block and payload. The same rows give the same bytes.

Commit. A task writes to temporary names that hold its attempt, and returns a manifest row for each
file. A task that is lost or run twice leaves files that no manifest names. When all tasks have
ended the driver renames what the manifest names, deletes the rest, and writes the manifest itself
through a temporary name as the last step: a folder without it is not committed.

Repeated payloads. Of records of equal payloads of LEAST_BYTES or more, the one of the largest key
is the response and carries the payload; the others are revisits that name it. Groups are found by
digests through partial aggregation, so that a hot payload costs a row for each partition; what is
found travels beside the payloads in the one range shuffle, and no payload goes through a join.
"""

from __future__ import annotations

import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relengine.llm.common import durable, scratch_path, slices, table

#: Records with smaller payloads are never revisits.
LEAST_BYTES = 1000
#: Compressed bytes after which a shard's next record begins a new file.
ROLL_BYTES = 64 << 20
#: Compression level of gzip members.
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest.json"


def files_at(url: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there; executors and driver see the same."""
    parts = urlsplit(url)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parts.path
    return pafs.FileSystem.from_uri(url)


def record(key: int | None, url: str | None, payload: bytes, again: bool, refers_to: int | None) -> bytes:
    """One WARC record, with headers made anew from its content. again: it is a revisit of the record of the key refers_to."""
    digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    block = b"" if again else payload
    name = "null" if key is None else str(key)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if again else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}:{digest}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Page-ID: {name}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest() if again else digest}",
    ]
    if again:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = {}
        while (line := stream.readline().strip()) != b"":
            name, _, value = line.decode().partition(":")
            head[name.strip()] = value.strip()
        size = int(head["Content-Length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield head, block


class Members(io.RawIOBase):
    """What gzip members one after another hold, read piece by piece."""

    def __init__(self, source):
        self.source, self.more, self.rest, self.engine = source, b"", b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.more:
            if self.engine.eof:
                self.rest, self.engine = self.engine.unused_data, zlib.decompressobj(31)
            if not self.rest:
                self.rest = self.source.read(1 << 20)
                if not self.rest:
                    return 0
            self.more, self.rest = self.engine.decompress(self.rest, 1 << 22), self.engine.unconsumed_tail
        n = min(len(into), len(self.more))
        into[:n] = self.more[:n]
        self.more = self.more[n:]
        return n


def repeated_payloads(pages: DataFrame, payload: str = "html", key: str = "page_id", least: int = LEAST_BYTES) -> DataFrame:
    """key, digest (SHA-256) and last (the response's key) of rows whose payload of `least` bytes or more another row has too; repeated rows once."""
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), raw.alias("raw")).filter(F.octet_length("raw") >= least).select("key", F.sha2("raw", 256).alias("digest"))
    groups = rows.groupBy("digest").agg(F.max("key").alias("last"), F.count("*").alias("n")).filter("n > 1").select("digest", "last")
    return durable(rows.distinct().join(groups, "digest").select("key", "digest", "last"), "op10-repeated")


def write_warc(pages: DataFrame, to: str, payload: str = "html", key: str = "page_id", shards: int | None = None, roll: int = ROLL_BYTES, least: int = LEAST_BYTES) -> list[dict]:
    """Writes a record for each row of pages to the folder `to` and returns its manifest: file, records, bytes and SHA-1 of each file.

    A null payload counts as empty, a missing or null url as an empty one, a null key is the
    smallest of all. Of equal payloads the row of the largest key is the response; of repeated rows
    of that key, the first is. Other columns are not written. A folder that holds a manifest is an
    error: a finished archive is never written over. What a run without a manifest left goes.
    """
    fs, folder = files_at(to)
    if fs.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.File:
        raise FileExistsError(f"{to} holds a finished archive")
    n = shards or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("key"), url.alias("url"), raw.alias("raw"), F.sha2(raw, 256).alias("digest"), F.lit(None).cast("long").alias("last"), F.lit(1).alias("kind"))
    facts = repeated_payloads(pages, payload, key, least).select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("raw"), "digest", "last", F.lit(0).alias("kind"))
    # What is known of a key comes just before its rows: no payload goes through a join.
    ranged = rows.unionByName(facts).repartitionByRange(n, "key").sortWithinPartitions("key", "kind", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = files_at(to)
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        fs.create_dir(f"{folder}/_temporary", recursive=True)
        done, out, facts = [], None, {}
        at, known, used = object(), {}, set()

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append(facts | {"sha1": facts["sha1"].hexdigest()})
                out = None

        for batch in slices(batches, "raw"):
            for r in batch.to_pylist():
                if r["key"] != at:
                    at, known, used = r["key"], {}, set()
                if r["kind"] == 0:
                    known[r["digest"]] = r["last"]
                    continue
                again, last = r["digest"] in known, known.get(r["digest"])
                if again and r["key"] == last and r["digest"] not in used:
                    again = False
                    used.add(r["digest"])
                if out is None:
                    name = f"part-{shard:06d}-{len(done):04d}.warc.gz"
                    facts = {"file": name, "temporary": f"{name}.{attempt}", "records": 0, "bytes": 0, "sha1": hashlib.sha1()}
                    out = fs.open_output_stream(f"{folder}/_temporary/{facts['temporary']}", compression=None)
                engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                whole = record(r["key"], r["url"], r["raw"], again, last)
                member = engine.compress(whole) + engine.flush()
                out.write(member)
                facts["records"] += 1
                facts["bytes"] += len(member)
                facts["sha1"].update(member)
                if facts["bytes"] >= roll:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    found = ranged.mapInArrow(run, "file string, temporary string, records long, bytes long, sha1 string").collect()
    manifest = [r.asDict() for r in sorted(found, key=lambda r: r.file)]
    commit(to, manifest)
    return manifest


def commit(to: str, manifest: list[dict]) -> None:
    """Renames the files that the manifest names, deletes those of lost attempts, then publishes the manifest."""
    fs, folder = files_at(to)
    fs.create_dir(folder, recursive=True)
    named = {row["file"] for row in manifest}
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        if info.type == pafs.FileType.File and info.base_name.startswith("part-") and info.base_name not in named:
            fs.delete_file(info.path)
    for row in manifest:
        fs.move(f"{folder}/_temporary/{row.pop('temporary')}", f"{folder}/{row['file']}")
    if fs.get_file_info(f"{folder}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{folder}/_temporary")
    with fs.open_output_stream(f"{folder}/{MANIFEST}.tmp") as out:
        out.write(json.dumps(manifest, indent=1).encode())
    fs.move(f"{folder}/{MANIFEST}.tmp", f"{folder}/{MANIFEST}")


def read_manifest(folder: str) -> list[dict]:
    fs, path = files_at(folder)
    with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, from the archives that the manifest names.

    Digests of blocks are made anew and compared with the headers. With payloads=True the block
    comes too, as a binary column; it is null for revisits.
    """
    names = [x["file"] for x in read_manifest(folder)]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    if not names:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(x,) for x in names], "file string").repartition(len(names))

    def rows_of(name: str) -> Iterator[dict]:
        fs, path = files_at(folder)
        with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
            for head, block in parse(io.BufferedReader(Members(f), 1 << 20)):
                own = hashlib.sha1(block).hexdigest()
                if f"sha1:{own}" != head["WARC-Block-Digest"]:
                    raise ValueError(f"{name}: a block is not what its digest says")
                kind = head["WARC-Type"]
                response = kind == "response"
                page, refers = head["WARC-Page-ID"], head.get("WARC-Refers-To-Page-ID")
                row = {
                    "page_id": None if page == "null" else int(page),
                    "payload_bytes": len(block) if response else int(head["WARC-Payload-Length"]),
                    "payload_digest": own if response else head["WARC-Payload-Digest"].removeprefix("sha1:"),
                    "record_type": kind,
                    "refers_to": None if refers in (None, "None") else int(refers),
                }
                yield row | ({"payload": block if response else None} if payloads else {})

    types = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] * payloads)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(types)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                for row in rows_of(name):
                    held.append(row)
                    size += 200 + len(row.get("payload") or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)

    return files.mapInArrow(run, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from the archives."""
    to = scratch_path(spark, "op10")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), to)
    return read_warc(spark, to)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, h, strlen(h) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM b
"""
