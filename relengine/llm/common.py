"""What the operators share: tables, the shared folder, and batches of bounded size."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 2 << 20

#: A key is hot if more than one of HOT_SHARE of all rows have it, and more than HOT_ROWS: there are less than HOT_SHARE of them.
HOT_SHARE, HOT_ROWS = 10_000, 1_000

_scratch: dict[str, tuple[SparkSession, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one if this is a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="relengine-")
    spark.conf.set("spark.checkpoint.dir", made)
    _forget_later(spark, made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/relengine/{name}-{uuid.uuid4().hex}"
    _forget_later(spark, path)
    return path


def _forget_later(spark: SparkSession, path: str) -> None:
    if not _scratch:
        atexit.register(_forget)
    _scratch[path] = (spark, path)


def _forget() -> None:
    """Deletes what is left. A session that has ended can't do that any more: then the newest one tries, which may have the same file systems."""
    for path, (spark, _) in list(_scratch.items()):
        for session in (spark, SparkSession.getActiveSession()):
            try:
                delete(session, path)
                break
            except Exception:  # noqa: S112 (the JVM may be gone; other paths may still be reached)
                continue
    _scratch.clear()


def free(*tables: DataFrame) -> None:
    """Deletes the files of tables that durable() made and that no plan needs any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path in _scratch:
            delete(df.sparkSession, path)
            del _scratch[path]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: the plan behind them is cut, and lost executors cost nothing that was written. free() deletes it, or the end of the driver."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def join_by_size(rows: DataFrame, facts: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows with the columns of facts, which has each key once and in `size` how many of the rows have it.

    What is known of hot keys, less than HOT_SHARE rows, is sent to all tasks, so their rows stay
    where they are; of the keys that go through a shuffle none is large.
    """
    limit = max(total // HOT_SHARE, HOT_ROWS)
    hot, others = facts.filter(F.col(size) > limit), facts.filter(F.col(size) <= limit)
    few = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(others, on)
    return few.unionByName(rest)


def words(text: Column) -> Column:
    """The words of a text, as the contracts split it; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def balanced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text each: small batches are put together, large ones cut; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, column, most):
        own = pa.compute.sum(pa.compute.binary_length(part.column(column))).as_py() or 0
        if held and size + own > most:
            yield _joined(held)
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(ends.searchsorted(before + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers wait for other tasks, and what they keep, others lack."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
