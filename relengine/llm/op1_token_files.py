"""Token ids of a corpus in Parquet files: lists of ids in ascending order of the key.

Layout. One row for a document: its key, the number of its ids, the place of its first id in its
shard, the shard and the ids as a list column. Keys and counts are delta-encoded; ids are
dictionary-encoded while a dictionary of a row group's ids is small enough to pay and delta-encoded
otherwise. Row groups are of bounded bytes, pages of bounded bytes and rows, and page indexes are
written, so that a reader of some documents skips the other pages and a reader of lengths never
touches the ids.

Shards are ranges of the key, one file each; the place of a document's first id in the corpus is
its place in the shard and the sum of the shards before, which come from the counts alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relengine.llm.common import scratch_path, slices, table
from relengine.llm.pieces import PieceColumns
from relengine.llm.vocabulary import Vocabulary, default_path

#: Pieces that are joined to one text for the library, and such texts that it gets at once.
TOGETHER, AT_ONCE = 400, 64
#: Bytes of text that are encoded at once: more at a time look up fewer pieces, and take more memory.
STEP_BYTES = 4 << 20
#: Pieces and their bytes that a worker remembers: fewer of them are encoded again, and the encoder is what takes time.
PIECES, PIECE_BYTES = 400_000, 16 << 20
#: Written after each document's ids.
END = 0
#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 1 << 20, 5_000


@lru_cache(maxsize=2)
def _pieces(path: str) -> PieceColumns:
    """Pieces as the tokenizers library encodes them: many pieces at once, as one text that is cut at safe places only."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    sizes = np.diff(Vocabulary(path).offsets[1])  # the rest of it is not kept

    def each(texts: Sequence[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), AT_ONCE):
            for found in library.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False):
                yield np.array(found.ids, np.int32)

    def alone(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.empty(0, np.int32), *each(texts.to_pylist())]
        return np.concatenate(found), np.array(list(map(len, found[1:])), np.int64)

    def together(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A piece that begins with a space and another character than white space may follow any other: the cut between them is safe."""
        bounds = pa.array([*range(0, len(pieces), TOGETHER), len(pieces)], pa.int32())
        groups = pc.binary_join(pa.ListArray.from_arrays(bounds, pieces), " ").to_pylist()
        ids = np.concatenate([np.empty(0, np.int32), *each([" " + x for x in groups])])
        ends = np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + 1)
        upto = np.searchsorted(np.cumsum(sizes[ids]), ends, side="left") + 1
        return ids, np.diff(upto, prepend=0).astype(np.int64)

    return PieceColumns(alone, together, PIECES, PIECE_BYTES, STEP_BYTES)


def _encoded(rows: DataFrame, text: str, key: str, path: str) -> DataFrame:
    """key, n_tokens, shard, shard_start and ids of each row, the end included; a shard is a partition, its rows are in order already."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches, text, STEP_BYTES):
            ids, bounds = _pieces(path).encode(pc.fill_null(batch.column(text).cast(pa.string()), ""))
            ids = np.insert(ids, bounds[1:], END)
            bounds = bounds + np.arange(len(bounds))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(bounds), pa.int64()), pa.array(np.full(batch.num_rows, shard), pa.int32()), pa.array(at + bounds[:-1], pa.int64()), lists], names=[key, "n_tokens", "shard", "shard_start", "ids"])
            at += int(bounds[-1])

    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, shard int, shard_start long, ids array<int>")


def write_token_files(docs: DataFrame, to: str, text: str = "text", key: str = "doc_id", path: str | None = None, shards: int | None = None) -> None:
    """Encodes each row's whole text with the tokenizers library and writes the files described above to the folder `to`.

    Each document's ids end with END; a null text is as an empty one: END alone. Rows are in
    ascending order of the key, nulls first; rows of the same key follow a hash of their text, so
    that reruns agree and many rows of one key still spread over shards. Other columns are not
    written. Texts, which are smaller than their ids, are what is shuffled.
    """
    path = path or default_path()
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(key, text, F.xxhash64(text).alias("_tie"))
    ranged = rows.repartitionByRange(n, key, "_tie").sortWithinPartitions(key, "_tie", text)
    writer = _encoded(ranged.drop("_tie"), text, key, path).write
    for k, v in {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.dictionary.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        f"parquet.enable.dictionary#{key}": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "parquet.enable.dictionary#shard_start": "false",
        "compression": "zstd",
    }.items():
        writer = writer.option(k, v)
    writer.parquet(to)


def read_starts(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start and n_tokens of each document, without reading any ids: start is the number of ids of all documents before."""
    rows = spark.read.parquet(folder).select(key, "n_tokens", "shard", "shard_start")
    return rows.join(_bases(rows), "shard").select(key, (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens")


def _bases(rows: DataFrame) -> DataFrame:
    """The ids of all shards before each: one row for each shard."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def read_digests(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 of each document, from its ids in the files."""
    files = spark.read.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<u4")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            crc = [zlib.crc32(flat[ends[i] : ends[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("shard"), batch.column("shard_start"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=[key, "shard", "shard_start", "n_tokens", "ids_crc32"])

    kind = files.schema[key].dataType.simpleString()
    rows = files.select(key, "shard", "shard_start", "ids").mapInArrow(run, f"`{key}` {kind}, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return rows.join(_bases(files.select("shard", "n_tokens")), "shard").select(key, (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    to = scratch_path(spark, "op1")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), to)
    return read_digests(spark, to)
