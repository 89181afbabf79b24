"""Token counts by batch encoding in Arrow functions.

Workers put the rows of Arrow batches into batches of about BATCH_BYTES bytes, split long texts at
safe boundaries (see pieces.py), give a batch of parts to the library's batch encoder at a time, and
send back lengths only, never ids.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from relengine.llm.common import balanced, table
from relengine.llm.pieces import chunks
from relengine.llm.vocabulary import default_path, vocabulary

#: Documents of more tokens than this are over the limit.
LIMIT = 512
#: Bytes of text that are encoded as one batch, and characters of a part of a longer text. The library takes some 100 bytes for a token while a batch is encoded.
BATCH_BYTES, PART = 1 << 20, 64 << 10


@lru_cache(maxsize=2)
def _counter(path: str) -> Callable[[Sequence[str]], list[int]]:
    """The number of tokens of each of some texts, as the tokenizers library gives it; a worker is one thread, as a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    vocabulary(path)  # raises if texts can't be cut safely with this file
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def count(texts: Sequence[str]) -> list[int]:
        parts = [chunks(x, PART) for x in texts]
        flat = [x for own in parts for x in own]
        lens, at = [0], 0
        while at < len(flat):  # one text may be far longer than a batch
            upto, size = at, 0
            while upto < len(flat) and size < BATCH_BYTES:
                size += len(flat[upto]) + 1
                upto += 1
            lens += map(len, library.encode_batch_fast(flat[at:upto], add_special_tokens=False))
            at = upto
        ends = np.cumsum([len(own) for own in parts])
        return np.diff(np.cumsum(lens)[ends], prepend=0).tolist()

    return count


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with n_bytes and n_tokens of the text column added.

    The numbers are those of the tokenizers library with the file at `path` (byte-level BPE),
    without added special tokens; special strings in a text count as one token. A null text counts
    as empty: 0 bytes and 0 tokens. Other columns and repeated rows stay; columns of the new names
    are replaced. Rows are never shuffled. With keep_text=False the text doesn't come back from
    the workers, which saves its way.
    """
    path = path or default_path()
    docs = docs.drop("n_bytes", "n_tokens")
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, text, BATCH_BYTES):
            texts = pc.fill_null(batch.column(text).cast(pa.string()), "")
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), n_bytes, pa.array(_counter(path)(texts.to_pylist()), pa.int64())], names=[*kept, "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than 512 tokens) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, keep_text=False).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
