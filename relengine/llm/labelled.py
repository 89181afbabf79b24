"""What the two classifiers share: bounded samples of labelled rows, and texts as padded code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is trained on at most.
SAMPLE_ROWS = 2_000
#: Characters of such a row that are learned from at most: PARTS parts of a longer text, evenly spread over all of it.
SAMPLE_CHARS, PARTS = 32 << 10, 8
#: Bytes that are looked at together; a longer text is cut at a space.
BLOCK_BYTES = 1 << 20


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, mod folds; a null key is as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def spread_parts(text: Column, most: int = SAMPLE_CHARS, parts: int = PARTS) -> Column:
    """The text, or `parts` parts of it that begin at even distances, the last at its end, joined by spaces."""
    size, n = most // parts, F.char_length(text)
    step = (n - size) / (parts - 1)
    return F.when(n <= most, text).otherwise(F.concat_ws(" ", *(F.substring(text, (F.floor(step * k) + 1).cast("int"), F.lit(size)) for k in range(parts))))


def sample(rows: DataFrame, docs: DataFrame, label: str, key: str = "doc_id", text: str = "text", most: int = SAMPLE_ROWS, most_chars: int = SAMPLE_CHARS) -> list[tuple[str, object]]:
    """(text, label) of at most `most` rows: of those that have a label and a text, the ones with the least hash of the key.

    rows: key and label. docs: key and text. No row is left out for the length of its text; of a
    text of more than most_chars characters, parts from all over it are taken. The keys of the
    sample, `most` of them, are broadcast.
    """
    order = F.xxhash64(F.lit("sample"), F.col("_key"))
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_key is not null and _text is not null")
    labels = rows.select(F.col(key).alias("_key"), F.col(label).alias("_label")).filter("_key is not null and _label is not null")
    # Labels of rows that aren't there, or that have no text, are no part of the sample.
    chosen = labels.join(found.select("_key"), "_key", "left_semi").orderBy(order, "_key", "_label").limit(most)
    got = found.select("_key", spread_parts(F.col("_text"), most_chars).alias("_text")).join(F.broadcast(chosen), "_key").orderBy(order, "_key", "_label", "_text").limit(most)
    return [(r["_text"], r["_label"]) for r in got.select("_text", "_label").toLocalIterator()]


def text_blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The code points of all texts in blocks: (code points, where each piece begins, the text that each piece is of).

    A space stands before and after each piece; a text is one piece unless it is longer than `most`
    bytes: then it is cut at spaces where it has any. Other white space becomes spaces.
    """
    held: list[str] = []
    owners: list[int] = []
    size = 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.frombuffer((" " + " ".join(held) + " ").encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, held), np.int64, len(held)) + 1
        out = np.where((points >= 9) & (points <= 13), np.uint32(32), points), 1 + np.cumsum(lens) - lens, np.array(owners, np.int64)
        held.clear()
        owners.clear()
        return out

    for i, text in enumerate(texts.to_pylist()):
        at, upto = 0, len(text or "")
        while at < upto:
            cut = upto
            if cut - at > most:
                cut = text.rfind(" ", at + 1, at + most)
                cut = at + most if cut < 0 else cut
            held.append(text[at:cut])
            owners.append(i)
            size += cut - at
            at = cut
            if size >= most:
                yield block()
                size = 0
    if held:
        yield block()
