"""A quality classifier of supervised subword embeddings.

A document is the mean of the vectors of its features, a softmax output follows. Features are
words, pairs of a word and the next one, and character n-grams of each word with a mark at its
beginning and end; each is hashed to one of BUCKETS vectors. A pair of a word with itself is the
feature "repeated", whatever the word: else nothing of one text's repeats would hold for another's.
Vectors and output are learned by
stochastic gradient descent in numpy, on the driver, from a bounded sample of labelled rows.

The output is linear in the mean, so scoring needs one number for each bucket, the product of its
vector with the output: workers look up and add these numbers for the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relengine.llm.common import slices, table
from relengine.llm.labelled import SAMPLE_CHARS, SAMPLE_ROWS, fold, sample, text_blocks

BUCKETS, DIMENSIONS = 1 << 18, 8
#: Rounds over the sample, and the step of the vectors and, as a share of it, of the output. Steps are large as a feature's share of a document is small.
EPOCHS, RATE, SLOW = 6, 30.0, 0.01
#: Characters of an n-gram, the marks at a word's ends included.
GRAMS = (3, 4, 5)
#: Rows of which crc32(key) mod FOLDS is 0 are held out.
FOLDS = 5
#: Least score of the prediction 1.
CUT = 0.3

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(29))


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return ((_mixed(h ^ np.uint64(salt)) * _ODD) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def features(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of a block, and the number of the piece that each is of."""
    piece = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))
    first = int(starts[0])
    found, of = [], []
    solid = points != 32
    spaces = np.concatenate([[0], np.cumsum(~solid)])
    wide = points.astype(np.uint64)
    for n in GRAMS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        # Only the ends of an n-gram may be spaces: they mark a word's beginning and end.
        at = np.flatnonzero(spaces[n - 1 : n - 1 + size] == spaces[1 : 1 + size])
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + wide[at + k]
        found.append(_bucket(h, n))
        of.append(piece[at + 1 - first])
    edges = np.diff(solid.astype(np.int8))
    begin, end = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    if len(begin):
        lens = end - begin
        heads = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) - np.repeat(heads, lens)
        powers = np.cumprod(np.full(int(lens.max()), _STEP | np.uint64(1), np.uint64))
        words = _mixed(np.add.reduceat(_mixed(wide[solid] + np.uint64(1)) * powers[place], heads))
        own = piece[begin - first]
        found.append(_bucket(words, 101))
        of.append(own)
        near = own[1:] == own[:-1]
        pairs = np.where(words[1:] == words[:-1], np.uint64(0), words[:-1] * np.uint64(3) + words[1:])
        found.append(_bucket(pairs[near], 103))
        of.append(own[1:][near])
    return np.concatenate(found), np.concatenate(of)


def train(rows: Sequence[tuple[str, object]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """A number for each bucket and the bias: a document's odds of label 1 are exp(mean + bias). Labels are 0 and 1; without rows of both the odds are those of the rows with one of each added."""
    ones = sum(int(y) for _, y in rows)
    prior = float(np.log((ones + 1) / (len(rows) - ones + 1)))
    if not rows or ones in (0, len(rows)):
        return np.zeros(BUCKETS, np.float32), prior
    rng = np.random.default_rng(seed)
    bags = []
    for text, y in rows:
        for points, starts, _ in text_blocks(pa.array([text])):
            ids, _ = features(points, starts)
            if len(ids):
                own, n = np.unique(ids, return_counts=True)
                bags.append((own, (n / len(ids)).astype(np.float32), int(y)))
    vectors = ((rng.random((BUCKETS, DIMENSIONS), np.float32) - 0.5) / DIMENSIONS).astype(np.float32)
    out = ((rng.random((DIMENSIONS, 2), np.float32) - 0.5) / DIMENSIONS).astype(np.float32)
    bias = np.array([0.0, prior], np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in rng.permutation(len(bags)):
            own, share, y = bags[i]
            mean = share @ vectors[own]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            # The gradient of the loss by the vectors is each one's share of the mean's.
            back = out @ p
            out -= SLOW * step * np.outer(mean, p)
            bias -= SLOW * step * p
            vectors[own] -= step * share[:, None] * back[None, :]
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(texts: pa.Array, numbers: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1 of each text; of a text without features, that of the bias alone."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for points, starts, owners in text_blocks(texts):
        ids, piece = features(points, starts)
        total += np.bincount(owners[piece], numbers[ids], len(texts))
        count += np.bincount(owners[piece], minlength=len(texts))
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def quality_scores(docs: DataFrame, numbers: np.ndarray, bias: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score of each row of docs. Null and empty texts get the score of the bias; repeated rows get the same score. Nothing but the text decides, and rows are never shuffled."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            scores = score_texts(batch.column(text), numbers, bias)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(scores, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), FOLDS) != 0)
    numbers, bias = train(sample(labels, docs, "quality", most=SAMPLE_ROWS, most_chars=SAMPLE_CHARS))
    found = quality_scores(docs, numbers, bias)
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
