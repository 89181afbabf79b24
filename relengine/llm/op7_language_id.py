"""Language identification by a convolutional network over bytes.

A text is cut into windows of WINDOW bytes. Filters of several widths slide over a window's bytes,
the maximum of each filter over the window goes into a softmax over the learned languages, and a
text's probabilities are the mean of its windows', by their bytes. A filter of width w is a table
of a number for each byte at each of its w places; this is learned by stochastic gradient descent
in numpy on the driver, from a bounded sample of labelled rows. For the application, the tables of
two places next to each other become one table of byte pairs, and windows go in batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relengine.llm.common import slices, table
from relengine.llm.labelled import SAMPLE_CHARS, SAMPLE_ROWS, fold, sample

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
EPOCHS, RATE, BATCH = 10, 0.1, 32
#: Windows of a labelled row that are learned from at most, chosen at random from all over it.
WINDOWS_A_ROW = 8
#: Windows that are looked at together.
GROUP = 512
#: Rows of which crc32(key) mod FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def windows_of(text: bytes) -> np.ndarray:
    """All bytes of a text in windows; the last is filled up with zeros."""
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


@dataclass
class Network:
    languages: list[str]
    #: For each width: filters of shape (width, 256, FILTERS).
    tables: list[np.ndarray]
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def pairs(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """For each width the tables to look up: (place, whether it is of a pair of bytes, table)."""
        found = []
        for tables in self.tables:
            own = []
            for k in range(0, len(tables), 2):
                if k + 1 < len(tables):
                    own.append((k, True, (tables[k][None, :, :] + tables[k + 1][:, None, :]).reshape(1 << 16, -1)))
                else:
                    own.append((k, False, tables[k]))
            found.append(own)
        return found

    def probabilities(self, windows: np.ndarray, looked_up: list) -> np.ndarray:
        """Of each language, for each window."""
        pooled = []
        codes = windows[:, :-1].astype(np.int64) | windows[:, 1:].astype(np.int64) << 8
        single = windows.astype(np.int64)
        for w, own in zip(WIDTHS, looked_up, strict=True):
            n, total = WINDOW - w + 1, None
            for k, pair, values in own:
                got = values.take((codes if pair else single)[:, k : k + n], axis=0)
                total = got if total is None else np.add(total, got, out=total)
            pooled.append(total.max(axis=1))
        z = np.maximum(np.concatenate(pooled, 1) + self.shift, 0) @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(rows: Sequence[tuple[str, str]], epochs: int = EPOCHS, seed: int = 3) -> Network | None:
    """The network learned from texts and their languages; None without any text."""
    rng = np.random.default_rng(seed)
    languages = sorted({y for _, y in rows})
    number = {y: i for i, y in enumerate(languages)}
    held, of = [], []
    for text, y in rows:
        own = windows_of(text.encode())
        for i in rng.permutation(len(own))[:WINDOWS_A_ROW]:
            held.append(own[i])
            of.append(number[y])
    if not held:
        return None
    x, y = np.stack(held), np.array(of)
    tables = [(rng.standard_normal((w, 256, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
    wide = FILTERS * len(WIDTHS)
    shift = np.zeros(wide, np.float32)
    out = (rng.standard_normal((wide, len(languages))) * 0.1).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    columns = np.arange(FILTERS)[None, :]
    for epoch in range(epochs):
        step = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own = order[at : at + BATCH]
            b, n = x[own].astype(np.int64), len(own)
            rows_, pooled, where = np.arange(n)[:, None], [], []
            for w, t in zip(WIDTHS, tables, strict=True):
                total = sum(t[k].take(b[:, k : k + WINDOW - w + 1], axis=0) for k in range(w))
                best = total.argmax(1)
                where.append(best)
                pooled.append(total[rows_, best, columns])
            flat = np.concatenate(pooled, 1) + shift
            active = np.maximum(flat, 0)
            z = active @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y[own]] -= 1
            p /= n
            back = (p @ out.T) * (flat > 0)
            out -= step * active.T @ p
            bias -= step * p.sum(0)
            shift -= step * back.sum(0)
            for i, (w, t) in enumerate(zip(WIDTHS, tables, strict=True)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS] * (step * 4)
                for k in range(w):
                    np.subtract.at(t[k], (b[rows_, where[i] + k], np.broadcast_to(columns, where[i].shape)), g)
    return Network(languages, tables, shift, out, bias)


def identify(texts: pa.Array, network: Network | None, looked_up: list) -> tuple[list[str], np.ndarray]:
    """The language and its probability of each text; UNKNOWN and 0 of null and of texts without a letter."""
    plain = texts.to_pylist()
    named, score = [UNKNOWN] * len(plain), np.zeros(len(plain))
    wanted = [i for i, t in enumerate(plain) if t and _LETTER.search(t)] if network else []
    if not wanted:
        return named, score
    raw = [plain[i].encode() for i in wanted]
    counts = np.array([-(-len(r) // WINDOW) for r in raw])
    every = np.concatenate([windows_of(r) for r in raw])
    got = np.concatenate([network.probabilities(every[i : i + GROUP], looked_up) for i in range(0, len(every), GROUP)])
    ends = np.cumsum(counts)
    share = np.full(len(every), float(WINDOW))
    share[ends - 1] = np.array([len(r) for r in raw]) - (counts - 1) * WINDOW
    sums = np.add.reduceat(got * share[:, None], ends - counts) / np.array([len(r) for r in raw])[:, None]
    best = sums.argmax(1)
    for i, k in zip(wanted, best, strict=True):
        named[i] = network.languages[k]
    score[wanted] = np.clip(sums[np.arange(len(wanted)), best], 0, 1)
    return named, score


def languages(docs: DataFrame, network: Network | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score of each row of docs. Null texts and texts without a letter are UNKNOWN with score 0, as all are if nothing was learned. Nothing but the text decides; rows are never shuffled."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked_up = network.pairs() if network else []
        for batch in slices(batches, text):
            named, score = identify(batch.column(text), network, looked_up)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(named, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = docs.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    network = train(sample(labelled, docs, "lang", most=SAMPLE_ROWS, most_chars=SAMPLE_CHARS))
    found = languages(docs, network)
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
