"""Byte-pair encoding by backtracking, and decoding by an offset table.

Encoding. An Aho-Corasick automaton over all tokens gives the longest token at a position. The
encoder takes it, checks it against the token before it in a table of compatible pairs, and if the
pair can't stand in a result of the merges, tries the next shorter token that is a prefix of it, or
goes back one token. A position that failed once is never tried again, so the time is linear in
the length. The tokens found are exactly those that the merges give: the sequence of compatible
tokens that covers a text is unique. Tokens that no merges lead to can't stand in a result, so the
automaton leaves them out.

Two tokens are compatible if encoding their joined bytes gives these two: no merge across the
border comes before the merges that made them. This is decided by undoing both tokens' merges from
the border outwards, and kept in a table.

Decoding. The bytes of all tokens stand one after another; ids become ranges of it by a table of
offsets, and all ranges of a batch are gathered at once.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from relengine.llm.common import slices, table
from relengine.llm.pieces import LONG, PieceTable, chunks, spread
from relengine.llm.vocabulary import Vocabulary, default_path, vocabulary

#: Pairs of tokens of which a worker remembers whether they are compatible; the table starts anew beyond that.
PAIRS = 1 << 17
#: Bytes of text that go to ids and back at once. Each byte takes some 30 bytes of working memory on the way.
STEP_BYTES = 768 << 10


class Backtracking:
    """Encodes bytes of one pre-token."""

    def __init__(self, v: Vocabulary):
        self.bytes_of = v.by_id
        self.left = {k: a for k, (a, _) in v.merges.items()}
        self.right = {k: b for k, (_, b) in v.merges.items()}
        self.made = {ab: k for k, ab in v.merges.items()}
        # A token is reached if both its parts are and no earlier merge comes between them; parts have smaller ids.
        reached = {k for k, x in v.by_id.items() if len(x) == 1}
        for k, (a, b) in sorted(v.merges.items()):
            if a in reached and b in reached and self._compatible(a, b, k):
                reached.add(k)
        self.id_of = {v.by_id[k]: k for k in reached}
        # One letter for a byte: the automaton's keys are strings.
        self.automaton = ahocorasick.Automaton()
        for x, k in self.id_of.items():
            self.automaton.add_word(x.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self.shorter.get(token)
        if found is None:
            x, found = self.bytes_of[token], -1
            for n in range(len(x) - 1, 0, -1):
                if x[:n] in self.id_of:
                    found = self.id_of[x[:n]]
                    break
            self.shorter[token] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Undo the later merge of the two tokens at the border, again and again; a merge across the border that comes earlier (and before `limit`) would have been made instead."""
        made, left, right = self.made, self.left, self.right
        while True:
            across = made.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                if a not in right:
                    return True
                limit, a = a, right[a]
            else:
                if b not in left:
                    return True
                limit, b = b + 1, left[b]

    def encode(self, text: bytes) -> list[int]:
        whole = self.id_of.get(text)
        if whole is not None:
            return [whole]
        s, n = text.decode("latin-1"), len(text)
        at, out, dead = 0, [], bytearray(n + 1)
        sizes, longest = self.bytes_of, self.automaton.iter_long
        token = next(longest(s))[1]
        while True:
            size = len(sizes[token])
            upto = at + size
            if not dead[upto] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = upto
                if at == n:
                    return out
                token = next(longest(s, at))[1]
                continue
            token = self.next_shorter(token)
            while token < 0:
                # Nothing that starts here fits: this position is dead, go back one token.
                dead[at] = 1
                token = out.pop()
                at -= len(sizes[token])
                token = self.next_shorter(token)


class Coder:
    """Encodes and decodes texts in batches."""

    def __init__(self, path: str):
        import public_tokenizers

        self.vocabulary = v = vocabulary(path)
        self.engine = Backtracking(v)
        self.pre = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        self.letters = not any(map(str.isalpha, v.special))
        self.table = PieceTable(self._encode_pieces)
        self.blob, self.ends = v.offsets
        tens = [b"%d," % i for i in range(len(self.ends) - 1)]
        self.digits, self.digit_ends = np.frombuffer(b"".join(tens), np.uint8), np.cumsum([0, *map(len, tens)])

    def _encode_pieces(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        ends = [0]
        special, encode, pre = self.vocabulary.special, self.engine.encode, self.pre.findall
        for piece in pieces:
            if self.letters and (piece[1:] if piece[:1] == " " else piece).isalpha():
                ids += encode(piece.encode())  # letters behind a space or none are one pre-token
            elif self.special and any(x in piece for x in special):
                for part in self.special.split(piece):
                    if part in special:
                        ids.append(special[part])
                    else:
                        for x in pre(part):
                            ids += encode(x.encode())
            else:
                for x in pre(piece):
                    ids += encode(x.encode())
            ends.append(len(ids))
        return np.array(ids, np.int32), np.diff(np.array(ends, np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin, one more at the end."""
        return self.table.encode(texts)

    def _gather(self, blob: np.ndarray, ends: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, np.ndarray]:
        starts = ends[ids]
        lens = ends[ids.astype(np.int64) + 1] - starts
        upto = np.concatenate([[0], np.cumsum(lens)])
        return memoryview(blob[spread(starts, lens)]), upto[bounds]

    def digests(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """Of each text the number of ids, and digests of the ids and of what they decode to. A text of more than STEP_BYTES goes part by part."""
        if len(texts) == 1 and len(plain := texts[0].as_py()) > LONG:
            n, named, decoded, reader = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
            for part in chunks(plain):
                ids, bounds = self.encode(pa.array([part], pa.string()))
                named.update(b"," if n and len(ids) else b"")
                named.update(self.decimal(ids, bounds)[0][:-1])
                decoded.update(reader.decode(self.decode(ids, bounds)[0]).encode())
                n += len(ids)
            decoded.update(reader.decode(b"", True).encode())
            return np.array([n]), [named.hexdigest()], [decoded.hexdigest()]
        ids, bounds = self.encode(texts)
        sha, every = hashlib.sha256, range(len(texts))
        raw, at = self.decode(ids, bounds)
        decoded = [sha(text_of(bytes(raw[at[i] : at[i + 1]])).encode()).hexdigest() for i in every]
        said, at = self.decimal(ids, bounds)
        named = [sha(said[at[i] : max(at[i], at[i + 1] - 1)]).hexdigest() for i in every]
        return np.diff(bounds), named, decoded

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids, and where those of each text begin."""
        return self._gather(self.blob, self.ends, ids, bounds)

    def decimal(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """All ids as decimal numbers with a comma after each, and where those of each text begin."""
        return self._gather(self.digits, self.digit_ends, ids, bounds)


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def text_of(raw: bytes) -> str:
    """Bytes as the library decodes them: what is no UTF-8 becomes U+FFFD."""
    return raw.decode("utf-8", "replace")


def bpe_encode(docs: DataFrame, text: str = "text", path: str | None = None, to: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>) added, or replaced if there is one of that name.

    Null texts have no ids, as empty ones; special strings in a text become their ids. Repeated
    rows and other columns stay. Rows are never shuffled.
    """
    path = path or default_path()
    docs = docs.drop(to)
    schema = StructType([*docs.schema.fields, StructField(to, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, STEP_BYTES):
            ids, bounds = coder(path).encode(pc.fill_null(batch.column(text).cast(pa.string()), ""))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, schema)


def bpe_decode(docs: DataFrame, ids: str = "ids", path: str | None = None, to: str = "decoded") -> DataFrame:
    """docs with the text of a column of token ids added. A null list gives null; an id that the vocabulary lacks is an error."""
    path = path or default_path()
    docs = docs.drop(to)
    schema = StructType([*docs.schema.fields, StructField(to, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            own = coder(path)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(lens)])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(own.ends) - 1):
                raise ValueError("an id is not in the vocabulary")
            raw, at = own.decode(flat.astype(np.int64), bounds)
            texts = [text_of(bytes(raw[at[i] : at[i + 1]])) if ok else None for i, ok in enumerate(lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """For each row: key, n_tokens, and digests of its ids and of the text decoded from these ids.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8.
    Null and empty texts have 0 tokens and the digest of nothing in both columns. Neither text nor
    ids leave the worker.
    """
    path = path or default_path()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, STEP_BYTES):
            n, named, decoded = coder(path).digests(pc.fill_null(batch.column(text).cast(pa.string()), ""))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(named), pa.array(decoded)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
