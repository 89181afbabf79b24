"""Encoding of texts piece by piece, for byte-level BPE vocabularies.

The pre-tokenizer of these vocabularies never puts a space behind another character of the same
pre-token, unless in a run of white space. So a text may be cut before every space that a
character other than white space follows: the pieces' ids, one after another, are the text's ids.
Pieces repeat, so each worker keeps what it has encoded in a table of bounded size. Most pieces of a
corpus come once or twice: where room is needed, those that came more often stay.

Special strings are no pre-tokens of that kind; vocabulary.py takes only such that no cut falls into.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that is no safe place to cut: white space or the end follows.
UNSAFE = re.compile(r" (?:\s|\Z)")
CUT = re.compile(r"(?= \S)")
#: The same for what follows a space, as Arrow's expressions have it.
UNSAFE_AFTER = r"^(?:\z|[\s\x0b\x1c-\x1f\x{85}\p{Z}])"
#: Longer texts are cut at a safe place first, so that no step holds more than this many characters in pieces.
LONG = 1 << 18
#: Pieces and characters in pieces that a table holds before it makes room, beyond what one slice of texts needs.
PIECES, PIECE_CHARS = 160_000, 12 << 20


def chunks(text: str, most: int = LONG) -> list[str]:
    """The text in parts of about `most` characters, cut at safe places only."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        cut = CUT.search(text, at + most)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... lens[i] of them, for each i in turn."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    shift = starts - (ends - lens)
    # Half the memory where 32 bits are enough.
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int((starts + lens).max()) < 1 << 31) else np.int64
    out = np.repeat(shift.astype(kind), lens)
    out += np.arange(total, dtype=kind)
    return out


class PieceTable:
    """Ids of pieces. encode: gives the ids of each of some pieces as (all ids, number of each)."""

    def __init__(self, encode: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]], most: int = PIECES, most_chars: int = PIECE_CHARS):
        self.encode_pieces, self.most, self.most_chars = encode, most, most_chars
        self._fill([], np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32))

    def _fill(self, pieces: list[str], ids: np.ndarray, lens: np.ndarray, hits: np.ndarray) -> None:
        self.index: dict[str, int] = dict(zip(pieces, range(len(pieces)), strict=True))
        self.chars = sum(map(len, pieces))
        self.ids, self.used = ids, len(ids)
        self.starts, self.lens, self.hits = np.cumsum(lens) - lens, lens, hits

    def _make_room(self, fresh: int) -> None:
        """Lets go of pieces that came only once since room was made last, and of the rarer ones where these are too many."""
        if len(self.index) + fresh <= self.most and self.chars <= self.most_chars:
            return
        pieces = list(self.index)
        stay = np.argsort(-self.hits, kind="stable")[: self.most // 2]
        stay = np.sort(stay[self.hits[stay] > 1])
        sizes = np.cumsum([len(pieces[i]) for i in stay]) if len(stay) else np.empty(0)
        stay = stay[: int(np.searchsorted(sizes, self.most_chars // 2))]
        lens = self.lens[stay]
        self._fill([pieces[i] for i in stay], self.ids[spread(self.starts[stay], lens)], lens, self.hits[stay] // 2)

    def codes(self, pieces: Sequence[str]) -> np.ndarray:
        """The rows of the pieces in this table; pieces that it lacks are added."""
        found = list(map(self.index.get, pieces))
        if None in found:
            fresh = list(dict.fromkeys(p for p, k in zip(pieces, found, strict=True) if k is None))
            ids, lens = self.encode_pieces(fresh)
            first = len(self.starts)
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(ids), self.used), np.int32)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.hits = np.concatenate([self.hits, np.zeros(len(fresh), np.int32)])
            self.used += len(ids)
            self.chars += sum(map(len, fresh))
            self.index.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            found = list(map(self.index.__getitem__, pieces))
        return np.array(found, np.int64)

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pieces of all texts, and where each text's begin (one more at the end)."""
        plain = texts.to_pylist()
        if not plain:
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        odd = [i for i, x in enumerate(plain) if len(x) > LONG or UNSAFE.search(x)]
        if odd:
            hide = np.zeros(len(plain), bool)
            hide[odd] = True
            texts = pc.if_else(pa.array(hide), "", texts)
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        others = [" " + x for x in coded.dictionary.to_pylist()]
        firsts = [x.partition(" ")[0] for x in plain]
        for i in odd:
            firsts[i] = ""
        parts = [[p for part in chunks(plain[i]) for p in CUT.split(part)] for i in odd]
        # Room is made before anything is added: codes of one slice are of one table.
        every = (others, firsts, *parts)
        if len(self.index) + sum(map(len, every)) > self.most or self.chars > self.most_chars:
            known = self.index.__contains__
            self._make_room(sum(len(own) - sum(map(known, own)) for own in every))
        codes = self.codes(others)[coded.indices.to_numpy()]
        codes[ends[:-1]] = self.codes(firsts)
        if not odd:
            self.hits += np.bincount(codes, minlength=len(self.hits)).astype(np.int32)
            return codes, ends
        runs, lens, at = [], np.diff(ends), 0
        for i, own in zip(odd, map(self.codes, parts), strict=True):
            runs += [codes[at : ends[i]], own]
            at, lens[i] = ends[i + 1], len(own)
        codes = np.concatenate([*runs, codes[at:]])
        self.hits += np.bincount(codes, minlength=len(self.hits)).astype(np.int32)
        return codes, np.concatenate([[0], np.cumsum(lens)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), and where each text's begin, one more at the end."""
        codes, ends = self._parts(texts)
        lens = self.lens[codes]
        upto = np.concatenate([[0], np.cumsum(lens)])
        return self.ids[spread(self.starts[codes], lens)], upto[ends]


class PieceColumns:
    """The same as PieceTable, but all pieces of a step are handled as columns: none becomes a Python object unless it is to be encoded.

    A piece stands here without the space that it begins with; a text's first piece, which begins
    with none, has one before it. So the two never look alike: no other piece has white space behind its space.
    firsts: gives the ids of each of some texts as (all ids, number of each), others: the same for pieces, without their spaces.
    """

    def __init__(self, firsts: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], others: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int, most_bytes: int, step: int):
        self.encode_firsts, self.encode_others, self.most, self.most_bytes, self.step = firsts, others, most, most_bytes, step
        self.pieces, self.lists, self.hits = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())), np.empty(0, np.int64)

    def _make_room(self) -> None:
        """Lets go of pieces that came only once since room was made last, and of the rarer ones where these are too many."""
        sizes = pc.binary_length(self.pieces).to_numpy()
        if len(sizes) <= self.most and sizes.sum(dtype=np.int64) <= self.most_bytes:
            return
        stay = np.argsort(-self.hits, kind="stable")[: self.most // 2]
        stay = stay[self.hits[stay] > 1]
        stay = np.sort(stay[np.cumsum(sizes[stay], dtype=np.int64) <= self.most_bytes // 2])
        kept = pa.array(stay)
        self.pieces, self.lists, self.hits = self.pieces.take(kept), self.lists.take(kept), self.hits[stay] // 2

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """The rows of the pieces, all different, in this table; pieces that it lacks are added. Firsts come last."""
        found = pc.index_in(pieces, value_set=self.pieces)
        missing = found.is_null()
        rows = found.fill_null(0).to_numpy()
        if found.null_count:
            fresh = pieces.filter(missing)
            n = len(fresh) - (pc.sum(pc.starts_with(fresh, " ")).as_py() or 0)
            ids, lens = map(np.concatenate, zip(self.encode_others(fresh.slice(0, n)), self.encode_firsts(pc.utf8_slice_codeunits(fresh.slice(n), 1)), strict=True))
            rows = rows.copy()
            rows[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.pieces), len(self.pieces) + len(fresh))
            bounds = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            self.pieces = pa.concat_arrays([self.pieces, fresh])
            self.lists = pa.concat_arrays([self.lists, pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids, pa.int32()))])
            self.hits = np.concatenate([self.hits, np.zeros(len(fresh), np.int64)])
        return rows

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Different pieces, firsts last, which of them the texts are made of, and where each text's begin (one more at the end)."""
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        words = split.flatten()
        coded = words.dictionary_encode()
        pieces, codes = coded.dictionary, coded.indices.to_numpy().copy()
        unsafe = pc.match_substring_regex(pieces, UNSAFE_AFTER).to_numpy(zero_copy_only=False)[codes]
        unsafe[ends[:-1]] = False
        if unsafe.any():
            # Words behind a space that is no safe place to cut belong to the piece before.
            heads = np.flatnonzero(~unsafe)
            sizes = np.diff(heads, append=len(codes))
            many = np.flatnonzero(sizes > 1)
            bounds = np.concatenate([[0], np.cumsum(sizes[many])]).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words.take(pa.array(spread(heads[many], sizes[many])))), " ").dictionary_encode()
            codes, ends = codes[heads], np.searchsorted(heads, ends)
            codes[many] = len(pieces) + joined.indices.to_numpy()
            pieces = pa.concat_arrays([pieces, joined.dictionary])
        firsts = pc.binary_join_element_wise("", pieces.take(pa.array(codes[ends[:-1]])), " ").dictionary_encode()
        codes[ends[:-1]] = len(pieces) + firsts.indices.to_numpy()
        return pa.concat_arrays([pieces, firsts.dictionary]), codes, ends

    def _step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, codes, ends = self._parts(texts)
        times = np.bincount(codes, minlength=len(pieces))
        used = times > 0
        rows = self._rows(pieces.filter(pa.array(used)))
        self.hits[rows] += times[used]
        place = np.zeros(len(pieces), np.int32)
        place[used] = rows
        lists = self.lists.take(pa.array(place[codes]))
        self._make_room()
        return lists.flatten().to_numpy(), lists.offsets.to_numpy()[ends].astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), and where each text's begin, one more at the end. A text that is longer than a step stands alone."""
        if not len(texts):
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        if len(texts) > 1 or len(texts[0].as_buffer()) <= self.step:
            return self._step(texts)
        ids = np.concatenate([self._step(pa.array([part]))[0] for part in chunks(texts[0].as_py(), self.step)])
        return ids, np.array([0, len(ids)])
