"""Byte-level BPE vocabularies in the JSON format of the tokenizers library."""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such a file: itself where it is printable, else the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The tokens of the file: bytes and ids, merges as pairs of ids by the id that they make, and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-level BPE without a normalizer or a prefix space is supported")
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        # Texts are cut before spaces, so a special string must hold none and reach for none.
        for x in spec.get("added_tokens", []):
            if any(map(str.isspace, x["content"])) or x.get("lstrip") or x.get("rstrip") or x.get("single_word"):
                raise ValueError(f"{path}: special strings with white space, or that depend on what stands beside them, are not supported")
        self.by_id: dict[int, bytes] = {k: bytes(letters[c] for c in t) for t, k in model["vocab"].items() if t not in self.special}
        own = {v: k for k, v in self.by_id.items()}
        self.ranks = own
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (bytes(letters[c] for c in x) for x in (a, b))
            if own[a + b] != 256 + rank:
                raise ValueError(f"{path}: ids must follow the order of merges")
            self.merges[256 + rank] = (own[a], own[b])

    @cached_property
    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes one after another, and where each id's begin, one more at the end; special strings included."""
        tokens = self.by_id | {k: t.encode() for t, k in self.special.items()}
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        ends = np.cumsum([0, *map(len, parts)])
        return np.frombuffer(b"".join(parts), np.uint8), ends


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
