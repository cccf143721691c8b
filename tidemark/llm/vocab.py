"""Vocabularies of merge files: the ids that the library reading them gives, without its encoder.

Both kinds reuse the merging of ``bpe``: a table of pairs by merge order, start symbols, and a
pattern that splits a string into words. Pattern, normalisers and special strings are those of the
file. ``tests/llm`` holds the ids against the library's.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .bpe import ByteCoder, ChunkEncoder, PairTable, _Memory

#: Fixed value: the pattern that a byte-level splitter uses where its file names none.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1,
    else the next free character from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def _lower(text: str) -> str:
    # a final sigma is lowered by its surroundings in Python, not in the library
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def _normaliser(spec: dict | None) -> list[Callable[[str], str]]:
    if spec is None:
        return []
    kind = spec["type"]
    if kind == "Sequence":
        return [step for part in spec["normalizers"] for step in _normaliser(part)]
    if kind == "NFC":
        return [lambda t: t if t.isascii() else unicodedata.normalize("NFC", t)]
    if kind == "Lowercase":
        return [_lower]
    if kind == "Replace" and spec["pattern"] == {"Regex": r"\s+"} and spec["content"] == " ":
        return []  # the pattern below drops white space of any kind
    raise ValueError(f"normaliser {spec} is not supported")


def _pattern(spec: dict) -> tuple[str, bool]:
    """The pattern of matches, and whether they can hold white space."""
    if spec["type"] == "ByteLevel" and spec["use_regex"] and not spec["add_prefix_space"]:
        return BYTE_LEVEL, True
    if spec["type"] == "Sequence" and [p["type"] for p in spec["pretokenizers"]] == ["Split", "ByteLevel"]:
        cut, level = spec["pretokenizers"]
        if cut["behavior"] == "Removed" and cut["invert"] and not level["use_regex"] and not level["add_prefix_space"]:
            return cut["pattern"]["Regex"], False
    raise ValueError(f"splitter {spec} is not supported")


class MergeCoder(ByteCoder):
    """Ids by a merge list. Special strings in a text get their own ids, as the library gives them
    by default; with ``special`` false they are ordinary text."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        ids, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # a merged symbol keeps the suffix of its right part only
        table = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        left, right, merged = (np.array(x, np.int64) for x in zip(*table))
        self.table = PairTable(left, right, np.arange(len(table)), merged)
        self.start = np.array([ids[c] for c in byte_characters()], np.int64)
        self.last = np.array([ids[c + self.suffix] for c in byte_characters()], np.int64)
        self.ranks, self.bytes_of = {}, [b""] * (max(ids.values()) + 1)
        pattern, self.takes_space = _pattern(whole["pre_tokenizer"])
        self.steps = _normaliser(whole["normalizer"])
        if self.takes_space and whole["normalizer"]:
            raise ValueError("a normaliser before a pattern that keeps white space is not supported")
        added = whole["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with conditions are not supported")
        self.special = {t["content"]: t["id"] for t in added if special or not t["special"]}
        self.pieces = regex.compile(pattern)
        self.memory = _Memory(self.words)

    def symbols(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = self.start[raw]
        if self.suffix:
            last = np.cumsum(lengths) - 1
            out[last] = self.last[raw[last]]
        return out

    def plain(self, text: str) -> str:
        for step in self.steps:
            text = step(text)
        return text

    def plain_letters(self, runs: pa.Array) -> pa.Array:
        return pc.utf8_lower(runs) if _lower in self.steps else runs


@functools.lru_cache(maxsize=2)
def merge_encoder(path: str, special: bool = True) -> ChunkEncoder:
    return ChunkEncoder(MergeCoder(path, special))
