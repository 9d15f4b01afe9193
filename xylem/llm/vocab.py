"""Public tokenizer files as plain tables: symbols, pair ranks, special strings.

A file's path is always a parameter.  The driver reads it once and ships the
bytes (size-checked) to the executors, so no executor needs the path.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import SparkSession

from ..session import ship_package

#: Largest vocabulary file that is shipped to executors.
MAX_VOCAB_BYTES = 64 << 20
#: Distinct strings remembered by one Python worker before its memory is renewed.
CACHE_ENTRIES = 400_000


def ship(spark: SparkSession, path: str):
    """Broadcast a tokenizer file's bytes; refuses files beyond MAX_VOCAB_BYTES."""
    ship_package(spark)
    with open(path, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path}: larger than {MAX_VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Code points of the basic plane that Python's tables do not know."""
    odd = [c for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Cn"]
    spans: list[list[int]] = []
    for c in odd:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans) + "]")


def unknown_signs(text: str) -> bool:
    """True if a sign is of a Unicode version that Python's tables may not agree on."""
    if text.isascii():
        return False
    return _unassigned().search(text) is not None or any(unicodedata.category(c) == "Cn" for c in _ASTRAL.findall(text))


class LibraryTables:
    """Normalised pieces by the library's own character tables: for texts with unknown signs."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(data.decode())

    def pieces(self, text: str) -> list[str]:
        if self.t.normalizer is not None:
            text = self.t.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.t.pre_tokenizer.pre_tokenize_str(text)] if text else []


@lru_cache(maxsize=2)
def library_tables(data: bytes) -> LibraryTables:
    return LibraryTables(data)


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte used by byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Vocabulary:
    """Merge tables of a byte-level BPE file of the tokenizers library."""

    def __init__(self, data: bytes):
        j = json.loads(data)
        model = j["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        shown = byte_symbols()
        self.first = np.array([self.ids[c] for c in shown], dtype=np.int64)
        self.last = np.array([self.ids[c + self.suffix] for c in shown], dtype=np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([self.ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([self.ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], dtype=np.int64)
        self.left, self.right, self.made = left, right, made
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None


@lru_cache(maxsize=4)
def load(data: bytes) -> Vocabulary:
    return Vocabulary(data)


class Memory(dict):
    """A bounded memo: when full it is emptied, which changes speed only."""

    def __init__(self, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.limit = limit

    def room(self) -> None:
        if len(self) > self.limit:
            self.clear()
