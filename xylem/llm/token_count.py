"""Token counts by heap-and-linked-list byte-pair merging.

A piece's symbols form a linked list; a heap holds its known adjacent pairs by
(rank, position).  The lowest is popped again and again and merged, stale entries
are passed over, and the count is the initial symbols minus the merges: no id is
ever emitted.  Counts of text units are remembered, so each distinct unit is
merged about once per worker.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import row_slices, string_buffers, within
from .vocab import CACHE_ENTRIES, Memory, Vocabulary, library_tables, load, ship, unknown_signs

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


class Counter:
    def __init__(self, v: Vocabulary, data: bytes):
        self.data = data
        self.special, self.pattern = v.special, v.special_pattern
        shift = len(v.tokens).bit_length()
        self.shift = shift
        self.pairs = {int(a) << shift | int(b): (r, int(m)) for r, (a, b, m) in enumerate(zip(v.left, v.right, v.made, strict=True))}
        self.first = v.first.tolist()
        self.last = v.last.tolist()
        self.units, self.pieces = Memory(), Memory(CACHE_ENTRIES // 3)

    def merged(self, piece: bytes) -> int:
        """Number of tokens of one piece."""
        n = len(piece)
        first, pairs, shift = self.first, self.pairs, self.shift
        sym = [first[b] for b in piece]
        sym[-1] = self.last[piece[-1]]
        if n < 2:
            return n
        heap, at = [], 0
        find = pairs.get
        for a, b in zip(sym, sym[1:]):
            if (p := find(a << shift | b)) is not None:
                heap.append((p[0], at, a, b, p[1]))
            at += 1
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left = n
        while heap:
            _, i, a, b, made = heappop(heap)
            if sym[i] != a:
                continue
            j = after[i]
            if j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                c = sym[k]
                if (p := find(made << shift | c)) is not None:
                    heappush(heap, (p[0], i, made, c, p[1]))
            h = before[i]
            if h >= 0:
                c = sym[h]
                if (p := find(c << shift | made)) is not None:
                    heappush(heap, (p[0], h, c, made, p[1]))
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings, taken piece by piece."""
        total, known = 0, self.pieces
        # signs newer than Python's tables are left to the library's
        for p in library_tables(self.data).pieces(text) if unknown_signs(text) else _PIECES.findall(text):
            c = known.get(p)
            if c is None:
                c = known[p] = self.merged(p.encode())
            total += c
        return total

    def whole(self, text: str) -> int:
        if self.pattern is None or "<|" not in text:
            return self.plain(text)
        total = at = 0
        for m in self.pattern.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])

    def count(self, text: str | None, simple: bool) -> int:
        """``simple``: white space is single blanks or line feeds between solid characters.

        Such a text falls into units that begin at a blank or a line feed; no piece
        crosses a unit's border, so remembered counts of units add up.
        """
        if not text:
            return 0
        if not simple or "<|" in text or unknown_signs(text):
            return self.whole(text)
        units = text.replace("\n", " \n").split(" ")
        total = self.plain(units[0])
        del units[0]
        known = self.units
        try:
            return total + sum(map(known.__getitem__, units))
        except KeyError:
            pass
        for u in units:
            c = known.get(u)
            if c is None:
                c = known[u] = self.plain(u if u[0] == "\n" else " " + u)
            total += c
        return total


@lru_cache(maxsize=2)
def counter(data: bytes) -> Counter:
    return Counter(load(data), data)


def simple_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows whose white space is single blanks or line feeds between ASCII-known solids.

    Bytes that may begin other white space (C2 85/A0, E1, E2, E3) are left to a
    closer look by the caller.
    """
    n = len(offsets) - 1
    ok = np.ones(n, bool)
    if not len(raw):
        return ok
    soft = (raw == 0x20) | (raw == 0x0A)
    bad = soft[1:] & soft[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    at = firsts[1:] - 1
    bad[at] = False  # two rows meet here
    wrong = np.zeros(len(raw), bool)
    wrong[1:] = bad
    wrong |= ((raw >= 0x09) & (raw <= 0x0D) & (raw != 0x0A)) | ((raw >= 0x1C) & (raw <= 0x1F))
    wrong |= (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3)
    c2 = np.flatnonzero(raw == 0xC2)
    c2 = c2[c2 + 1 < len(raw)]
    wrong[c2[(raw[c2 + 1] == 0x85) | (raw[c2 + 1] == 0xA0)]] = True
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    wrong[firsts] |= soft[firsts]
    wrong[ends] |= soft[ends]
    hit = np.flatnonzero(wrong)
    ok[np.searchsorted(offsets, hit, side="right") - 1] = False
    return ok


def token_counts(df: DataFrame, vocab_path: str, text: str = "text", limit: int = 512, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    Counts are those of the byte-level vocabulary at ``vocab_path`` over the whole
    text, special strings counting as one token; a null or empty text has none.
    Every row gives one row.  ``keep`` names the input columns to return (default
    all but those named like a result).  One narrow pass without shuffle.
    """
    names = ["n_bytes", "n_tokens", "over_limit"]
    kept = within(df, names, keep)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    source = df.select(*kept, df[text].alias("__text"))
    data = ship(df.sparkSession, vocab_path)

    def run(batches):
        c = counter(data.value)
        for batch in batches:
            raw, offsets = string_buffers(batch.column("__text"))
            for i, j in row_slices(offsets):
                part = batch.slice(i, j - i)
                at = offsets[i : j + 1] - offsets[i]
                easy = simple_rows(raw[offsets[i] : offsets[j]], at)
                texts = part.column("__text").to_pylist()
                counts = np.fromiter((c.count(t, e) for t, e in zip(texts, easy.tolist(), strict=True)), np.int64, j - i)
                c.units.room()
                c.pieces.room()
                out = [pa.array(np.diff(at)), pa.array(counts), pa.array(counts > limit)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *out], names=[*kept, *names])

    return source.mapInArrow(run, schema)
