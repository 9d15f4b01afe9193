"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  In each round every word's
lowest-rank adjacent pair is found (ranks come from a binary search over sorted
pair keys) and merged; words without a known pair leave the array.  Only pairs
next to a merge are searched again.

A merge whose product takes part in no pair of a lower rank cannot be overtaken,
so all its occurrences in a word merge in one round, left to right; any other
pair merges one occurrence at a time.  Both give what a priority queue gives.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import string_buffers, trim, within
from .vocab import Memory, Vocabulary, library_tables, load, ship, unknown_signs

_NONE = np.int64(1) << 40
#: White space for Python's split() that is no white space for the pattern.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SOLID = regex.compile(r"\P{White_Space}+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


class Merger:
    """Merge rounds over flat symbol arrays."""

    def __init__(self, v: Vocabulary):
        self.v = v
        size = len(v.tokens)
        key = v.left * size + v.right
        order = np.argsort(key, kind="stable")
        self.size, self.keys, self.rank, self.made = size, key[order], order.astype(np.int64), v.made
        lowest = np.full(size, _NONE)
        for side in (v.left, v.right):
            np.minimum.at(lowest, side, np.arange(len(side)))
        self.safe = lowest[v.made] > np.arange(len(v.made))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's offset in it (n + 1 entries)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.v.first[raw]
        ends = np.cumsum(lengths)
        full = lengths > 0
        sym[ends[full] - 1] = self.v.last[raw[ends[full] - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            inside = word[:-1] == word[1:]
            at = np.flatnonzero(inside)
            rank[at] = self.ranks(sym[at], sym[at + 1])
        done_sym, done_word = [], []
        while len(sym):
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, begins)
            spans = np.diff(np.r_[begins, len(sym)])
            alive = least < _NONE
            if not alive.all():
                stay = np.repeat(alive, spans)
                done_sym.append(sym[~stay])
                done_word.append(word[~stay])
                sym, word, rank = sym[stay], word[stay], rank[stay]
                least, spans = least[alive], spans[alive]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, spans))
            # pairs that overlap (x, x, x): every second one of a run merges
            run = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1])
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            hit = hit[np.where(self.safe[rank[hit]], nth % 2 == 0, first)]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            rank[hit] = _NONE
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = hit - np.arange(len(hit))
            near = np.concatenate([at, at[at > 0] - 1])
            near = near[near < len(sym) - 1]
            same = word[near] == word[near + 1]
            rank[near[~same]] = _NONE
            rank[at[at == len(sym) - 1]] = _NONE
            near = near[same]
            rank[near] = self.ranks(sym[near], sym[near + 1])
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(words))
        return sym[order], np.r_[0, np.cumsum(counts)]


def lower_nfc(s: str) -> str:
    """NFC, then lower case letter by letter (no final-sigma rule)."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFC", s)
    if "Σ" in s:
        s = s.replace("Σ", "σ")
    return s.lower()


class Codec:
    """Texts to ids and back for a lower-case vocabulary with word ends."""

    def __init__(self, data: bytes):
        self.data, self.v = data, load(data)
        self.merger = Merger(self.v)
        self.chunks = Memory()
        self.names = self.v.tokens
        self.numbers = [str(i) for i in range(len(self.names))]

    def split(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return _SOLID.findall(text)
        return text.split()

    def pieces(self, chunk: str) -> list[str]:
        """Lower-case pieces; signs newer than Python's tables are left to the library's."""
        if unknown_signs(chunk):
            return library_tables(self.data).pieces(chunk)
        return _PIECES.findall(lower_nfc(chunk))

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids (little-endian 32-bit) of chunks free of white space."""
        plan, wanted = [], {}
        special = self.v.special_pattern
        for chunk in new:
            parts: list = []
            if special is not None and "<|" in chunk and special.search(chunk):
                at = 0
                for m in special.finditer(chunk):
                    parts += self.pieces(chunk[at : m.start()])
                    parts.append(self.v.special[m[0]])
                    at = m.end()
                parts += self.pieces(chunk[at:])
            else:
                parts = self.pieces(chunk)
            plan.append(parts)
            for p in parts:
                if isinstance(p, str):
                    wanted[p] = None
        got: dict = {}
        if wanted:
            ids, at = self.merger.encode([p.encode() for p in wanted])
            packed = ids.astype("<u4").tobytes()
            at = (at * 4).tolist()
            got = {p: packed[at[i] : at[i + 1]] for i, p in enumerate(wanted)}
        got.update((i, i.to_bytes(4, "little")) for i in self.v.special.values())
        return {c: got[parts[0]] if len(parts) == 1 else b"".join([got[p] for p in parts]) for c, parts in zip(new, plan, strict=True)}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text as the vocabulary's library gives them; null is empty."""
        split = [self.split(t) if t else [] for t in texts]
        memo = self.chunks
        memo.room()
        new: set[str] = set()
        for s in split:
            new.update([w for w in s if w not in memo])
        if new:
            memo.update(self.learn(list(new)))
        get = memo.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), "<u4") for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by one space: these files name no decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))

    def digits(self, ids: np.ndarray) -> str:
        return " ".join(map(self.numbers.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(data: bytes) -> Codec:
    return Codec(data)


def text_slices(batch: pa.RecordBatch, column: str):
    """(sub-batch, its texts) in slices of about a megabyte."""
    from .common import row_slices

    _, offsets = string_buffers(batch.column(column))
    for i, j in row_slices(offsets):
        part = batch.slice(i, j - i)
        yield part, part.column(column).to_pylist()


def bpe_encode(df: DataFrame, vocab_path: str, text: str = "text", digests: bool = False, decode: bool = False, ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Encode the whole of column ``text``; returns the kept input columns and

    - ``n_tokens`` long,
    - ``ids`` array<int> (``ids``),
    - ``decoded`` string (``decode``): the ids decoded again,
    - ``ids_sha256``, ``decoded_sha256`` (``digests``): of the decimal ids joined
      by a space and of the decoded text.

    A null or empty text has no ids and decodes to the empty text.  Repeated rows
    each get their row.  ``keep`` names the input columns to return (default all);
    one that shares a result's name gives way to the result.  One narrow pass: no
    shuffle, and a lost task is simply run again.
    """
    fields = [T.StructField("n_tokens", T.LongType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if decode:
        fields.append(T.StructField("decoded", T.StringType()))
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    names = [f.name for f in fields]
    kept = within(df, names, keep)
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    source = df.select(*kept, *([df[text].alias("__text")]))
    data = ship(df.sparkSession, vocab_path)

    def run(batches):
        c = codec(data.value)
        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                got = c.encode(texts)
                out = [part.column(k) for k in kept]
                out.append(pa.array([len(x) for x in got], pa.int64()))
                if ids:
                    at = np.r_[0, np.cumsum([len(x) for x in got])].astype(np.int32)
                    flat = np.concatenate(got) if got else np.zeros(0, "<u4")
                    out.append(pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32))))
                back = [c.decode(x) for x in got] if decode or digests else []
                if decode:
                    out.append(pa.array(back, pa.string()))
                if digests:
                    out.append(pa.array([hashlib.sha256(c.digits(x).encode()).hexdigest() for x in got], pa.string()))
                    out.append(pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[*kept, *names])
        trim()

    return source.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, vocab_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of the id array in column ``ids`` (null: null)."""
    kept = within(df, ["decoded"])
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("decoded", T.StringType())])
    source = df.select(*kept, df[ids].alias("__ids"))
    data = ship(df.sparkSession, vocab_path)

    def run(batches):
        c = codec(data.value)
        for batch in batches:
            back = [None if x is None else " ".join([c.names[i] for i in x]) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(back, pa.string())], names=[*kept, "decoded"])

    return source.mapInArrow(run, schema)
