"""Token-id files compressed by Re-Pair grammars, one grammar per shard.

A shard is a run of documents in ascending id order.  Frequent adjacent id pairs
are replaced by nonterminals again and again; a document's end id takes part in
no pair, so no rule crosses a document and each can be decoded alone.

Shard layout (little endian): magic ``XYRP`` and version, then the counts and the
array widths as a header of 64-bit integers, then the arrays,
each padded to a multiple of eight bytes

- ``doc_id``  int64, ``valid`` uint8 (0: the id is null),
- ``symbols`` uint32: grammar symbols of each document,
- ``tokens``  uint32: ids of each document, its end id included,
- ``rules``   pairs of symbols, ``expand`` uint32: expansion length of each rule,
- ``body``    the symbols of all documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import block_count, checkpoint_dir, lanes, row_slices, same_spans, span_hashes, string_buffers, trim, whole_number, word_bounds
from .vocab import ship

MAGIC, VERSION = b"XYRP", 1
#: Ids gathered before a shard is closed (a longer document is still kept whole).
SHARD_IDS = 2 << 20
#: Rules added by one round at most.
ROUND_RULES = 8000
#: Share of the symbols that the last round with narrow symbols may leave.
GIVE_UP = 0.82
#: Uses that pay for a rule (two symbols and its length), by the bytes of a symbol.
LEAST_USES = {2: 5, 4: 4}
#: A control character: a piece, and a token, of its own.
_APART = "\x01"
#: Distinct chunks remembered by a worker: about 60 bytes each.
_CHUNKS = 3_000_000
_HEADER = struct.Struct("<4sI6q")  # 56 bytes


def grammar(ids: np.ndarray, base: int, end: int, per_round: int = ROUND_RULES, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rules, body): Re-Pair over ``ids``; symbol ``base + i`` stands for ``rules[i]``.

    Rounds go on until no pair is used often enough to pay for its rule.  Where symbols of
    two bytes run out, they go on with four bytes, unless the last round says that pairs are
    too rare by then to make up for that (it left more than ``GIVE_UP`` of the body); the
    smaller result counts.
    """
    if base >= 1 << 16:
        return _rounds(ids, [], base, end, 4, per_round, least)[:2]
    rules, body, left = _rounds(ids, [], base, end, 2, per_round, least)
    if left <= GIVE_UP:
        more, rest, _ = _rounds(body, [rules], base, end, 4, per_round, least)
        if 4 * len(rest) + 12 * len(more) < 2 * len(body) + 8 * len(rules):
            return more, rest
    return rules, body


def _rounds(seq: np.ndarray, rules: list[np.ndarray], base: int, end: int, width: int, per_round: int, least: int | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Rules and body with symbols of ``width`` bytes; if these ran out, what the last round left.

    Each round replaces the most frequent pairs together.  Where pairs overlap, the
    left one goes first.
    """
    narrow = width == 2
    least = least or LEAST_USES[width]
    room = (1 << 16) - 1 - base if narrow else (1 << 31) - base
    kind, shift, none = (np.uint32, np.uint32(16), np.uint32(0xFFFFFFFF)) if narrow else (np.uint64, np.uint64(32), np.uint64((1 << 64) - 1))
    seq = seq.astype(kind)
    rules = [r.astype(kind) for r in rules]
    made = sum(map(len, rules))
    left, full = 1.0, False
    while True:
        take = min(per_round, room - made)
        full = take <= 0
        if len(seq) < 2 or take <= 0:
            break
        key = seq[:-1] << shift
        key |= seq[1:]
        stop = np.flatnonzero(seq == kind(end))
        key[stop[stop < len(key)]] = none
        key[stop[stop > 0] - 1] = none
        k = np.sort(key)
        at = np.flatnonzero(k[1:] != k[:-1]) + 1
        at = np.concatenate([[0], at])
        uses = np.diff(np.append(at, len(k)))
        good = np.flatnonzero((uses >= least) & (k[at] != none))
        if len(good) > take:
            good = good[np.argpartition(-uses[good], take - 1)[:take]]
        if not len(good):
            break
        # a direct-address table of the chosen pairs; of two in one slot, one waits
        if narrow:
            spot = lambda x: (x * np.uint32(0x9E3779B1)) >> np.uint32(14)
        else:
            spot = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
        chosen = k[at[good]]
        table = np.full(1 << 18, -1, np.int32)
        table[spot(chosen)] = np.arange(len(chosen))
        chosen = chosen[np.sort(table[table >= 0])]
        table[:] = 0
        table[spot(chosen)] = np.arange(len(chosen))
        rule = table[spot(key)]
        hit = np.flatnonzero(chosen[rule] == key)
        # of overlapping pairs every second one of a run is replaced
        run = np.flatnonzero(hit[1:] != hit[:-1] + 1) + 1
        run = np.concatenate([[0], run])
        nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
        hit = hit[(nth & 1) == 0]
        seq[hit] = (rule[hit] + (base + made)).astype(kind)
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        before, seq = len(seq), seq[keep]
        rules.append(np.stack([chosen >> shift, chosen & kind((1 << int(shift)) - 1)], axis=1))
        made += len(chosen)
        left = len(seq) / before if take == per_round else left
    return (np.concatenate(rules) if rules else np.zeros((0, 2), kind)), seq, left if full else 1.0


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each rule (rules refer to earlier rules only)."""
    out = np.zeros(len(rules), np.int64)
    size = lambda s: np.where(s < base, 1, out[np.maximum(s - base, 0)])
    todo = np.arange(len(rules))
    r = rules.astype(np.int64)
    while len(todo):
        a, b = size(r[todo, 0]), size(r[todo, 1])
        ok = (a > 0) & (b > 0)
        out[todo[ok]] = (a + b)[ok]
        todo = todo[~ok]
    return out


def expand(body: np.ndarray, rules: np.ndarray, length: np.ndarray, base: int) -> np.ndarray:
    """Ids that ``body`` stands for."""
    body = body.astype(np.int64)
    if not len(rules):
        return body.astype(np.uint32)
    start = np.r_[0, np.cumsum(length)[:-1]]
    flat = np.zeros(int(length.sum()), np.uint32)
    r = rules.astype(np.int64)
    for i in range(2):
        # left halves, then right halves, of rules whose parts are plain ids
        part = r[:, i]
        off = start if i == 0 else start + np.where(r[:, 0] < base, 1, length[np.maximum(r[:, 0] - base, 0)])
        plain = part < base
        flat[off[plain]] = part[plain]
        r_off = off[~plain], part[~plain] - base
        if i == 0:
            nested = [r_off]
        else:
            nested.append(r_off)
    # copy nested expansions from the innermost outwards: by the rule's own number
    offs = np.concatenate([n[0] for n in nested])
    refs = np.concatenate([n[1] for n in nested])
    owner = np.searchsorted(start, offs, side="right") - 1
    depth = np.ones(len(rules), np.int64)
    order = np.argsort(owner, kind="stable")
    for o, c in zip(owner[order].tolist(), refs[order].tolist(), strict=True):
        if depth[c] + 1 > depth[o]:
            depth[o] = depth[c] + 1
    for level in range(2, int(depth.max(initial=1)) + 1):
        now = depth[owner] == level
        n = length[refs[now]]
        pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat[np.repeat(offs[now], n) + pos] = flat[np.repeat(start[refs[now]], n) + pos]
    is_rule = body >= base
    n = np.ones(len(body), np.int64)
    n[is_rule] = length[body[is_rule] - base]
    table = np.concatenate([np.arange(base, dtype=np.uint32), flat])
    where = np.where(is_rule, base + start[np.where(is_rule, body - base, 0)], body)
    ends = np.cumsum(n)
    return table[np.repeat(where - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def pack(doc_ids: list, tokens: np.ndarray, ids: np.ndarray, base: int, end: int) -> bytes:
    rules, body = grammar(ids, base, end)
    length = expansions(rules, base)
    # symbols of each document: none crosses its end (texts may hold the end's id too)
    size = np.ones(len(body), np.int64)
    nested = np.flatnonzero(body >= base)
    size[nested] = length[body[nested].astype(np.int64) - base]
    symbols = np.diff(np.r_[0, np.searchsorted(np.cumsum(size), np.cumsum(tokens)) + 1])
    wide = np.dtype("<u2") if base + len(rules) <= 1 << 16 else np.dtype("<u4")
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    head = _HEADER.pack(MAGIC, VERSION, len(doc_ids), len(rules), len(body), int(tokens.sum()), base, wide.itemsize)
    return head + b"".join(
        (raw := a.tobytes()) + bytes(-len(raw) % 8)
        for a in (np.array([d or 0 for d in doc_ids], "<i8"), valid, symbols.astype("<u4"), tokens.astype("<u4"), rules.astype(wide), length.astype("<u4"), body.astype(wide))
    )


class Shard:
    """A shard's arrays; documents decode one by one or all together."""

    def __init__(self, blob: bytes):
        magic, version, docs, rules, body, self.n_ids, self.base, width = _HEADER.unpack_from(blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard")
        at = _HEADER.size
        wide = np.dtype(f"<u{width}")

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += -(-out.nbytes // 8) * 8
            return out

        self.doc_id, self.valid = take("<i8", docs), take("u1", docs)
        self.symbols, self.tokens = take("<u4", docs), take("<u4", docs)
        self.rules = take(wide, 2 * rules).reshape(-1, 2)
        self.length = take("<u4", rules).astype(np.int64)
        self.body = take(wide, body)

    def all(self) -> np.ndarray:
        return expand(self.body, self.rules, self.length, self.base)

    def one(self, i: int) -> np.ndarray:
        """Ids of document ``i`` alone."""
        at = int(self.symbols[:i].sum())
        return expand(self.body[at : at + int(self.symbols[i])], self.rules, self.length, self.base)


class Slots:
    """Open-addressing table from 64-bit keys to slot numbers, by whole arrays."""

    def __init__(self, bits: int):
        self.bits, self.shift = bits, np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not there.  No key is zero."""
        at = (h >> self.shift).astype(np.int32)
        got = self.keys[at]
        out = np.where(got == h, at, np.int32(-1))
        todo = np.flatnonzero((got != h) & (got != 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            got, key = self.keys[at], h[todo]
            hit = got == key
            out[todo[hit]] = at[hit]
            on = ~hit & (got != 0)
            todo, at = todo[on], at[on]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Slots for keys that are distinct and not there yet."""
        at = (h >> self.shift).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            spot = at[todo]
            free = self.keys[spot] == 0
            self.keys[spot[free]] = h[todo[free]]  # of several, the last one stays
            on = self.keys[spot] != h[todo]
            todo = todo[on]
            at[todo] = (at[todo] + 1) & self.mask
        return at


class LibraryCodec:
    """Whole texts by the tokenizers library, each distinct chunk encoded about once.

    The vocabulary's pattern drops white space and no piece crosses it, so a text's
    ids are those of its chunks (runs of bytes between ASCII white space) in order;
    white space beyond ASCII stays inside a chunk and is left to the library.  Chunks
    are looked up by a 64-bit hash, a slice of documents at a time, and their bytes are
    compared with those remembered; rows with another chunk of the same hash are encoded
    whole by the library.
    """

    def __init__(self, data: bytes, chunks: int = _CHUNKS):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(data.decode())
        self.t.no_truncation()
        self.t.no_padding()
        self.vocab = self.t.get_vocab_size(with_added_tokens=True)
        self.mark = self.t.encode(_APART, add_special_tokens=False).ids[0]
        self.limit, self.bits = chunks, chunks.bit_length()
        self.kind = np.uint16 if self.vocab <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.slots = Slots(self.bits)
        self.start = np.zeros(1 << self.bits, np.int32)
        self.count = np.zeros(1 << self.bits, np.int32)
        self.pool = np.zeros(1 << 20, self.kind)
        # bytes of the chunks themselves, with room for a look at eight of them
        self.spot = np.zeros(1 << self.bits, np.uint32)
        self.size = np.zeros(1 << self.bits, np.uint32)
        self.text = np.zeros(1 << 22, np.uint8)
        self.used = self.known = self.filled = 0

    def ask(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, number of each): many a call, set apart by a piece of their own."""
        odd = {i: self.t.encode(w, add_special_tokens=False).ids for i, w in enumerate(new) if _APART in w}
        plain = [i for i in range(len(new)) if i not in odd]
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        got = self.t.encode_batch_fast([f" {_APART} ".join([new[i] for i in g]) for g in groups], add_special_tokens=False)
        count = np.zeros(len(new), np.int64)
        parts = []
        for group, enc in zip(groups, got, strict=True):
            ids = np.array(enc.ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark)
            count[group] = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
            parts.append(ids[ids != self.mark])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if odd:
            at = np.cumsum(count)
            rows = np.split(flat, at[:-1])
            for i, ids in odd.items():
                rows[i], count[i] = np.array(ids, np.uint32), len(ids)
            flat = np.concatenate(rows)
        return flat, count

    def learn(self, h: np.ndarray, words: list[bytes]) -> None:
        flat, count = self.ask([w.decode() for w in words])
        sizes = np.array([len(w) for w in words], np.int64)
        need = self.filled + int(sizes.sum()) + 16
        if need > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(max(need - len(self.text), len(self.text) // 2), np.uint8)])
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(flat), len(self.pool) // 2), self.kind)])
        at = self.slots.add(h)
        self.start[at] = self.used + np.cumsum(count) - count
        self.count[at] = count
        self.spot[at], self.size[at] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.text[self.filled : self.filled + int(sizes.sum())] = np.frombuffer(b"".join(words), np.uint8)
        self.filled += int(sizes.sum())
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known += len(h)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of each row) of texts given by their UTF-8 bytes."""
        if self.known > self.limit // 2:
            self.clear()
        starts, ends, first = word_bounds(raw, offsets)
        h = span_hashes(raw, starts, ends)
        h[h == 0] = 1  # no key is zero
        at = self.slots.find(h)
        gap = np.flatnonzero(at < 0)
        if len(gap):
            new, where = np.unique(h[gap], return_index=True)
            spot = gap[where]
            text = raw.tobytes()
            # more new chunks than fit: in the end all are known, whatever the limit
            if self.known + len(new) > self.limit:
                self.clear()
                new, where = np.unique(h, return_index=True)
                spot = where
                if len(new) > self.limit:
                    self.bits = (2 * len(new)).bit_length()
                    self.clear()
            self.learn(new, [text[a:b] for a, b in zip(starts[spot].tolist(), ends[spot].tolist(), strict=True)])
            at = self.slots.find(h)
        n = self.count[at]
        stop = np.cumsum(n, dtype=np.int64)
        total = int(stop[-1]) if len(stop) else 0
        # each chunk's place in the pool, counted on from where its ids go
        lag = self.start[at] - (stop - n)
        ids = self.pool[np.repeat(lag, n) + np.arange(total)]
        per = np.diff(np.concatenate([[0], stop])[first])
        size = ends - starts
        same = size == self.size[at]
        # up to eight bytes, equal sizes and hashes are equal bytes
        near = np.flatnonzero(same & ((size > 8) | (h == 1)))
        same[near] = same_spans(lanes(raw), starts[near], np.ndarray(len(self.text) - 8, "<u8", self.text, strides=(1,)), self.spot[at[near]], size[near])
        if same.all():
            return ids, per
        rows = np.split(ids, np.cumsum(per)[:-1])
        for i in np.unique(np.searchsorted(first, np.flatnonzero(~same), side="right") - 1).tolist():
            rows[i] = np.array(self.t.encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, self.kind)
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)


@lru_cache(maxsize=2)
def library(data: bytes) -> LibraryCodec:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return LibraryCodec(data)


def write_token_files(df: DataFrame, path: str, vocab_path: str, doc_id: str = "doc_id", text: str = "text", end: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Write every whole text's ids, each document closed by ``end``, in ascending id order.

    The files at ``path`` are a Parquet container of shards: ``part`` and ``before``
    (ids of the same part written before) place a shard, ``payload`` is its layout.
    Null ids come first; rows of one id are ordered by text; a null text has its end
    id only.  One range shuffle of the texts; parts are independent, so a lost task is
    run again alone, and the writer commits whole parts.
    """
    spark = df.sparkSession
    n = block_count(df, 8 << 20, least=4)
    data = ship(spark, vocab_path)
    rows = df.select(whole_number(df, doc_id).alias("doc_id"), df[text].alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        c = library(data.value)
        part = TaskContext.get().partitionId()
        before = held = 0
        docs: list = []
        pieces: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close():
            nonlocal before, held, docs, pieces, sizes
            tokens = np.concatenate(sizes)
            blob = pack(docs, tokens, np.concatenate(pieces), c.vocab, end)
            total = int(tokens.sum())
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([total], pa.int64()), pa.array([blob], pa.binary())], names=["part", "before", "n_ids", "payload"])
            before += total
            held, docs, pieces, sizes = 0, [], [], []
            trim()
            return out

        for batch in batches:
            raw, offsets = string_buffers(batch.column("text"))
            for i, j in row_slices(offsets):
                ids, count = c.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                docs += batch.column("doc_id").slice(i, j - i).to_pylist()
                pieces.append(np.insert(ids, np.cumsum(count), end))
                sizes.append(count + 1)
                held += len(pieces[-1])
                if held >= shard_ids:
                    yield close()
        if docs:
            yield close()

    rows.mapInArrow(run, "part int, before long, n_ids long, payload binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of token files: doc_id, ``start`` (ids before it), n_tokens, ids_crc32 and ``ids``.

    Every row that was written comes back, null and repeated ids included; files of an empty
    table give none.
    """
    ship_package(spark)
    files = spark.read.parquet(path)
    fields = "part int, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches):
        for batch in batches:
            for part, before, blob in zip(*(batch.column(k).to_pylist() for k in ("part", "before", "payload")), strict=True):
                s = Shard(blob)
                flat = s.all()
                tokens = s.tokens.astype(np.int64)
                at = np.r_[0, np.cumsum(tokens)]
                view = memoryview(flat.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out = [pa.array(np.full(len(tokens), part, np.int32)), pa.array(s.doc_id, mask=s.valid == 0), pa.array(before + at[:-1]), pa.array(tokens), pa.array(crc, pa.int64())]
                names = ["part", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    docs = files.select("part", "before", "payload").mapInArrow(run, fields)
    # one row per part: a part holds megabytes of text, so this stays small
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("__ahead"))
    docs = docs.join(parts, "part").withColumn("start", F.col("__ahead") + F.col("inside"))
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
