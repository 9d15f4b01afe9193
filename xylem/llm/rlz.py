"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The reference is the text of all passages that are repeated, each from the first document
that holds it.  A reference block is the part of it that concerns one block of documents,
with an index of its windows of ``k`` words.  Every document is factored against its
block's reference: at a word whose window is indexed a factor ``(source document, source
word, length)`` starts, and grows as long as the words are equal.  Windows that straddle
the border of two factors are looked up on their own, so no repeated window is missed.
Factors of ``k`` words or more are duplicate spans; nothing is cut but by a factor, whose
words were compared one by one.

Which passages are repeated is found by window hashes, dealt out by their top bits: a
block sends each distinct hash once, so a passage that a third of all documents holds is
as many entries as there are blocks.  The holder of a first place then sends the passage
to each block that repeats it, once.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import block_count, bucket_of, ready, row_slices, span_hashes, span_ids, string_buffers, trim, whole_number, window_hashes, within, word_bounds

WINDOW = 13
#: Window hashes are dealt out by their top bits: at least and at most so many.
LEAST_BITS, MOST_BITS = 6, 16
#: Blocks of documents for each share of the hashes; both keep their size as the input grows.
WORK_PER_SHARE = 4
#: Compressed input bytes aimed at for one block of documents.
WORK_BYTES = 5 << 19


def _width(a: np.ndarray) -> np.dtype:
    top = int(a.max(initial=0))
    return np.dtype("<u1") if top < 1 << 8 else np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4") if top < 1 << 32 else np.dtype("<u8")


def _put(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each in the narrowest type that holds it."""
    out = []
    for a in arrays:
        kind = _width(a)
        out += [struct.pack("<BI", kind.itemsize, len(a)), a.astype(kind).tobytes()]
    return b"".join(out)


def _get(blob: bytes, n: int, at: int = 0) -> list[np.ndarray]:
    """The ``n`` arrays at byte ``at``, and the bytes behind them."""
    out: list[np.ndarray] = []
    for _ in range(n):
        width, size = struct.unpack_from("<BI", blob, at)
        at += 5
        out.append(np.frombuffer(blob, f"<u{width}", size, at).astype(np.int64))
        at += width * size
    return [*out, np.frombuffer(blob, np.uint8, -1, at)]


class Windows:
    """Words and windows of the rows of one block."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, k: int):
        place = np.int32 if len(raw) < 1 << 30 else np.int64
        hashes, words, counts, spans = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((2, 0), place)]
        for i, j in row_slices(offsets):
            part = raw[offsets[i] : offsets[j]]
            starts, ends, first = word_bounds(part, offsets[i : j + 1] - offsets[i])
            h = span_hashes(part, starts, ends)
            n = np.diff(first)
            many = np.maximum(n - k + 1, 0)
            at = np.repeat(first[:-1] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum()))
            hashes.append(window_hashes(h, k)[at])
            words.append(h)
            counts.append(n)
            spans.append((np.stack([starts, ends]) + offsets[i]).astype(place))
        self.raw, self.k = raw, k
        # one after the other: parts are freed before the next ones are joined
        self.hashes = np.concatenate(hashes)
        del hashes
        self.word_hashes = np.concatenate(words)
        del words
        self.starts, self.ends = np.concatenate(spans, axis=1)
        del spans
        self.words = np.concatenate(counts)
        self.windows = np.maximum(self.words - k + 1, 0)
        self.row = np.repeat(np.arange(len(self.words), dtype=np.int32), self.windows)
        self.base = np.cumsum(self.windows) - self.windows  # first window and first word of each row
        self.word0 = np.cumsum(self.words) - self.words

    def begin(self, at: np.ndarray) -> np.ndarray:
        """The word that each window starts with."""
        return at - self.base[self.row[at]] + self.word0[self.row[at]]


def _pieces(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several spans, one after the other."""
    total = np.cumsum(size)
    return raw[np.repeat(starts - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]


class Reference:
    """Repeated passages, the documents they come from, and an index of their windows."""

    def __init__(self, doc: np.ndarray, place: np.ndarray, size: np.ndarray, raw: np.ndarray, k: int):
        self.w = Windows(raw, np.r_[0, np.cumsum(size)], k)
        self.doc, self.place = doc, place  # of each passage
        # by hash, then document, then place
        order = np.lexsort((place[self.w.row], doc[self.w.row], self.w.hashes))
        self.keys, self.order = self.w.hashes[order], order


def factorise(w: Windows, doc: np.ndarray, ref: Reference) -> np.ndarray:
    """Factors (row, start, length, passage, word of the passage) of rows against a reference.

    Only passages of documents with a smaller id than the row's are sources; ``doc`` has the
    id of each row that takes part.
    """
    k, use = w.k, int(w.windows[: len(doc)].sum())
    none = np.zeros((0, 5), np.int64)
    if not use or not len(ref.keys):
        return none
    at = np.searchsorted(ref.keys, w.hashes[:use])
    known = np.minimum(at, len(ref.keys) - 1)
    hit = np.flatnonzero((ref.keys[known] == w.hashes[:use]) & (ref.doc[ref.w.row[ref.order[known]]] < doc[w.row[:use]]))
    if not len(hit):
        return none
    # numbers for words, equal where the bytes are: of the rows with hits, and of the passages
    rows = np.unique(w.row[hit])
    mine = np.repeat(w.word0[rows] - (np.cumsum(w.words[rows]) - w.words[rows]), w.words[rows]) + np.arange(int(w.words[rows].sum()))
    own = len(w.raw)
    ids = span_ids(np.concatenate([w.raw, ref.w.raw]), np.concatenate([w.starts[mine], ref.w.starts + own], dtype=np.int64), np.concatenate([w.ends[mine], ref.w.ends + own], dtype=np.int64), np.concatenate([w.word_hashes[mine], ref.w.word_hashes]))
    x = np.full(len(w.starts), -1, np.int64)
    x[mine], y = ids[: len(mine)], ids[len(mine) :]
    a, entry = w.begin(hit), at[hit]
    source = np.full(len(hit), -1, np.int64)
    todo = np.arange(len(hit))
    while len(todo):
        b = ref.w.begin(ref.order[entry[todo]])
        same = np.ones(len(todo), bool)
        for i in range(k):
            same &= x[a[todo] + i] == y[b + i]
        source[todo[same]] = ref.order[entry[todo[same]]]
        # another window may have the same hash: the next entry of the index
        todo = todo[~same]
        entry[todo] += 1
        todo = todo[entry[todo] < len(ref.keys)]
        todo = todo[(ref.keys[entry[todo]] == w.hashes[hit[todo]]) & (ref.doc[ref.w.row[ref.order[entry[todo]]]] < doc[w.row[hit[todo]]])]
    hit, a, source = hit[source >= 0], a[source >= 0], source[source >= 0]
    row, passage, b = w.row[hit], ref.w.row[source], ref.w.begin(source)
    room = np.minimum((w.word0 + w.words)[row] - a, (ref.w.word0 + ref.w.words)[passage] - b)
    out, i, n = [], 0, len(hit)
    starts, froms, rooms = a.tolist(), b.tolist(), room.tolist()
    while i < n:
        p, s, most = starts[i], froms[i], rooms[i]
        length, step = k, 64
        while length < most:
            step = min(step, most - length)
            differ = x[p + length : p + length + step] != y[s + length : s + length + step]
            if differ.any():
                length += int(differ.argmax())
                break
            length, step = length + step, 2 * step
        out.append((i, length))
        # the next window that the factor does not cover as a whole
        i = int(np.searchsorted(a, p + length - k + 1))
    lead, length = np.array(out, np.int64).reshape(-1, 2).T
    return np.stack([row[lead], a[lead] - w.word0[row[lead]], length, passage[lead], b[lead] - ref.w.word0[passage[lead]]], axis=1)


def _ordered(table: pa.Table) -> pa.Table:
    """The rows of a work block in an order of their own: by id, then text."""
    return table.take(pc.sort_indices(table, sort_keys=[("__id", "ascending"), ("__text", "ascending")]))


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, factors: bool = True, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Cut each word covered by a window that also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``; windows are ``window`` consecutive words of one
    row, judged on the input.  Returns the kept input columns (default all) and

    - ``kept_text``: the words left, joined by one blank,
    - ``n_words``, ``n_removed`` long,
    - ``factors``: array of (start, length, source_id, source_start) in words, with
      ``factors``: the spans, each with the first place its words stand.

    A null text has no words and an empty ``kept_text``; shorter texts than a window
    stay whole.  Rows with a null id keep all words and are no source.  Rows of the same
    id are one document for this purpose: they cut nothing from each other.  An input
    column named like a result gives way (``prefix`` renames the results).  Words are compared before anything is cut; a
    cut could be missed only where two different windows share a hash of 62 bits or more.
    """
    names = [prefix + n for n in ["kept_text", "n_words", "n_removed"] + ["factors"] * factors]
    kept = within(df, names, keep)
    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.LongType())]
    if factors:
        fields.append(T.StructField(names[3], T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "source_id", "source_start")]))))
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    n_work = block_count(df, WORK_BYTES)
    bits = min(MOST_BITS, max(LEAST_BITS, (n_work // WORK_PER_SHARE).bit_length()))
    n_ref, shift = 1 << bits, np.uint64(64 - bits)

    ident = whole_number(df, doc_id)
    work = ready(df).select(ident.alias("__id"), df[text].alias("__text"), bucket_of(F.coalesce(ident, F.xxhash64(df[text])), n_work).alias("__work"), *[df[c].alias(f"__c{i}") for i, c in enumerate(kept) if c != text])
    work = work.repartition(n_work, "__work")

    def block(table: pa.Table) -> tuple[pa.Table, Windows, np.ndarray]:
        """A block's rows in order, their windows, and the ids of those that have one."""
        table = _ordered(table)
        ids = table.column("__id").combine_chunks()
        solid = ids.slice(0, len(ids) - ids.null_count)  # nulls sort last
        return table, Windows(*string_buffers(table.column("__text")), window), np.asarray(solid).astype(np.int64)

    def send(table: pa.Table) -> pa.Table:
        """To each share of the hashes: a block's distinct ones, where each stands first."""
        mine = table.column("__work")[0].as_py()
        _, w, doc = block(table)
        use = int(w.windows[: len(doc)].sum())
        row = w.row[:use]
        order = np.argsort(w.hashes[:use], kind="stable")
        hs = w.hashes[order]
        edge = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]]) if use else np.zeros(0, np.int64)
        # rows are in the order of their ids: the first of a hash has the least one
        lead, last = order[edge], order[np.r_[edge[1:], use][: len(edge)] - 1]
        again = doc[row[last]] > doc[row[lead]]
        cut = np.searchsorted((hs[edge] >> shift).astype(np.int64), np.arange(n_ref + 1))
        least = int(doc.min(initial=0)) if len(doc) else 0
        out = []
        for b in range(n_ref):
            i, j = int(cut[b]), int(cut[b + 1])
            if i == j:
                continue
            by = np.argsort(lead[i:j])
            at, more = lead[i:j][by], again[i:j][by]
            r = row[at]
            edge_r = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            # of rows that have windows here: ids, numbers of windows, places in the block;
            # of each window: how far behind the row's last one it starts
            place = at - w.base[r]
            step = place.copy()
            step[1:] -= place[:-1]
            step[edge_r] = place[edge_r]
            head = struct.pack("<q", least) + _put(np.diff(np.r_[0, doc[r[edge_r]] - least]), np.diff(np.r_[edge_r, len(r)]), np.diff(np.r_[0, r[edge_r]]), step, np.packbits(more))
            # hashes of a share have their top bits in common: the lower seven bytes are sent
            body = w.hashes[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
            out.append((b, struct.pack("<I", len(head)) + head + body))
        return pa.table({"ref": pa.array([b for b, _ in out], pa.int32()), "work": pa.array([mine] * len(out), pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    def index(table: pa.Table) -> pa.Table:
        """To the block of each first place of a repeated window: the blocks that repeat it."""
        works, hashes, docs, owners, places, repeated = [], [], [], [], [], []
        for work_no, blob in zip(table.column("work").to_pylist(), table.column("blob").to_pylist(), strict=True):
            (size,) = struct.unpack_from("<I", blob)
            (least,) = struct.unpack_from("<q", blob, 4)
            d, counts, rows, step, more, _ = _get(blob, 5, 12)
            at = np.cumsum(step)
            edge = np.cumsum(counts) - counts
            at -= np.repeat(at[edge] - step[edge], counts)
            raw = np.frombuffer(blob, np.uint8, -1, 4 + size)
            wide = np.zeros((len(at), 8), np.uint8)
            wide[:, :7] = raw.reshape(-1, 7)
            works.append(np.full(len(at), work_no, np.int32))
            hashes.append(wide.view("<u8").ravel())
            docs.append(np.repeat(np.cumsum(d) + least, counts))
            owners.append(np.repeat(np.cumsum(rows).astype(np.int32), counts))
            places.append(at.astype(np.int32))
            repeated.append(np.unpackbits(more.astype(np.uint8), count=len(at)).astype(bool))
        h, d, own, at, wk, more = (np.concatenate(x) for x in (hashes, docs, owners, places, works, repeated))
        del hashes, docs, owners, places, works, repeated
        order = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        sizes = np.diff(np.r_[edge, len(order)])
        # alone in its block and nowhere else: no repeat
        many = np.repeat((sizes > 1) | more[order[edge]], sizes)
        order, sizes = order[many], sizes[(sizes > 1) | more[order[edge]]]
        if not len(order):
            return pa.table({"work": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        edge = np.cumsum(sizes) - sizes
        # an id lives in one block, so ids of a hash differ: the least one is first
        near = order[np.lexsort((d[order], np.repeat(np.arange(len(sizes)), sizes)))]
        first = np.repeat(near[edge], sizes)
        asks = near != first
        asks[edge] = more[near[edge]]
        near, first = near[asks], first[asks]
        by = np.lexsort((at[first], own[first], wk[near], wk[first]))
        near, first = near[by], first[by]
        cut = np.flatnonzero(np.r_[True, wk[first][1:] != wk[first][:-1], True]) if len(first) else np.zeros(1, np.int64)
        rows = []
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            f = first[i:j]
            rows.append((int(wk[f[0]]), _put(wk[near[i:j]], own[f], at[f])))
        return pa.table({"work": pa.array([r for r, _ in rows], pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})

    def cut_out(table: pa.Table, asked: pa.Table) -> pa.Table:
        """To each block that repeats passages of this one: their documents, places and text."""
        out = []
        if len(asked) and len(table):
            table = _ordered(table)
            raw, offsets = string_buffers(table.column("__text"))
            starts, ends, word0 = word_bounds(raw, offsets)
            doc = np.asarray(table.column("__id").combine_chunks().fill_null(0)).astype(np.int64)
            to, row, at = (np.concatenate(x) for x in zip(*(_get(b, 3)[:3] for b in asked.column("blob").to_pylist()), strict=True))
            by = np.lexsort((at, row, to))
            to, row, at = to[by], row[by], at[by]
            # windows that meet or overlap are one passage
            new = np.r_[True, (to[1:] != to[:-1]) | (row[1:] != row[:-1]) | (at[1:] > at[:-1] + window)]
            lead = np.flatnonzero(new)
            last = np.r_[lead[1:], len(at)] - 1
            to, row, at, stop = to[lead], row[lead], at[lead], at[last] + window
            a = starts[word0[row] + at]
            size = ends[word0[row] + stop - 1] - a
            edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                ids = doc[row[i:j]]
                least = int(ids.min())
                out.append((int(to[i]), struct.pack("<q", least) + _put(ids - least, at[i:j], size[i:j]) + _pieces(raw, a[i:j], size[i:j]).tobytes()))
        return pa.table({"work": pa.array([w for w, _ in out], pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})

    def parse(table: pa.Table, passages: pa.Table) -> pa.Table:
        table, w, doc = block(table)
        got = [[struct.unpack_from("<q", b)[0] + ids, *rest] for b in passages.column("blob").to_pylist() for ids, *rest in [_get(b, 3, 8)]]
        none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint8)]
        ref = Reference(*(np.concatenate(x) for x in zip(none, *got, strict=True)), window)
        row, start, length, passage, word = factorise(w, doc, ref).T
        begin = w.word0[row] + start
        cover = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + length, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed = np.diff(np.r_[0, np.cumsum(gone)][np.r_[w.word0, len(gone)]])
        # the text itself is sent once
        out = {c: table.column("__text" if c == text else f"__c{i}") for i, c in enumerate(kept)}
        out[names[0]] = _join(w, gone, w.word0)
        out[names[1]], out[names[2]] = pa.array(w.words), pa.array(removed)
        if factors:
            per = np.r_[0, np.cumsum(np.bincount(row, minlength=len(w.words)))].astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, ref.doc[passage], ref.place[passage] + word)], names=["start", "length", "source_id", "source_start"])
            out[names[3]] = pa.ListArray.from_arrays(pa.array(per), spans)
        return pa.table(out)

    def trimmed(f):
        def g(*tables: pa.Table) -> pa.Table:
            out = f(*tables)
            trim()
            return out

        return g

    send_one, index_one, cut_one, parse_one = trimmed(send), trimmed(index), trimmed(cut_out), trimmed(parse)
    # all three readers of the texts share one shuffle of them
    sent = work.groupBy("__work").applyInArrow(lambda t: send_one(t), "ref int, work int, blob binary")
    asked = sent.repartition(n_ref, "ref").groupBy("ref").applyInArrow(lambda t: index_one(t), "work int, blob binary")
    passages = work.groupBy("__work").cogroup(asked.groupBy("work")).applyInArrow(lambda t, r: cut_one(t, r), "work int, blob binary")
    return work.groupBy("__work").cogroup(passages.groupBy("work")).applyInArrow(lambda t, r: parse_one(t, r), schema)


def _join(w: Windows, gone: np.ndarray, word0: np.ndarray) -> pa.Array:
    """Words not gone, one blank between them, per row."""
    n = len(w.words)
    keep = ~gone
    starts, ends = w.starts[keep], w.ends[keep]
    row = np.repeat(np.arange(n), w.words)[keep]
    size = ends - starts
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    room = size + ~last
    total = int(room.sum())
    per = np.zeros(n + 1, np.int64)
    np.add.at(per, row + 1, room)
    offsets = np.cumsum(per)
    if not total:
        return pa.array([""] * n, pa.string())
    # bytes kept, plus the byte after each word but a row's last, made a blank
    mark = np.zeros(len(w.raw) + 2, np.int8)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends + ~last, -1)
    take = np.cumsum(mark[:-1], dtype=np.int8)[: len(w.raw) + 1] > 0
    source = np.append(w.raw, np.uint8(0x20))
    source[ends[~last]] = 0x20
    data = source[take]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
