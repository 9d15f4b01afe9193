"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit checks.

An item leaks where some passage of a document is within ``allowed(n) = floor(0.2 n)``
word edits of its ``n`` words (lower-cased runs of letters and digits; a sign of a script
without blanks is a word).

A CGK random walk copies words into an embedding of length ``3 n``, at each step moving
on or staying by a random bit of (step, word); texts a few edits apart fall into step
again, so edits become few Hamming differences.  Tables of sampled positions of several
walks are the LSH: an item-sized window that agrees with an item in one table is a
candidate, and its surroundings are checked by the exact edit distance.  The number of
walks follows from the recall that is asked for.

Not every window is embedded.  Of ``allowed + 1`` disjoint parts of an item one is
untouched by so many edits, so a leaking window holds a part of some item as it stands.
Windows near no part of an item of their size cannot pass the edit check and are skipped;
which items a window is compared with is up to the tables alone.

Words are numbers: those of the items' own words, told by their bytes, and zero for all
others.  So distances are exact.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lanes, mix, ready, row_slices, same_spans, span_hashes, span_ids, string_buffers, trim, whole_number, window_hashes

#: Share of an item's words that may be edited, and the least words of an item.
SHARE, LEAST_WORDS = 0.2, 5
#: Tables of a walk, positions of a table, and the recall asked for.
TABLES, PLACES, RECALL = 4, 3, 0.99
#: Chance, as measured, that a walk's tables find an item with all edits that are allowed.
PER_WALK = 0.4
#: Items of one pass over the documents, in bytes of text.
ITEM_BYTES = 32 << 20
#: Steps that every table's reach spans.
NEAREST = 12
#: Windows embedded together.
_WINDOWS = 4096
_SIEVE_BITS = 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _two_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Of code points below U+0800: the lower-case one, and whether it belongs to a word."""
    low, solid = np.arange(0x800), np.ones(0x800, bool)
    for c in range(0x80, 0x800):
        to = chr(c).lower()
        if len(to) == 1 and 0x80 <= ord(to) < 0x800:
            low[c] = ord(to)
        solid[c] = unicodedata.category(chr(c))[0] in "LNM"
    return low, solid


_LOW2, _SOLID2 = _two_bytes()
#: Three-byte code points: punctuation, and scripts that are written without blanks
#: (Thai to Lao, Myanmar, Khmer, kana to CJK ideographs, compatibility ideographs).
_MARKS = ((0x2000, 0x206F), (0x3000, 0x303F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20))
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF))


def _among(cp: np.ndarray, ranges) -> np.ndarray:
    return np.logical_or.reduce([(cp >= a) & (cp <= b) for a, b in ranges])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends of words, first word of each row)."""
    low = _LOWER[raw]
    solid = _LETTER[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    wide = raw >= 0xC2
    if wide.any():
        two = np.flatnonzero(wide & (raw < 0xE0))
        cp = (raw[two].astype(np.int64) & 0x1F) << 6 | raw[two + 1] & 0x3F
        low[two], low[two + 1] = 0xC0 | _LOW2[cp] >> 6, 0x80 | _LOW2[cp] & 0x3F
        solid[two] = solid[two + 1] = _SOLID2[cp]
        three = np.flatnonzero(wide & (raw >= 0xE0) & (raw < 0xF0))
        cp = (raw[three].astype(np.int64) & 0x0F) << 12 | (raw[three + 1].astype(np.int64) & 0x3F) << 6 | raw[three + 2] & 0x3F
        mark = three[_among(cp, _MARKS)]
        solid[mark] = solid[mark + 1] = solid[mark + 2] = False
        alone = three[_among(cp, _UNSPACED)]
        edge[alone] = edge[alone + 3] = True
        # ideographs beyond the basic plane
        four = np.flatnonzero(raw[:-1] == 0xF0)
        four = four[(raw[four + 1] >= 0xA0) & (raw[four + 1] < 0xB4)]
        edge[four] = edge[four + 4] = True
    edge[1:-1] |= solid[1:] != solid[:-1]
    at = np.flatnonzero(edge)
    if not len(raw):
        z = np.zeros(0, np.int64)
        return low, z, z, np.zeros(len(offsets), np.int64)
    begin = at[:-1][solid[at[:-1]]]
    end = at[1:][solid[at[:-1]]]
    return low, begin, end, np.searchsorted(begin, offsets)


def allowed(n: int, share: float = SHARE) -> int:
    return int(math.floor(share * n + 1e-9))


def walks_for(recall: float, chance: float = PER_WALK) -> int:
    """Walks that find an item with ``recall`` where each one does with ``chance``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


class Items:
    """Items of a pass: their words as numbers, the parts that mark windows, and the tables."""

    def __init__(self, ids: list[int | None], texts: list[str], share: float = SHARE, recall: float = RECALL, least: int = LEAST_WORDS):
        low, starts, ends, first = words(*string_buffers(pa.array(texts, pa.large_string())))
        h = span_hashes(low, starts, ends)
        number = span_ids(low, starts, ends, h) + 1
        # the items' own words by hash: the first place of each
        _, at = np.unique(number, return_index=True)
        at = at[np.argsort(h[at], kind="stable")]
        self.hashes, self.numbers, self.spot, self.size = h[at], number[at], starts[at], ends[at] - starts[at]
        self.text = low
        use = [i for i in range(len(ids)) if first[i + 1] - first[i] >= max(least, 1)]
        self.ids = [ids[i] for i in use]
        self.words = [number[first[i] : first[i + 1]] for i in use]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.k = np.array([allowed(int(n), share) for n in self.n], np.int64)
        parts: dict[int, list[tuple[int, int, int, int]]] = {}
        for w, n, k in zip(self.words, self.n.tolist(), self.k.tolist(), strict=True):
            q = n // (k + 1)
            g = window_hashes(w.astype(np.uint64), q)
            for s in range(k + 1):
                at_ = s * n // (k + 1)
                parts.setdefault(q, []).append((int(g[at_]), at_, n, k))
        self.parts = {}
        for q, rows in parts.items():
            # one entry for each hash, place and size, whatever number of items has it
            rows = sorted(set(rows))
            key = np.array([r[0] for r in rows], np.uint64)
            sieve = np.zeros(1 << _SIEVE_BITS, bool)
            sieve[key >> np.uint64(64 - _SIEVE_BITS)] = True
            self.parts[q] = (sieve, key, *(np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3)))
        rng = np.random.default_rng(20)
        self.walks = walks_for(recall)
        # walks and keys follow from the words' hashes, so that every pass has the same
        self.code = np.ones(int(number.max(initial=0)) + 1, np.uint64)
        self.code[self.numbers] = self.hashes | np.uint64(1)
        # a table samples the walk up to its own reach: edits drive walks apart, so that
        # places soon after the start agree more often; the last places see the whole window
        reach = np.repeat(rng.random((self.walks, TABLES)) ** 3, PLACES, axis=1)
        self.place = (reach, rng.random((self.walks, TABLES * PLACES)))
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        keys = np.zeros((len(self.n), self.walks * TABLES), np.uint64)
        for pick, got in self.embed(flat, np.cumsum(self.n) - self.n, self.n, np.full(len(self.n), len(flat))):
            keys[pick] = got
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=0)

    def numbered(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of a text's words: an item word's, or zero."""
        h = span_hashes(low, starts, ends)
        at = np.searchsorted(self.hashes, h)
        out = np.zeros(len(h), np.int64)
        todo = np.arange(len(h))
        x, y = lanes(low), lanes(self.text)
        while len(todo):
            todo = todo[at[todo] < len(self.hashes)]
            todo = todo[self.hashes[at[todo]] == h[todo]]
            size = ends[todo] - starts[todo]
            same = size == self.size[at[todo]]
            same[same] = same_spans(x, starts[todo[same]], y, self.spot[at[todo[same]]], size[same])
            out[todo[same]] = self.numbers[at[todo[same]]]
            todo = todo[~same]
            at[todo] += 1  # another word of the same hash may follow
        return out

    def embed(self, words: np.ndarray, start: np.ndarray, n: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which windows, their keys by table) of windows of ``n`` of ``words`` from ``start`` on.

        A window ends after its words or at ``stop``; past its end there is padding.  Only
        sampled places of a walk are kept, and windows of about one size walk together.
        """
        order = np.argsort(-n, kind="stable")
        code = np.append(self.code[words], np.uint64(0))
        for i in range(0, len(order), _WINDOWS):
            pick = order[i : i + _WINDOWS]
            size, begin, last = n[pick], start[pick], np.minimum(start[pick] + n[pick], stop[pick])
            out = np.zeros((len(pick), self.walks * TABLES), np.uint64)
            for w in range(self.walks):
                reach = np.maximum(self.place[0][w][None] * (3 * size)[:, None], np.minimum(NEAREST, 3 * size)[:, None])
                spot = np.floor(self.place[1][w][None] * reach).astype(np.int64).ravel()
                by = np.argsort(spot, kind="stable")
                cut = np.searchsorted(spot[by], np.arange(int(spot.max(initial=-1)) + 2))
                salt = mix(np.uint64((w + 1) << 40) | np.arange(len(cut) - 1, dtype=np.uint64)) | np.uint64(1)
                got = np.zeros(len(spot), np.uint64)
                # every second walk starts at the window's end and goes back
                back = w % 2 == 1
                at, live = (last - 1 if back else start[pick].copy()), len(pick)
                for j in range(len(cut) - 1):
                    # longer windows come first: those still walking are at the front
                    while live and 3 * size[live - 1] <= j:
                        live -= 1
                    inside = at[:live] >= begin[:live] if back else at[:live] < last[:live]
                    here = np.where(inside, at[:live], len(words))
                    if cut[j] < cut[j + 1]:
                        slot = by[cut[j] : cut[j + 1]]
                        got[slot] = code[here[slot // (TABLES * PLACES)]]
                    c = code[here]
                    move = np.where(c == 0, 1, ((c * salt[j]) >> np.uint64(63)).astype(np.int64))
                    at[:live] += -move if back else move
                out[:, w * TABLES : (w + 1) * TABLES] = _keys(got.reshape(len(pick), TABLES, PLACES), size)
            yield pick, out


def _keys(got: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A table's key: its sampled words, and the window's size."""
    key = np.repeat(mix(size.astype(np.uint64))[:, None], got.shape[1], axis=1)
    for p in range(got.shape[2]):
        key = mix((key ^ got[:, :, p]) * np.uint64(0x9E3779B97F4A7C15))
    return key


def passage_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the passage of ``region`` nearest to ``item``; ties: first."""
    m = len(region)
    cost = np.zeros(m + 1, np.int64)
    begin = np.arange(m + 1)
    for i, w in enumerate(item.tolist()):
        diag = cost[:-1] + (region != w)
        up = cost[1:] + 1
        best = np.empty(m + 1, np.int64)
        src = np.empty(m + 1, np.int64)
        best[0], src[0] = i + 1, 0
        take = diag <= up
        best[1:], src[1:] = np.where(take, diag, up), np.where(take, begin[:-1], begin[1:])
        # words of the region left out: least of best[j'] + (j - j')
        lag = best - np.arange(m + 1)
        run = np.minimum.accumulate(lag)
        left = run + np.arange(m + 1)
        who = np.maximum.accumulate(np.where(lag == run, np.arange(m + 1), 0))
        better = left < best
        src = np.where(better, src[who], src)
        cost, begin = np.minimum(left, best), src
    j = int(np.argmin(cost))
    return int(cost[j]), int(begin[j]), j


def _spread(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def windows_near_parts(items: Items, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, words) of the item-sized windows that lie near a part of an item of their size.

    A passage within the edits allowed begins at most so many words off a window of these;
    of long items not every start is tried, but one in some of those words.
    """
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    for q, (sieve, key, at, n, k) in items.parts.items():
        g = window_hashes(number.astype(np.uint64), q)
        hit = np.flatnonzero(sieve[g >> np.uint64(64 - _SIEVE_BITS)])
        hit = hit[row_of[hit] == row_of[hit + q - 1]]
        lo, hi = np.searchsorted(key, g[hit], "left"), np.searchsorted(key, g[hit], "right")
        many = hi - lo
        which = np.repeat(lo, many) + _spread(many)
        place = np.repeat(hit, many)
        long = (first[1:] - first[:-1])[row_of[place]] >= (n - k)[which]
        which, place = which[long], place[long]
        found.append(np.stack([row_of[place], place - at[which], n[which], k[which]], axis=1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.unique(np.concatenate(found), axis=0)
    row, start, n, k = near.T
    step = np.maximum(1, k // 16)
    half = k // step
    shift = (_spread(2 * half + 1) - np.repeat(half, 2 * half + 1)) * np.repeat(step, 2 * half + 1)
    row, start, n, k = (np.repeat(x, 2 * half + 1) for x in (row, start, n, k))
    start = np.clip(start + shift, first[row], first[row + 1] - (n - k))
    both = np.unique(np.stack([start, n], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def candidates(items: Items, number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(row, item, start) of windows that agree with an item in a table."""
    start, n = windows_near_parts(items, number, first)
    none = np.zeros((0, 3), np.int64)
    if not len(start):
        return none
    row = np.searchsorted(first, start, side="right") - 1
    out = [none]
    for pick, keys in items.embed(number, start, n, first[row + 1]):
        for t in range(keys.shape[1]):
            lo, hi = np.searchsorted(items.keys[:, t], keys[:, t], "left"), np.searchsorted(items.keys[:, t], keys[:, t], "right")
            hit = np.flatnonzero(hi > lo)
            many = (hi - lo)[hit]
            w = pick[np.repeat(hit, many)]
            out.append(np.stack([row[w], items.order[np.repeat(lo[hit], many) + _spread(many), t], start[w]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def find_leaks(items: Items, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int, int]]:
    """(row, item, start word, words, edits, start byte, end byte): each leak's nearest passage."""
    low, starts, ends, first = words(raw, offsets)
    if not len(starts) or not len(items.n):
        return []
    number = items.numbered(low, starts, ends)
    # the surroundings of an item's windows, joined where they meet
    regions: dict[tuple[int, int], list[list[int]]] = {}
    for row, item, start in candidates(items, number, first).tolist():
        k, n = int(items.k[item]), int(items.n[item])
        lo, hi = max(int(first[row]), start - k), min(int(first[row + 1]), start + n + k)
        known = regions.setdefault((row, item), [])
        if known and lo <= known[-1][1]:
            known[-1][1] = max(hi, known[-1][1])
        else:
            known.append([lo, hi])
    out = []
    for (row, item), spans in sorted(regions.items()):
        best = None
        for lo, hi in spans:
            d, a, b = passage_distance(items.words[item], number[lo:hi])
            if d <= items.k[item] and b > a and (best is None or d < best[0]):
                best = (d, lo + a, lo + b)
        if best is not None:
            d, a, b = best
            out.append((row, item, a - int(first[row]), b - a, d, int(starts[a] - offsets[row]), int(ends[b - 1] - offsets[row])))
    return out


def _passes(items: DataFrame, item_id: str, item_text: str, item_bytes: int, recall: float, least_words: int) -> Iterator[Items]:
    """The items with a text, in passes of at most ``item_bytes`` of text."""
    items = items.select(whole_number(items, item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(total / item_bytes))
    for p in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows], recall=recall, least=least_words)


def leaks(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES, recall: float = RECALL, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance): items that leak into documents.

    One row for each document row and item that leaks into it, with its nearest passage:
    first word, words, and word edits.  A leak with all edits that are allowed is found
    with ``recall`` at least, one with fewer more surely, a verbatim one always.  Items of
    fewer than ``least_words`` words match nothing (short ones are everyday words: "yes"),
    neither do null texts or null items; null ids are kept; repeated rows give their rows
    each.  Items go to the executors in passes of at most ``item_bytes`` of text (an item
    is never split), every document meets every pass.  No shuffle of the documents.

    A task holds the sampled places of some thousand windows, whatever an item's length; the
    work for an item grows with the square of its words.
    """
    out = None
    for one in _passes(items, item_id, item_text, item_bytes, recall, least_words):
        got = _pass(df, one, doc_id, text)
        out = got if out is None else out.union(got)
    return out


def _pass(df: DataFrame, items: Items, doc_id: str, text: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)
    source = ready(df).select(whole_number(df, doc_id).alias("doc_id"), df[text].alias("__text"))
    names = ["doc_id", "item_id", "start", "n_words", "distance"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def run(batches):
        known = shared.value
        item_ids = pa.array(known.ids, pa.int64())
        for batch in batches:
            raw, offsets = string_buffers(batch.column("__text"))
            ids = batch.column("doc_id")
            for i, j in row_slices(offsets):
                got = find_leaks(known, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if got:
                    a = np.array(got, np.int64)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[:, 0] + i)), item_ids.take(pa.array(a[:, 1])), *(pa.array(a[:, c]) for c in (2, 3, 4))], names=names)
        trim()

    return source.mapInArrow(run, schema)


def drop_leaks(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES, recall: float = RECALL, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``df`` into which no item leaks, with all their columns; see ``leaks``.

    Null and empty texts stay, repeated rows stay or go together, an empty table of items
    drops nothing.  One pass over the documents, block of items by block.
    """
    for one in _passes(items, item_id, item_text, item_bytes, recall, least_words):
        shared = df.sparkSession.sparkContext.broadcast(one)

        def run(batches, shared=shared):
            known = shared.value
            for batch in batches:
                raw, offsets = string_buffers(batch.column(text))
                clean = np.ones(len(batch), bool)
                for i, j in row_slices(offsets):
                    for hit in find_leaks(known, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                        clean[i + hit[0]] = False
                yield batch.filter(pa.array(clean))
            trim()

        df = ready(df).mapInArrow(run, df.schema)
    return df
