"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming links.

Fingerprints fall into ``m`` bit blocks.  Two that differ in at most ``d`` bits agree
on at least ``m - d`` blocks, so they meet in one of the C(m, d) tables keyed by the
other blocks.  ``m`` follows the number of fingerprints, which keeps chance meetings
rare at any size; every choice finds all links.

Only distinct fingerprints are compared, so copies cost nothing.  A key's
fingerprints are compared in memory and give a spanning forest, never all pairs; a
key with very many is cut into chunks and every pair of chunks becomes its own task.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, ready, row_slices, string_buffers, trim, whole_number, within
from .components import components, spread_join

#: Fingerprints of one key that one task compares; more are dealt out in chunks.
CHUNK = 2048
#: Keys of so many fingerprints or fewer are compared all at once, pair by pair.
SMALL = 12
#: Hot keys that go to all executors at most; more are joined by a shuffle.
MANY = 1 << 19


def shingle_fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles (A-Z lower-cased)."""
    if not text:
        return 0
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [h(line, seed)]
    else:
        blank = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        starts = [0, *(blank[: len(words) - size] + 1).tolist()]
        ends = [*blank[size - 1 :].tolist(), len(line)]
        hashes = [h(line[a:b], seed) for a, b in zip(starts, ends, strict=True)]
    return majority(np.array(hashes, ">u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of big-endian 64-bit hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", size: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Add ``fp`` (the 64 bits as a long).  A null or wordless text has zero."""
    kept = within(df, ["fp"], keep)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("fp", T.LongType())])
    source = ready(df).select(*kept, df[text].alias("__text"))

    def run(batches):
        for batch in batches:
            _, offsets = string_buffers(batch.column("__text"))
            for i, j in row_slices(offsets):
                part = batch.slice(i, j - i)
                fp = np.array([shingle_fingerprint(t, size, seed) for t in part.column("__text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(fp.view(np.int64))], names=[*kept, "fp"])

    return source.mapInArrow(run, schema)


def _tables(m: int, d: int) -> list[int]:
    """Bit masks of the kept blocks of each table."""
    cut = [round(64 * i / m) for i in range(m + 1)]
    block = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(m)]
    return [sum(block[i] for i in c) for c in combinations(range(m), m - d)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, d: int) -> list[tuple[int, int]]:
    """Spanning forest (index pairs) of the links of at most ``d`` bits; a row is a fingerprint."""
    left = np.arange(len(fps))
    edges = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]).sum(axis=1, dtype=np.int64) <= d
            if near.any():
                new = left[near].tolist()
                edges += [(i, j) for j in new]
                queue += new
                left = left[~near]
    return edges


def hamming_links(distinct: DataFrame, d: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct (fp, rep) rows that keep every component of the links.

    ``rep`` names the fingerprint's class in the result.  Rows without a fingerprint are not
    expected; an empty table has no edges, repeated rows give loops at most.
    """
    n = distinct.count()
    m = d + 2
    while 64 * (m - d) / m < np.log2(max(n, 2)) and m < 16:
        m += 1
    masks = _tables(m, d)
    assert len(masks) == comb(m, d)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(x)))) for i, x in enumerate(masks)])
    return _links(distinct.select("fp", "rep", F.explode(keys).alias("key")), n * len(masks), d, chunk)


def _links(rows: DataFrame, size: int, d: int, chunk: int = CHUNK) -> DataFrame:
    """Edges among rows (fp, rep, key) that share a key and differ in at most ``d`` bits.

    ``fp`` is a long, or binary of a multiple of eight bytes.  Of small keys every link is
    given, of larger ones a spanning forest.  A key's rows beyond ``chunk`` are dealt out
    before they meet; all pairs of its chunks are compared, as every choice of fewer would
    lose links.
    """
    # keys of more rows than a chunk: fewer than size / chunk
    hot = checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > chunk))
    hot = F.broadcast(hot) if hot.count() <= MANY else hot
    parts = int(size // 50_000) + 1
    # a hot key's rows go to every pair of chunks that holds theirs
    cut = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("s")).cast("int")
    spread = rows.join(hot, "key", "left").withColumn("s", F.coalesce(F.ceil(F.col("n") / chunk).cast("int"), F.lit(1))).withColumn("c", F.when(F.col("s") > 1, cut).otherwise(0))
    spread = spread.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    spread = spread.select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("key"), "fp", "rep")
    dealt = spread.repartition(max(parts, 1), "key").sortWithinPartitions("key", "rep")

    def words(col: pa.Array) -> np.ndarray:
        if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
            return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), -1)
        return np.asarray(col).view(np.uint64).reshape(-1, 1)

    def groups(key, fp, rep):
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        out = [np.zeros((0, 2), np.int64)]
        # small keys: rows one, two, ... places apart, all keys at once
        little = np.repeat(size <= SMALL, size)
        for step in range(1, SMALL):
            i = np.flatnonzero(little[:-step] & (key[step:] == key[:-step]))
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]).sum(axis=1, dtype=np.int64) <= d]
            out.append(np.stack([rep[i], rep[i + step]], axis=1))
        for g in np.flatnonzero(size > SMALL).tolist():
            i, j = int(edge[g]), int(edge[g + 1])
            pairs = np.array(forest(fp[i:j], d), np.int64).reshape(-1, 2)
            out.append(rep[i:j][pairs])
        return np.concatenate(out)

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def flush(cols):
            a = groups(*cols)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            cols = (np.asarray(batch.column("key")), words(batch.column("fp")), np.asarray(batch.column("rep")))
            # the last key may go on in the next batch
            other = np.flatnonzero(cols[0] != cols[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                done = tuple(np.concatenate([h[i] for h in held] + [cols[i][:cut]]) for i in range(3))
                held = [tuple(c[cut:] for c in cols)]
                yield flush(done)
            else:
                held.append(cols)
        if held:
            yield flush(tuple(np.concatenate([h[i] for h in held]) for i in range(3)))
        trim()

    return ready(dealt).mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, d: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``df``.

    Fingerprints link at ``d`` or fewer differing bits, equal ones included;
    ``component_id`` is the least id reachable over links, the row's own included.
    Null and wordless texts have fingerprint zero and are linked like any other.  Rows
    with a null id get no component and link nothing; repeated rows each get theirs.
    """
    docs = df.select(whole_number(df, doc_id).alias("doc_id"), df[text].alias("text"))
    fps = checkpoint(fingerprints(docs, size=size, seed=seed, keep=["doc_id"]))
    distinct = checkpoint(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    # an id on several rows may stand for several fingerprints: they are one node here, as
    # the id is what reaches others
    comp = components(hamming_links(distinct, d))
    classes = checkpoint(distinct.join(comp, distinct.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n"))
    known = fps.filter("doc_id is not null")
    out = spread_join(known, classes, "fp", known.count()).select("doc_id", "fp", "component_id")
    return out.unionByName(fps.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))
