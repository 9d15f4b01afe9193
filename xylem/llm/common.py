"""Shared plumbing of the corpus operators: table access, checkpoints, byte scans.

Word scans work on the UTF-8 buffers of Arrow string arrays directly, so a
batch of documents is split and hashed by a handful of numpy passes without a
Python object per word.
"""

from __future__ import annotations

import ctypes
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Bytes of text handled by one numpy pass; a longer single text is still taken whole.
SLICE_BYTES = 1 << 20
#: Compressed input bytes aimed at for one work block.
BLOCK_BYTES = 4 << 20
#: An estimate of so many bytes or more is none (a petabyte).
UNKNOWN_BYTES = 1 << 50

#: Separators of the word pattern ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Longer spans are hashed one by one.
_LANES_TO = 64
#: Masks that keep the first n of eight bytes.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def ready(df: DataFrame) -> DataFrame:
    """See to it that Python workers can import this package."""
    ship_package(df.sparkSession)
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder of ``spark.checkpoint.dir``.

    A local folder is used only where the session names none and runs on one machine.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, set from ``spark.checkpoint.dir`` where need be."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="xylem-ckpt-"))
    return sc.getCheckpointDir()


def block_count(df: DataFrame, block_bytes: int = BLOCK_BYTES, least: int = 8, most: int = 1 << 20) -> int:
    """Number of work blocks, from Catalyst's size estimate (file sizes for a scan).

    Where the plan has no estimate, the texts are measured: about half their bytes count.
    """
    est = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if est >= UNKNOWN_BYTES:
        texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
        est = (df.agg(F.sum(sum(texts, F.lit(8)).cast("long"))).first()[0] or 0) // 2
    return int(min(most, max(least, -(-est // block_bytes))))


def bucket_of(col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def trim() -> None:
    """Give memory that was freed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


@lru_cache(maxsize=1)
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library: nothing to give back
        return None


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def string_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    _, off, data = col.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Consecutive row ranges of about ``limit`` bytes each, at least one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
    """Starts and ends of words, and the index of each row's first word (n + 1 entries)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~space[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = solid[first]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    last = first[1:] - 1
    end[last] = solid[last]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as integers; zeros follow the end."""
    room = np.zeros(len(raw) + 16, np.uint8)
    room[: len(raw)] = raw
    return np.ndarray(len(raw) + 8, "<u8", room, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: equal spans, equal hashes, wherever they stand.

    Eight bytes at a time are mixed in by a non-linear bijection, so no two spans of one
    length up to eight collide; spans beyond 64 bytes take XXH3.  Where a result may only
    rest on equal bytes, callers compare them (``same_spans``, ``span_ids``).
    """
    size = ends - starts
    eight = lanes(raw)
    h = mix(size.astype(np.uint64) * _ODD ^ (eight[starts] & _KEEP[np.minimum(size, 8)]))
    more, at = np.flatnonzero((size > 8) & (size <= _LANES_TO)), 8
    while len(more):
        left = size[more] - at
        h[more] = mix(h[more] * _ODD ^ (eight[starts[more] + at] & _KEEP[np.minimum(left, 8)]))
        at += 8
        more = more[left > 8]
    for i in np.flatnonzero(size > _LANES_TO).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return h


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (callers drop those crossing rows)."""
    n = len(words) - k + 1
    if n <= 0 or k <= 0:
        return np.zeros(0, np.uint64)
    # runs of one, two, four, ... words; those that make up k are joined in order
    out, done, run, size = None, 0, words, 1
    while True:
        if k & size:
            part = run[done : done + n]
            out = part if out is None else mix(out * _ODD + part)
            done += size
        if done == k:
            return out if k > 1 else mix(out)
        run = mix(run[:-size] * _ODD + run[size:])
        size *= 2


def same_spans(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` on equal those from ``b`` on; ``x``, ``y`` are ``lanes``."""
    same = np.ones(len(a), bool)
    todo, at = np.arange(len(a)), 0
    while len(todo):
        left = size[todo] - at
        equal = ((x[a[todo] + at] ^ y[b[todo] + at]) & _KEEP[np.minimum(left, 8)]) == 0
        same[todo[~equal]] = False
        todo = todo[equal & (left > 8)]
        at += 8
    return same


def span_ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each span; equal numbers where, and only where, the bytes are equal.

    ``hashes`` are those of ``span_hashes``.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    ids = ids.astype(np.int64).ravel()
    rep = first[ids]
    size = ends - starts
    same = size == size[rep]
    # up to eight bytes, equal sizes and hashes are equal bytes
    at = np.flatnonzero(same & (size > 8))
    eight = lanes(raw)
    same[at] = same_spans(eight, starts[at], eight, starts[rep[at]], size[at])
    known: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # other bytes of one hash
        ids[i] = len(first) + known.setdefault(raw[starts[i] : ends[i]].tobytes(), len(known))
    return ids


def within(df: DataFrame, wanted: list[str], keep: list[str] | None = None) -> list[str]:
    """Input columns that survive beside result columns of the names ``wanted``.

    ``keep`` narrows them down; a name that is not there is an error.
    """
    taken = {w.lower() for w in wanted}
    if missing := [c for c in keep or () if c not in df.columns]:
        raise ValueError(f"no such columns to keep: {missing}")
    return [c for c in df.columns if c.lower() not in taken and (keep is None or c in keep)]


def whole_number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a long; a column of another kind is refused when the plan is built."""
    kind = df.schema[name].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"column {name} holds ids as {kind}, not as integers")
    return df[name].cast("long")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that only this job wrote and read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
