"""Quality by supervised subword embeddings.

Words, pairs of adjacent words and runs of three and four bytes have learned vectors in
hashed tables; a document is the mean of its features' vectors, and a softmax over two
outputs tells its class.  Fitted by stochastic gradient descent in numpy.  For scoring
the vectors are folded with the output weights, which leaves one number a feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mix, ready, row_slices, span_hashes, string_buffers, within, word_bounds
from .labelled import training_sample

#: Hash buckets, vector length, labelled ids used of each class, and passes over them.
BUCKETS_LOG2, DIM, PER_CLASS, EPOCHS = 17, 8, 1500, 12
#: Descent steps of a fit, at least.
LEAST_STEPS = 800
#: A word that repeats the one before it is a feature of its own, in bucket zero.
_REPEAT = 0


class Features:
    """Hashed features of each row, in one flat array with the row of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, bits: int = BUCKETS_LOG2):
        n = len(offsets) - 1
        shift = np.uint64(64 - bits)
        starts, ends, first = word_bounds(raw, offsets)
        row = np.repeat(np.arange(n), np.diff(first))
        h = span_hashes(raw, starts, ends)
        out, rows = [(h >> shift).astype(np.int32)], [row]
        if len(h) > 1:
            pair = np.flatnonzero(row[1:] == row[:-1])
            same = h[pair] == h[pair + 1]
            both = (mix(h[pair] + np.uint64(3) * h[pair + 1]) >> shift).astype(np.int32)
            out.append(np.where(same, np.int32(_REPEAT), both))
            rows.append(row[pair])
        if len(raw) > 2:
            low = raw.astype(np.uint32)
            owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
            three = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
            inside = owner[:-2] == owner[2:]
            out.append(((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32)[inside])
            rows.append(owner[:-2][inside])
            if len(raw) > 3:
                four = three[:-1] | low[3:] << np.uint32(24)
                inside = owner[:-3] == owner[3:]
                out.append((((four ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int32)[inside])
                rows.append(owner[:-3][inside])
        self.kinds, self.rows, self.n = out, rows, n

    def means(self, table: np.ndarray) -> np.ndarray:
        """Mean of a number per feature over each row; rows without features have zero."""
        total, count = np.zeros(self.n), np.zeros(self.n)
        for f, r in zip(self.kinds, self.rows, strict=True):
            total += np.bincount(r, table[f], self.n)
            count += np.bincount(r, minlength=self.n)
        return total / np.maximum(count, 1)


def fit(texts: list[str], y: list[int], weight: list[float], bits: int = BUCKETS_LOG2, dim: int = DIM, epochs: int = EPOCHS, batch: int = 32, rate: float = 60.0) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): the folded model."""
    size = 1 << bits
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / dim, 1 / dim, (dim, size)).astype(np.float32)
    out, bias = np.zeros((2, dim)), np.zeros(2)
    y_, c = np.array(y, int), np.array(weight, float)
    order = rng.permutation(len(texts))
    parts = []
    for i in range(0, len(order), batch):
        pick = order[i : i + batch]
        f = Features(*string_buffers(pa.array([texts[k] for k in pick], pa.large_string())), bits)
        key = np.concatenate([r.astype(np.int64) * size + k for r, k in zip(f.rows, f.kinds, strict=True)])
        key, times = np.unique(key, return_counts=True)
        row, bucket = key // size, (key % size).astype(np.int32)
        share = times / np.maximum(np.bincount(row, times, f.n), 1)[row]
        parts.append((row.astype(np.int32), bucket, share, y_[pick], c[pick], f.n))
    # few documents are gone over more often
    epochs = max(epochs, -(-LEAST_STEPS // max(len(parts), 1)))
    steps, done = max(1, epochs * len(parts)), 0
    for _ in range(epochs):
        for row, bucket, share, label, cost, n in parts:
            step = rate * (1 - done / steps)
            done += 1
            mean = np.stack([np.bincount(row, v[bucket] * share, n) for v in vectors], axis=1)
            z = mean @ out.T + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            g = (p - np.eye(2)[label]) * cost[:, None] / n
            back = g @ out
            out -= 0.05 * step * (g.T @ mean)
            bias -= 0.05 * step * g.sum(axis=0)
            for d in range(dim):
                vectors[d] -= step * np.bincount(bucket, share * back[row, d], size).astype(np.float32)
    delta = out[1] - out[0]
    return (delta @ vectors).astype(np.float32), float(bias[1] - bias[0])


def score_quality(df: DataFrame, table: np.ndarray, bias: float, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score``: the softmax probability of the good class, from the whole text.

    A null or empty text has no features and scores by the bias alone.  Every row gives
    one row; an input column named ``score`` gives way.
    """
    kept = within(df, ["score"], keep)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])
    bits = len(table).bit_length() - 1
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(table, np.float32))
    source = ready(df).select(*kept, df[text].alias("__text"))

    def run(batches):
        w = shared.value
        for batch in batches:
            raw, offsets = string_buffers(batch.column("__text"))
            for i, j in row_slices(offsets):
                part = batch.slice(i, j - i)
                f = Features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                z = f.means(w) + bias
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=[*kept, "score"])

    return source.mapInArrow(run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Fit on at most ``per_class`` labelled ids of each class outside the held-out fifth.

    Without labels or documents the model knows nothing and scores a half; see
    ``training_sample`` for nulls and repeats.
    """
    return fit(*training_sample(docs, labels, label, per_class))
