"""Toxicity by multiple-instance learning: only documents are labelled.

A sentence's score is a logistic function of the weights of its words and word
beginnings (hashed); a document is toxic unless all its sentences are clean, so its
score is the noisy-or ``1 - prod(1 - p)``.  Fitting follows the gradient of the
document loss into the sentences, which then also tell where the offence lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ready, row_slices, span_hashes, string_buffers, trim, within, word_bounds
from .labelled import training_sample

#: Hash buckets, labelled ids used of each class, and passes over them.
BUCKETS_LOG2, PER_CLASS, EPOCHS = 18, 4000, 50
#: Labelled documents that must hold a feature for it to get a weight: one in so many toxic
#: ones, within these bounds.
LEAST_SHARE, LEAST_DOCS = 40, (2, 10)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x21, 0x3F, 0x0A]] = True
#: Kinds of features: the word, its first four bytes, its first five.
_KINDS = ((0, 0x51ED270B2D9E4A37), (4, 0x7C0E3B1A94D5F26B), (5, 0x3B9AC1F7E02D8465))


class Sentences:
    """Hashed features of sentences of the rows of a text column."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, bits: int = BUCKETS_LOG2):
        raw = _LOWER[raw]
        starts, ends, first = word_bounds(raw, offsets, ~_LETTER)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        stops = np.cumsum(_STOP[raw]) if len(raw) else np.zeros(0, np.int64)
        mark = stops[starts] if len(starts) else starts
        new = np.ones(len(starts), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (rows[1:] != rows[:-1])
        self.begin = np.flatnonzero(new)  # first word of each sentence
        self.row = rows[self.begin]
        self.rows = len(offsets) - 1
        self.start = starts[self.begin]
        self.end = ends[np.append(self.begin[1:], len(starts)) - 1] if len(starts) else starts
        self.words = len(starts)
        shift = np.uint64(64 - bits)
        self.features = []
        for size, salt in _KINDS:
            if size:
                long = np.flatnonzero(ends - starts > size)
                h = span_hashes(raw, starts[long], starts[long] + size)
            else:
                long, h = None, span_hashes(raw, starts, ends)
            self.features.append((long, (((h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32)))

    def logits(self, w: np.ndarray, bias: float) -> np.ndarray:
        total = np.zeros(self.words)
        for at, f in self.features:
            if at is None:
                total += w[f]
            else:
                total[at] += w[f]
        return (np.add.reduceat(total, self.begin) if self.words else np.zeros(0)) + bias

    def spread(self, per_sentence: np.ndarray, size: int) -> np.ndarray:
        """Sum of a sentence value over each feature's occurrences."""
        per_word = np.repeat(per_sentence, np.diff(np.append(self.begin, self.words)))
        out = np.zeros(size)
        for at, f in self.features:
            out += np.bincount(f, per_word if at is None else per_word[at], size)
        return out

    def holders(self, size: int) -> np.ndarray:
        """Number of rows that hold each feature."""
        row = np.repeat(self.row, np.diff(np.append(self.begin, self.words)))
        keys = [(row if at is None else row[at]).astype(np.int64) * size + f for at, f in self.features]
        return np.bincount(np.unique(np.concatenate(keys)) % size, minlength=size)

    def noisy_or(self, z: np.ndarray) -> np.ndarray:
        """Document scores; a text without words scores zero."""
        return -np.expm1(-np.bincount(self.row, np.logaddexp(0, z), self.rows))


def fit(texts: list[str], y: list[int], weight: list[float], bits: int = BUCKETS_LOG2, epochs: int = EPOCHS, batch: int = 125, rate: float = 1.0, sparse: float = 1e-4, least: int | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive-gradient steps on the document loss."""
    size = 1 << bits
    w, b = np.zeros(size), -4.0
    gw, gb = np.full(size, 1e-2), 1e-2
    y_, c = np.array(y, float), np.array(weight, float)
    order = np.random.default_rng(7).permutation(len(texts))
    parts = []
    for i in range(0, len(order), batch):
        pick = order[i : i + batch]
        parts.append((Sentences(*string_buffers(pa.array([texts[k] for k in pick], pa.large_string())), bits), y_[pick], c[pick]))
    # rare features would learn single documents by heart
    held = np.zeros(size, np.int64)
    for s, _, _ in parts:
        held += s.holders(size)
    if least is None:
        least = min(max(sum(y) // LEAST_SHARE, LEAST_DOCS[0]), LEAST_DOCS[1])
    used = held >= least
    for _ in range(epochs):
        for s, label, cost in parts:
            z = s.logits(w, b)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            doc = np.clip(s.noisy_or(z), 1e-9, 1 - 1e-12)
            slope = np.where(label > 0, -(1 - doc) / doc, 1.0) * cost
            g = slope[s.row] * p / len(label)
            dw, db = np.where(used, s.spread(g, size), 0.0), float(g.sum())
            gw += dw * dw
            gb += db * db
            # offence adds up and is never excused: weights stay at zero or above, and
            # a constant pull sets those of chance words to zero
            step = rate / np.sqrt(gw)
            w = np.maximum(w - step * (dw + sparse), 0.0)
            b -= rate * db / np.sqrt(gb)
    return w.astype(np.float32), float(b)


def score_toxicity(df: DataFrame, weights: np.ndarray, bias: float, text: str = "text", sentences: bool = True, threshold: float = 0.5, keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """Add ``score`` (noisy-or over the whole text) and ``offending``.

    ``offending`` lists (start, end, score) of the sentences at or above ``threshold``,
    as byte places in the UTF-8 text.  A null, empty or wordless text scores zero.  Every
    row gives one row; an input column named like a result gives way (``into`` renames the
    score).
    """
    names = [into] + ["offending"] * sentences
    kept = within(df, names, keep)
    fields = [T.StructField(into, T.DoubleType())]
    if sentences:
        fields.append(T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))))
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    bits = len(weights).bit_length() - 1
    table = df.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))
    source = ready(df).select(*kept, df[text].alias("__text"))

    def run(batches):
        w = table.value
        for batch in batches:
            raw, offsets = string_buffers(batch.column("__text"))
            for i, j in row_slices(offsets):
                part = batch.slice(i, j - i)
                at = offsets[i : j + 1] - offsets[i]
                s = Sentences(raw[offsets[i] : offsets[j]], at, bits)
                z = s.logits(w, bias)
                out = [pa.array(s.noisy_or(z))]
                if sentences:
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    bad = np.flatnonzero(p >= threshold)
                    per = np.r_[0, np.cumsum(np.bincount(s.row[bad], minlength=j - i))].astype(np.int32)
                    spans = pa.StructArray.from_arrays([pa.array(s.start[bad] - at[s.row[bad]]), pa.array(s.end[bad] - at[s.row[bad]]), pa.array(p[bad])], names=["start", "end", "score"])
                    out.append(pa.ListArray.from_arrays(pa.array(per), spans))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *out], names=[*kept, *names])
        trim()

    return source.mapInArrow(run, schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Fit on at most ``per_class`` labelled ids of each class outside the held-out fifth.

    Without a label of a class, or without documents, nothing is ever toxic or all is as
    likely as the prior says; see ``training_sample`` for nulls and repeats.
    """
    return fit(*training_sample(docs, labels, label, per_class))
