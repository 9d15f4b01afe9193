"""Bounded samples of labelled documents for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_number

#: Bytes of text of each class that a fit reads at most.
CLASS_BYTES = 32 << 20


def held_out(doc_id: str = "doc_id"):
    """Rows kept from fitting: crc32 of the id's decimal text divisible by five."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, doc_id: str = "doc_id", text: str = "text", class_bytes: int = CLASS_BYTES):
    """(texts, labels, weights) of at most ``per_class`` labelled ids of each class.

    Ids are taken in the order of a hash, never from the held-out fifth, and of a class
    only as many as have ``class_bytes`` of text together; the weights restore each class's
    share.  An id on several rows gives the least of its texts, so the sample depends on
    neither repeats nor the order of rows.  Null ids and labels other than 0 and 1 are left
    out; of repeated labels of an id the larger counts; a null text is empty.
    """
    rows = labels.select(whole_number(labels, doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    size = {int(r["y"]): int(r["n"]) for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picks = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = picks[0].union(picks[1])  # at most 2 * per_class rows
    known = docs.select(whole_number(docs, doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    known = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    got = sorted(known.withColumn("__b", so_far).filter(F.col("__b") <= class_bytes).select("doc_id", "text", "y").collect())
    texts = [r["text"] for r in got]
    y = [int(r["y"]) for r in got]
    counts = {c: max(1, y.count(c)) for c in (0, 1)}
    total = sum(size.values()) or 1
    share = {c: size.get(c, 0) / total * len(y) / counts[c] for c in (0, 1)}
    return texts, y, [share[v] for v in y]
