"""The stateless operators on streams of documents.

Lexing, attributes, escaping and typed reading are row to rows, so they run unchanged
in Structured Streaming, without state or watermark.  What needs a document's events
together (depth, pairing, offsets) is computed inside the document's own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import event_array, events
from ..options import ReaderOptions


def stream_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of (path, xml), one row for each new UTF-8 file."""
    return spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def stream_events(df: DataFrame, doc_id: str = "doc_id", xml: str = "xml", options: ReaderOptions = ReaderOptions(), kinds: list[str] | None = None) -> DataFrame:
    """The event relation of a stream of documents: stateless, errors and end checks included."""
    return events(df, doc_id, xml, options, kinds)


def nested_events(df: DataFrame, xml: str = "xml", options: ReaderOptions = ReaderOptions(), into: str = "events") -> DataFrame:
    """Adds an array of (seq, depth, byte_start, e) to each row: structure without a shuffle.

    One left fold carries the depth and the offset; an end without a start stays at zero,
    a mismatched one closes the last open element.  Every byte of the document but its byte
    order mark is in some event's ``raw``; what cannot be read is an Error.
    """
    arr = event_array(F.col(xml), options)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<depth:int,byte_start:bigint>>").alias("out"))

    def step(acc, x):
        kind = x["e"]["kind"]
        end = (kind == "End") | ((kind == "Error") & x["e"]["raw"].startswith("</") & x["e"]["error"]["code"].isin("MismatchedEndTag", "UnmatchedEndTag"))
        closed = F.when(end, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        after = F.when(kind == "Start", closed + 1).otherwise(closed)
        item = F.struct(closed.cast("int").alias("depth"), acc["at"].alias("byte_start"))
        return F.struct(after.cast("int").alias("depth"), (acc["at"] + F.octet_length(x["e"]["raw"])).alias("at"), F.array_append(acc["out"], item).alias("out"))

    places = F.aggregate(arr, start, step, lambda a: a["out"])
    both = F.zip_with(arr, places, lambda x, p: F.struct(x["seq"].alias("seq"), p["depth"].alias("depth"), p["byte_start"].alias("byte_start"), x["e"].alias("e")))
    return df.withColumn(into, both)
