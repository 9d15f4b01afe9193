"""Documents in and out of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import decode_document, detect_encoding, effective_charset, strip_bom


def read_documents(spark: SparkSession, path: str, encoding: str | None = None, glob: str | None = None) -> DataFrame:
    """(path, xml, encoding): one row a file, decoded by its own encoding or the one given.

    A file is one row, so it must fit a task; larger ones are read by ``read_rows``.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select("path", decode_document(F.col("content"), encoding).alias("xml"), effective_charset(F.col("content"), encoding).alias("encoding"), detect_encoding(F.col("content"))["charset"].alias("detected"))


def read_utf8_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): one row a UTF-8 text file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), strip_bom(F.col("value")).alias("xml"))


def read_rows(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """Elements called ``row_tag`` as typed rows; files are split among tasks."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@").option("valueTag", "$text").option("ignoreNamespace", "true")
    return (reader.schema(schema) if schema else reader).load(path)


def documents(df: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """(doc_id, xml) from any table with a text or binary column."""
    text = F.col(xml)
    if dict(df.dtypes)[xml] == "binary":
        text = decode_document(text)
    return df.select(F.col(doc_id).alias("doc_id"), text.alias("xml"))


def write_documents(df: DataFrame, path: str, xml: str = "xml", mode: str = "errorifexists") -> None:
    """Documents as a text table, one a line; a document with line feeds spans lines."""
    df.select(F.col(xml).alias("value")).write.mode(mode).text(path)


def write_rows(df: DataFrame, path: str, row_tag: str, root_tag: str = "rows", mode: str = "errorifexists") -> None:
    """Rows as elements of one XML file a partition."""
    df.write.mode(mode).format("xml").option("rowTag", row_tag).option("rootTag", root_tag).option("attributePrefix", "@").option("valueTag", "$text").save(path)
