"""Attributes of tags: a lazy array expression, a relation, and the exact reader."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, local_name, prefix, unescape, xml_bool
from ..session import ship_package
from .strict import read_attributes

_S = "[ \\t\\r\\n]"
#: A key, an equals sign and a quoted value.
XML_ATTRIBUTE = f"[^ \\t\\r\\n=][^ \\t\\r\\n=]*+{_S}*+={_S}*+(?:\"[^\"]*\"|'[^']*')"
#: Also bare keys and values without quotes.
HTML_ATTRIBUTE = f"[^ \\t\\r\\n][^ \\t\\r\\n=]*+(?:{_S}*+={_S}*+(?:\"[^\"]*\"|'[^']*'|[^ \\t\\r\\n\"'][^ \\t\\r\\n]*+))?"
XSI = "http://www.w3.org/2001/XMLSchema-instance"

_TYPE = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("quote", T.StringType()), T.StructField("error", T.StringType()), T.StructField("error_pos", T.IntegerType()), T.StructField("error_pos2", T.IntegerType())]))


def attribute_array(attrs_raw: Column, html: bool = False) -> Column:
    """Array of (pos, key, value, quote): raw values, in order, repeated keys included.

    ``quote`` is double, single, unquoted or none (a bare key, in HTML mode).
    """
    found = F.regexp_extract_all(attrs_raw, F.lit(HTML_ATTRIBUTE if html else XML_ATTRIBUTE), F.lit(0))

    def one(x: Column, i: Column) -> Column:
        key = F.regexp_extract(x, "^(.[^ \\t\\r\\n=]*)", 1)
        value = F.regexp_replace(F.substring(x, F.char_length(key) + 1, F.char_length(x)), f"^{_S}*={_S}*", "")
        quoted = value.startswith('"') | value.startswith("'")
        bare = F.char_length(x) == F.char_length(key)
        quote = F.when(bare, "none").when(value.startswith('"'), "double").when(value.startswith("'"), "single").otherwise("unquoted")
        inner = F.when(quoted, F.substring(value, F.lit(2), F.char_length(value) - 2)).otherwise(value)
        return F.struct(i.alias("pos"), key.alias("key"), inner.alias("value"), quote.alias("quote"))

    return F.transform(found, one)


def get_attribute(attrs_raw: Column, name: str, html: bool = False) -> Column:
    """Raw value of the first attribute called ``name``; null without one."""
    hit = F.filter(attribute_array(attrs_raw, html), lambda a: a["key"] == name)
    return F.try_element_at(hit, F.lit(1))["value"]


def attribute_map(attrs_raw: Column, mark: str = "@", html: bool = False) -> Column:
    """Map of ``mark`` + local name to unescaped value; of repeated names the last."""
    pairs = F.transform(attribute_array(attrs_raw, html), lambda a: F.struct(F.concat(F.lit(mark), local_name(a["key"])).alias("k"), unescape(a["value"]).alias("v")))
    return let(pairs, lambda ps: F.map_from_entries(F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))))


def attributes(ev: DataFrame, html: bool = False) -> DataFrame:
    """(doc_id, seq, pos, key, prefix, local, raw_value, value, quote, is_bool, duplicate) of all tags.

    ``duplicate`` marks a key that the tag already had.  Well-formed attributes only;
    see :func:`exact_attributes` for errors.
    """
    tags = ev.filter(F.col("kind").isin("Start", "Empty")).filter(F.col("attrs_raw") != "")
    arr = attribute_array(F.col("attrs_raw"), html)
    before = let(arr, lambda xs: F.transform(xs, lambda a, i: F.struct(a.alias("a"), F.exists(F.slice(xs, F.lit(1), i), lambda b: b["key"] == a["key"]).alias("again"))))
    rows = tags.select("doc_id", "seq", F.explode(before).alias("x"))
    a = F.col("x.a")
    return rows.select("doc_id", "seq", a["pos"].alias("pos"), a["key"].alias("key"), prefix(a["key"]).alias("prefix"), local_name(a["key"]).alias("local"), a["value"].alias("raw_value"), unescape(a["value"]).alias("value"), a["quote"].alias("quote"), xml_bool(a["value"]).alias("as_bool"), F.col("x.again").alias("duplicate"))


def exact_attributes(df: DataFrame, column: str = "content", start: str | int = 0, html: bool = False, checks: bool = True, into: str = "attrs") -> DataFrame:
    """Adds an array of attributes and errors, read from the tag's content.

    ``start`` is where the attributes begin: a number, or a column (the name's length).
    Errors are ExpectedEq, ExpectedValue, UnquotedValue, ExpectedQuote and Duplicated,
    with their place in the tag (and the first key's, for a repeated one).
    """
    ship_package(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(into, _TYPE)])
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.string()), ("value", pa.string()), ("quote", pa.string()), ("error", pa.string()), ("error_pos", pa.int32()), ("error_pos2", pa.int32())]))

    def run(batches):
        for b in batches:
            texts = b.column(column).to_pylist()
            at = b.column(start).to_pylist() if isinstance(start, str) else [start] * len(texts)
            got = [None if t is None else [a._asdict() for a in read_attributes(t, s or 0, html, checks)] for t, s in zip(texts, at, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, into])

    return df.mapInArrow(run, schema)


def declaration(content: Column) -> Column:
    """Struct (version, encoding, standalone, error) of an XML declaration's content.

    The first attribute must be ``version``; otherwise the error is MissingDeclVersion.
    """
    arr = attribute_array(F.substring(content, F.lit(4), F.char_length(content)))
    first = F.try_element_at(arr, F.lit(1))
    pick = lambda n: F.try_element_at(F.filter(arr, lambda a: a["key"] == n), F.lit(1))["value"]
    ok = first["key"].eqNullSafe("version")
    return F.struct(F.when(ok, first["value"]).alias("version"), pick("encoding").alias("encoding"), pick("standalone").alias("standalone"), F.when(~ok, F.lit("MissingDeclVersion")).alias("error"))


def push_attribute(tag: Column, key: Column | str, value: Column, escaped: bool = False) -> Column:
    """A tag's content with one more attribute, always in double quotes.

    The value is escaped unless it is said to be so already.
    """
    from ..functions.text import escape

    k = F.lit(key) if isinstance(key, str) else key
    return F.concat(tag, F.lit(" "), k, F.lit('="'), value if escaped else escape(value), F.lit('"'))


def set_name(content: Column, name: Column, attrs_raw: Column) -> Column:
    """A tag's content under another name, attributes kept."""
    return F.concat(name, F.coalesce(attrs_raw, F.lit("")))


def clear_attributes(name: Column) -> Column:
    """A tag's content without attributes: its name."""
    return name


def name_length(content: Column) -> Column:
    """Bytes of the name at the start of a tag's content."""
    return F.octet_length(F.regexp_extract(content, "^[^ \\t\\r\\n]*", 0))


def end_of(content: Column) -> Column:
    """Content of the end tag that closes a start tag's content."""
    return F.regexp_extract(content, "^[^ \\t\\r\\n]*", 0)
