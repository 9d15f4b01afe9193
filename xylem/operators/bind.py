"""Typed reading: XML text to columns of a given type.

``from_xml`` does the parsing inside the JVM with a schema whose leaves are strings;
a projection then applies this engine's own rules to the leaves: white space around
numbers, the four boolean literals, blank-separated lists, ``xsi:nil``.  What needs the
order of mixed content comes from the document's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PREDEFINED, entity_map, eol_xml11, let, read_number, resolve_reference, trim_xml, xml_bool, xs_list
from ..options import ReaderOptions
from .events import is_broken, kind_of, tokens
from .tree import enclosing, with_depth

#: Options under which ``from_xml`` follows the naming rules of typed reading.
FROM_XML = {"attributePrefix": "@", "valueTag": "$text", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}


def _raw(kind: T.DataType, name: str = "", nillable: bool = False) -> T.DataType:
    """The type to parse with: simple values as strings, lists in texts and attributes too."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _raw(f.dataType, f.name)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        if name.startswith("@") or name == "$text":
            return T.StringType()
        return T.ArrayType(_raw(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), T.StringType())
    return T.StringType()


def cast_text(c: Column, kind: T.DataType, strict: bool = False) -> Column:
    """A text as a simple value; what does not parse is null, or an error (``strict``)."""
    if isinstance(kind, T.StringType):
        return eol_xml11(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(xs_list(c), lambda x: cast_text(x, kind.elementType, strict))
    if isinstance(kind, T.NumericType):
        out = read_number(trim_xml(c), kind)
    else:
        out = xml_bool(c) if isinstance(kind, T.BooleanType) else trim_xml(c).try_cast(kind)
    if strict:
        wrong = F.raise_error(F.concat(F.lit(f"not a {kind.simpleString()}: "), c)).cast(kind)
        out = F.when(c.isNull() | out.isNotNull(), out).otherwise(wrong)
    return out


def _fix(c: Column, kind: T.DataType, name: str, strict: bool) -> Column:
    if isinstance(kind, T.StructType):
        fields = [_fix(c[f.name], f.dataType, f.name, strict).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and not (name.startswith("@") or name == "$text"):
        # a null item is an empty element
        if isinstance(kind.elementType, T.StringType):
            return F.transform(c, lambda x: F.coalesce(eol_xml11(x), F.lit("")))
        return F.transform(c, lambda x: _fix(x, kind.elementType, "", strict))
    if isinstance(kind, T.MapType):
        # a map as it is asked for: every value by its type
        return F.transform_values(c, lambda k, v: cast_text(v, kind.valueType, strict))
    return cast_text(c, kind, strict)


def read_typed(xml: Column, schema: T.StructType | str, strict: bool = False, wildcard: str | None = None) -> Column:
    """A struct of ``schema`` from each document; null where it is no well-formed record.

    Fields: ``@name`` attributes, ``$text`` text, others child elements by local name; the
    root's name does not matter; repeated siblings need not be adjacent.  ``wildcard``
    names a string (array) field that takes the inner XML of unknown elements.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = FROM_XML | ({"wildcardColName": wildcard} if wildcard else {})
    # a document that fails is null as a whole: its record of the failure is kept beside
    parse = T.StructType([*_raw(kind).fields, T.StructField("__corrupt", T.StringType())])
    # bound once: every field would otherwise parse the document again
    return let(F.from_xml(xml, _ddl(parse), options), lambda got: F.when(xml.isNotNull() & got["__corrupt"].isNull(), _fix(got, kind, "", strict)))


_INSIDE = ReaderOptions(check_end_names=False, allow_unmatched_ends=True)
_ITEM = "struct<tag:string,xml:string,text:string>"


def pieces(xml: Column) -> Column:
    """(kind, raw) of a document's events, without what reading in order has no need of.

    As a column of its own it serves several of the readers below.
    """
    return let(tokens(xml), lambda toks: F.transform(toks, lambda t, i: F.struct(kind_of(t, (i == F.size(toks) - 1) & is_broken(t), _INSIDE).alias("kind"), t.alias("raw"))))


def _top_items(of: Column, level: int) -> Column:
    """Elements of a level and the texts between them, in order: (tag, xml, text).

    One left fold over a document's :func:`pieces`: an element's raw text grows until it closes,
    runs of text, CDATA and references are one text.  Blank texts and what is outside of
    the level's parents are left out.
    """
    known = entity_map(PREDEFINED)
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("tag"), F.array().cast("array<string>").alias("raw"), F.array().cast(f"array<{_ITEM}>").alias("out"))

    def step(acc, e):
        kind, depth = e["kind"], acc["depth"]
        closed = F.when(kind == "End", F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        after = F.when(kind == "Start", depth + 1).otherwise(closed)
        inside = depth > level
        opens = (kind == "Start") & (depth == level)
        ends = (kind == "End") & (closed == level) & inside
        # names without their prefix, as for all typed reading
        tag = F.substring(e["raw"], F.lit(2), F.char_length(e["raw"]) - F.when(kind == "Empty", 3).otherwise(2))
        local = F.regexp_replace(F.regexp_extract(tag, "^[^ \\t\\r\\n]*", 0), "^[^:]*:", "")
        bit = F.when(kind == "Text", eol_xml11(e["raw"])).when(kind == "CData", eol_xml11(F.substring(e["raw"], F.lit(10), F.char_length(e["raw"]) - 12)))
        bit = bit.when(kind == "GeneralRef", F.coalesce(resolve_reference(F.substring(e["raw"], F.lit(2), F.char_length(e["raw"]) - 2), known), e["raw"]))
        here = (depth == level) & kind.isin("Text", "CData", "GeneralRef")
        raw = F.when(inside | opens, F.array_append(acc["raw"], e["raw"])).when(here, F.array_append(acc["raw"], bit)).otherwise(acc["raw"])
        text = F.array_join(acc["raw"], "")
        # a text ends where an element begins or the parent ends
        flush = ~inside & (F.size(acc["raw"]) > 0) & (opens | ((kind == "Empty") & (depth == level)) | ((kind == "End") & (depth == level)))
        spoken = F.when(flush & (trim_xml(text) != ""), F.array_append(acc["out"], F.struct(F.lit("$text").alias("tag"), F.lit(None).cast("string").alias("xml"), text.alias("text")))).otherwise(acc["out"])
        done = F.when(ends, F.array_append(acc["out"], F.struct(acc["tag"].alias("tag"), F.array_join(F.array_append(acc["raw"], e["raw"]), "").alias("xml"), F.lit(None).cast("string").alias("text"))))
        done = done.when((kind == "Empty") & (depth == level), F.array_append(spoken, F.struct(local.alias("tag"), e["raw"].alias("xml"), F.lit(None).cast("string").alias("text")))).otherwise(spoken)
        kept = F.when(ends | ((kind == "Empty") & (depth == level)) | (flush & ~opens), F.array().cast("array<string>")).when(opens, F.array(e["raw"])).otherwise(raw)
        return F.struct(after.cast("int").alias("depth"), F.when(opens, local).otherwise(acc["tag"]).alias("tag"), kept.alias("raw"), done.alias("out"))

    return F.aggregate(of, start, step, lambda a: a["out"])


def _variants(items: Column, variants: dict[str, T.DataType | str], strict: bool) -> Column:
    """Items with one typed field for each variant; the others are null."""

    def one(x: Column) -> Column:
        fields = [x["tag"].alias("tag"), x["text"].alias("$text")]
        for name, kind in variants.items():
            kind = T.StructType.fromDDL(f"v {kind}")["v"].dataType if isinstance(kind, str) else kind
            if isinstance(kind, T.StructType):
                value = read_typed(x["xml"], kind, strict)
            else:
                # a simple element: read as the only field of a record around it
                around = F.concat(F.lit("<r>"), x["xml"], F.lit("</r>"))
                value = read_typed(around, T.StructType([T.StructField(name, kind)]), strict)[name]
            fields.append(F.when(x["tag"] == name, value).alias(name))
        return F.struct(*fields)

    return F.transform(items, one)


def read_items(xml: Column, variants: dict[str, T.DataType | str], strict: bool = False, of: Column | None = None) -> Column:
    """Mixed or choice content of the root, by a schema and in order.

    An array of (tag, ``$text``, one field a variant): for an element the field of its
    name is read by the variant's type, for a text ``$text`` holds it.  Elements of other
    names have their tag alone.  ``read_items(...)[0]`` is a single choice.  For the content
    of an inner element take its inner XML first (``wildcard`` of ``read_typed``) and put a
    root around it.  ``of``: the document's ``pieces``, if they are at hand.
    """
    return F.when(xml.isNotNull(), _variants(_top_items(pieces(xml) if of is None else of, 1), variants, strict))


def read_roots(xml: Column, variants: dict[str, T.DataType | str], strict: bool = False, of: Column | None = None) -> Column:
    """A sequence of several root elements, as ``read_items`` gives the content of one."""
    return F.when(xml.isNotNull(), _variants(_top_items(pieces(xml) if of is None else of, 0), variants, strict))


def root_count(xml: Column, of: Column | None = None) -> Column:
    """Number of root elements: a document that is read to its end has one, and no text beside it.

    -1 where a text, CDATA or a reference stands outside of the roots.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("stray"))

    def step(acc, e):
        kind, top = e["kind"], acc["depth"] == 0
        depth = F.when(kind == "Start", acc["depth"] + 1).when(kind == "End", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        nameless = (kind == "DocType") & (trim_xml(F.substring(e["raw"], F.lit(10), F.char_length(e["raw"]) - 10)) == "")
        stray = top & (((kind == "Text") & (trim_xml(e["raw"]) != "")) | kind.isin("CData", "GeneralRef", "Error") | nameless)
        return F.struct(depth.alias("depth"), (acc["n"] + (top & kind.isin("Start", "Empty")).cast("int")).alias("n"), (acc["stray"] | stray).alias("stray"))

    return F.aggregate(pieces(xml) if of is None else of, start, step, lambda a: F.when(a["stray"], -1).otherwise(a["n"]))


def _ddl(kind: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString() if not isinstance(f.dataType, (T.StructType, T.ArrayType)) else _nested(f.dataType)}" for f in kind.fields)


def _nested(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "STRUCT<" + ", ".join(f"`{f.name}`: {_nested(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_nested(kind.elementType)}>"
    return kind.simpleString()


def optional_fields(el: DataFrame, texts: DataFrame, nil: DataFrame) -> DataFrame:
    """(doc_id, start_seq, parent_seq, name, value): leaf elements under the rules of optional values.

    Null where the element has no text, or ``xsi:nil`` is true on it or its parent;
    ``<a/>`` is a present, empty value.
    """
    leaf = el.select("doc_id", "start_seq", "end_seq", "parent_seq", "name", "kind")
    t = texts.select(F.col("doc_id"), F.col("first_seq"), "text")
    n = nil.select("doc_id", F.col("seq").alias("__n")).distinct()
    got = leaf.join(t, (leaf.doc_id == t.doc_id) & (t.first_seq == leaf.start_seq + 1), "left").select(leaf["*"], "text")
    own = n.withColumn("__own", F.lit(True)).withColumnRenamed("__n", "start_seq")
    up = n.withColumn("__up", F.lit(True)).withColumnRenamed("__n", "parent_seq")
    got = got.join(own, ["doc_id", "start_seq"], "left").join(up, ["doc_id", "parent_seq"], "left")
    value = F.when(F.col("__own") | F.col("__up"), None).when(F.col("kind") == "Empty", "").otherwise(F.nullif("text", F.lit("")))
    return got.select("doc_id", "start_seq", "parent_seq", "name", value.alias("value"))


def overlapped(el: DataFrame) -> DataFrame:
    """(doc_id, parent_seq, name): sequences whose items are parted by other siblings."""
    w = Window.partitionBy("doc_id", "parent_seq").orderBy("start_seq")
    new = F.when(F.lag("name").over(w).eqNullSafe(F.col("name")), 0).otherwise(1)
    return el.withColumn("__new", new).groupBy("doc_id", "parent_seq", "name").agg(F.sum("__new").alias("runs")).filter("runs > 1").drop("runs")


def choices(el: DataFrame, depth: int = 1) -> DataFrame:
    """(doc_id, parent_seq, variant): the first child's name chooses the variant."""
    return el.filter(F.col("depth") == depth).groupBy("doc_id", "parent_seq").agg(F.min_by("name", "start_seq").alias("variant"))


def mixed_content(ev: DataFrame, el: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, parent_seq, items): children and texts of each element in order.

    An item is a struct (seq, kind, name, text); ``kind`` is element or text; blank texts
    between elements are left out.
    """
    child = el.filter("parent_seq is not null").select("doc_id", "parent_seq", F.struct(F.col("start_seq").alias("seq"), F.lit("element").alias("kind"), "name", F.lit(None).cast("string").alias("text")).alias("i"))
    deep = with_depth(ev).select("doc_id", F.col("seq").alias("first_seq"), "depth")
    words = texts.filter(~F.col("is_blank")).select("doc_id", "first_seq", "text").join(deep, ["doc_id", "first_seq"]).filter("depth > 0")
    openers = el.select("doc_id", F.col("depth").alias("level"), F.col("start_seq").alias("from_seq"), F.col("end_seq").alias("to_seq"), F.struct(F.col("start_seq").alias("parent_seq")).alias("with"))
    owner = enclosing(words, openers, F.array(F.col("depth") - 1), seq="first_seq")
    word = owner.select("doc_id", "parent_seq", F.struct(F.col("first_seq").alias("seq"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("name"), "text").alias("i"))
    return child.unionByName(word).groupBy("doc_id", "parent_seq").agg(F.array_sort(F.collect_list("i")).alias("items"))


def tagged(xml: Column, tag: str, variants: dict[str, T.StructType | str], strict: bool = False) -> Column:
    """A struct with one field a variant: the one that attribute ``tag`` names is read, others are null."""
    which = F.from_xml(xml, f"`@{tag}` STRING", FROM_XML)[f"@{tag}"]
    return F.struct(*[F.when(which == k, read_typed(xml, s, strict)).alias(k) for k, s in variants.items()])


def custom_entities(doctype: Column) -> Column:
    """Map of the general entities that a DOCTYPE's content declares with literal values."""
    found = F.regexp_extract_all(doctype, F.lit("<!ENTITY[ \\t\\r\\n]+([^ \\t\\r\\n%]+)[ \\t\\r\\n]+(?:\"([^\"]*)\"|'([^']*)')[ \\t\\r\\n]*>"), F.lit(0))

    def pair(x: Column) -> Column:
        get = lambda i: F.regexp_extract(x, "(?s)<!ENTITY[ \\t\\r\\n]+([^ \\t\\r\\n%]+)[ \\t\\r\\n]+(?:\"([^\"]*)\"|'([^']*)')", i)
        return F.struct(get(1).alias("k"), F.concat(get(2), get(3)).alias("v"))

    return let(F.transform(found, pair), lambda ps: F.map_from_entries(F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, F.lit(1), i), lambda q: q["k"] == p["k"]))))
