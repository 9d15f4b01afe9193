"""Writing: events back to documents, elements from columns, typed rows to XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ESCAPES, cdata, escape, is_xml_name, list_escape, write_number
from ..options import TypedOptions, WriterOptions


def _lit(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def event_text(kind: Column, content: Column, options: WriterOptions = WriterOptions()) -> Column:
    """How one event is written.  Texts and contents are taken as they are (escaped)."""
    slash = " />" if options.add_space_before_slash_in_empty_elements else "/>"

    def wrap(a: str, b: str) -> Column:
        return F.concat(F.lit(a), content, F.lit(b))

    return (
        F.when(kind == "Start", wrap("<", ">"))
        .when(kind == "End", wrap("</", ">"))
        .when(kind == "Empty", wrap("<", slash))
        .when(kind.isin("Text", "Indent"), content)
        .when(kind == "Comment", wrap("<!--", "-->"))
        .when(kind == "CData", wrap("<![CDATA[", "]]>"))
        .when(kind.isin("Decl", "PI"), wrap("<?", "?>"))
        .when(kind == "DocType", wrap("<!DOCTYPE ", ">"))
        .when(kind == "GeneralRef", wrap("&", ";"))
        .otherwise("")
    )


def write_events(ev: DataFrame, options: WriterOptions = WriterOptions(), into: str = "xml") -> DataFrame:
    """(doc_id, xml): each document's events written in the order of ``seq``.

    With indentation every event but Text and CData starts a new line, unless it is the
    document's first or follows a Text or CData; errors and Eof write nothing.
    """
    rows = ev.withColumn("__s", event_text(F.col("kind"), F.coalesce("content", F.lit("")), options))
    if options.indent_size:
        w = Window.partitionBy("doc_id").orderBy("seq")
        before = F.lag("kind").over(w)
        step = F.when(F.col("kind") == "Start", 1).when(F.col("kind") == "End", -1).otherwise(0)
        depth = F.greatest(F.sum(step).over(w) - F.when(F.col("kind") == "Start", 1).otherwise(0), F.lit(0))
        markup = ~F.col("kind").isin("Text", "CData", "Error", "Eof")
        line = markup & before.isNotNull() & ~before.isin("Text", "CData")
        pad = F.when(line, F.concat(F.lit("\n"), F.repeat(F.lit(options.indent_char), (depth * options.indent_size).cast("int")))).otherwise("")
        rows = rows.withColumn("__s", F.concat(pad, "__s"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "__s")))
    text = F.array_join(F.transform(parts, lambda x: x["__s"]), "")
    if options.write_bom:
        text = F.concat(F.lit("﻿"), text)
    return rows.groupBy("doc_id").agg(text.alias(into))


def attr(key: str, value: Column, escaped: bool = False) -> Column:
    """`` key="value"``; a null value leaves the attribute out."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.lit(f' {key}="'), v if escaped else escape(v), F.lit('"')), F.lit(""))


def element(name: str | Column, *content: Column | str, attrs: dict[str, Column] | None = None, options: WriterOptions = WriterOptions(), new_lines: bool = False) -> Column:
    """An element with attributes and content (already written); empty without content.

    ``new_lines`` puts every attribute after the first on its own line, aligned below it.
    """
    n = _lit(name)
    parts = [attr(k, v) for k, v in (attrs or {}).items()]
    if new_lines and len(parts) > 1:
        pad = F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.char_length(n) + 1))
        parts = [parts[0], *[F.concat(pad, p) for p in parts[1:]]]
    head = F.concat(F.lit("<"), n, *parts)
    slash = " />" if options.add_space_before_slash_in_empty_elements else "/>"
    if not content:
        return F.concat(head, F.lit(slash))
    return F.concat(head, F.lit(">"), *[_lit(c) for c in content], F.lit("</"), n, F.lit(">"))


def text_element(name: str | Column, text: Column, **kw) -> Column:
    return element(name, escape(text), **kw)


def cdata_element(name: str | Column, text: Column, **kw) -> Column:
    return element(name, cdata(text), **kw)


def pi_element(name: str | Column, pi: Column, **kw) -> Column:
    return element(name, F.lit("<?"), pi, F.lit("?>"), **kw)


def inner(items: Column) -> Column:
    """An array of written pieces as content."""
    return F.array_join(items, "")


def declaration(version: str = "1.0", encoding: str | None = None, standalone: str | None = None) -> Column:
    out = f'<?xml version="{version}"'
    out += f' encoding="{encoding}"' if encoding is not None else ""
    out += f' standalone="{standalone}"' if standalone is not None else ""
    return F.lit(out + "?>")


class Unsupported(ValueError):
    """A type or name that has no form in XML."""


def _check_name(name: str) -> str:
    import re

    start = ":A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff"
    if not re.fullmatch(f"[{start}][{start}\\-.0-9·̀-ͯ‿-⁀]*", name):
        raise Unsupported(f"`{name}` is no name of an element or attribute")
    return name


def _simple(c: Column, kind: T.DataType, level: str, item: bool = False) -> Column:
    """A leaf as escaped text."""
    if isinstance(kind, T.BinaryType):
        raise Unsupported("bytes have no form in XML")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.ArrayType, T.StructType, T.MapType)):
            raise Unsupported("a list holds simple values only")
        items = F.transform(c, lambda x: F.coalesce(_simple(x, kind.elementType, level, True), F.lit("")))
        return F.array_join(F.filter(items, lambda x: x != ""), " ")
    if isinstance(kind, (T.StructType, T.MapType)):
        raise Unsupported("a text or attribute holds simple values only")
    text = write_number(c, kind)
    if isinstance(kind, T.StringType):
        return list_escape(text, level) if item else ESCAPES[level](text)
    return text


def to_xml(c: Column, kind: T.DataType, root: str | None, options: TypedOptions = TypedOptions()) -> Column:
    """A typed value as an XML document.

    - ``@name`` fields are attributes, left out where null; ``$text`` is text, an array in
      either a blank-separated list;
    - ``$value`` takes its struct's fields or array's items as content of the element;
    - an array field repeats its element; a map's keys become element names;
    - null, and empty text, give an empty element; a null item of an array too;
    - a choice is a struct of ``$value`` whose null fields are left out.

    ``Unsupported`` is raised for binary values, invalid names, lists of lists, plain
    values repeated in ``$value``, and an array without ``root``.
    """
    if root is None and not isinstance(kind, T.StructType):
        raise Unsupported("a value that is no struct needs the name of a root element")
    return _field(_check_name(root or "root"), c, kind, options, 0, skip_null=False)


def _empty(name: str, head: Column, options: TypedOptions) -> Column:
    if options.empty == "expanded":
        return F.concat(head, F.lit(f"></{name}>"))
    return F.concat(head, F.lit(" />" if options.empty == "self_closed_space" else "/>"))


def _pad(options: TypedOptions, level: int) -> str:
    return "\n" + options.indent_char * (options.indent * level) if options.indent else ""


#: Types whose values are never written as an empty text.
_NEVER_EMPTY = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _field(name: str, c: Column, kind: T.DataType, options: TypedOptions, level: int, skip_null: bool) -> Column:
    """One element (or, for an array, one for each item)."""
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: _field(name, x, kind.elementType, options, level, False))
        return F.coalesce(F.array_join(items, _pad(options, level)), F.lit(""))
    head = F.lit(f"<{name}")
    if isinstance(kind, T.StructType):
        out = _struct(name, c, kind, options, level)
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise Unsupported("keys of a map are strings")
        if isinstance(kind.valueType, (T.ArrayType, T.StructType, T.MapType)):
            raise Unsupported("values of a map are simple")

        def entry(e: Column) -> Column:
            text = _simple(e["value"], kind.valueType, options.quote)
            bad = F.raise_error(F.concat(F.lit("no name of an element: "), e["key"]))
            key = F.when(is_xml_name(e["key"]), e["key"]).otherwise(bad.cast("string"))
            full = F.concat(F.lit("<"), key, F.lit(">"), text, F.lit("</"), key, F.lit(">"))
            return F.when(F.coalesce(text, F.lit("")) == "", F.concat(F.lit("<"), key, F.lit("/>"))).otherwise(full)

        body = F.array_join(F.transform(F.map_entries(c), entry), _pad(options, level + 1))
        out = F.when(F.coalesce(body, F.lit("")) == "", _empty(name, head, options)).otherwise(F.concat(head, F.lit(">" + _pad(options, level + 1)), body, F.lit(_pad(options, level) + f"</{name}>")))
    elif isinstance(kind, _NEVER_EMPTY):
        # the text is asked for once: it is null where the value is, and never empty
        full = F.concat(head, F.lit(">"), _simple(c, kind, options.quote), F.lit(f"</{name}>"))
        return F.coalesce(full, F.lit("") if skip_null else _empty(name, head, options))
    else:
        if options.text == "cdata" and isinstance(kind, T.StringType):
            text = F.when(c != "", cdata(c))
        else:
            text = _simple(c, kind, options.quote)
        out = F.when(F.coalesce(text, F.lit("")) == "", _empty(name, head, options)).otherwise(F.concat(head, F.lit(">"), text, F.lit(f"</{name}>")))
    return F.when(c.isNull(), F.lit("") if skip_null else _empty(name, head, options)).otherwise(out)


def _struct(name: str, c: Column, kind: T.StructType, options: TypedOptions, level: int) -> Column:
    attrs, pieces = [], []  # pieces: (written content, is text)
    solid = False  # an element is always there, so the content is not empty
    for f in kind.fields:
        v = c[f.name]
        if f.name.startswith("@"):
            key = _check_name(f.name[1:])
            text = _simple(v, f.dataType, "full", isinstance(f.dataType, T.ArrayType))
            attrs.append(F.coalesce(F.concat(F.lit(f' {key}="'), text, F.lit('"')), F.lit("")))
        elif f.name == "$text":
            t = cdata(v) if options.text == "cdata" and isinstance(f.dataType, T.StringType) else _simple(v, f.dataType, options.quote)
            pieces.append((F.coalesce(F.when(v.isNull(), None).otherwise(t), F.lit("")), True))
        elif f.name == "$value":
            pieces += _content(v, f.dataType, options, level)
        else:
            pieces.append((_field(_check_name(f.name), v, f.dataType, options, level + 1, False), False))
            solid = solid or not isinstance(f.dataType, T.ArrayType)
    head = F.concat(F.lit(f"<{name}"), *attrs)
    if not pieces:
        return _empty(name, head, options)
    # an element starts a line of its own unless a text stands before it
    line, fresh, parts = _pad(options, level + 1), True, []
    for piece, is_text in pieces:
        parts.append(piece if is_text or not fresh or not line else F.when(piece == "", "").otherwise(F.concat(F.lit(line), piece)))
        fresh = not is_text
    body = F.concat(*parts)
    close = F.lit((_pad(options, level) if fresh else "") + f"</{name}>")
    full = F.concat(head, F.lit(">"), body, close)
    return full if solid else F.when(body == "", _empty(name, head, options)).otherwise(full)


def _content(v: Column, kind: T.DataType, options: TypedOptions, level: int) -> list[tuple[Column, bool]]:
    """Content of ``$value``: fields that are there, in order, or the items of an array."""
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            x = v[f.name]
            if f.name == "$text":
                out.append((F.coalesce(_simple(x, f.dataType, options.quote), F.lit("")), True))
            else:
                out.append((_field(_check_name(f.name), x, f.dataType, options, level + 1, True), False))
        return out
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, T.StructType):
            raise Unsupported("plain values repeated in $value would run together")

        def item(x: Column) -> Column:
            return F.concat(*[p for p, _ in _content(x, kind.elementType, options, level)])

        return [(F.coalesce(F.array_join(F.transform(v, item), _pad(options, level + 1)), F.lit("")), False)]
    return [(F.coalesce(_simple(v, kind, options.quote), F.lit("")), True)]
