"""Namespaces: declarations are intervals, resolution looks for the nearest that holds a name.

A declaration holds from its element's start to its end.  A name's binding is the one of
its prefix declared nearest around it: the greatest depth among the intervals that hold
the name.  Where names come with their depth, they look for it by a window a level; others
are joined by document and prefix, with a range filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import local_name, prefix
from .attributes import XSI, attribute_array, attributes
from .tree import enclosing, with_depth

# The two namespaces that are always bound.
XML_NS, XMLNS_NS = "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2000/xmlns/"


def binding_prefix(key: Column) -> Column:
    """Prefix that an attribute declares (empty: the default); null for other attributes."""
    return F.when(key == "xmlns", "").when(key.startswith("xmlns:"), F.substring(key, F.lit(7), F.char_length(key)))


def binding_error(pre: Column, uri: Column) -> Column:
    """Why a declaration is forbidden: the reserved prefixes and names; else null."""
    return (
        F.when(pre == "xml", F.when(uri != XML_NS, "InvalidXmlPrefixBind"))
        .when(pre == "xmlns", "InvalidXmlnsPrefixBind")
        .when(uri == XML_NS, "InvalidPrefixForXml")
        .when(uri == XMLNS_NS, "InvalidPrefixForXmlns")
    )


def bindings(ev: DataFrame | None, el: DataFrame) -> DataFrame:
    """(doc_id, from_seq, to_seq, level, prefix, uri, error) of all declarations.

    ``level`` is the element's depth plus one (level zero has the reserved two).  Only
    ``el`` is read.
    """
    tags = el.select("doc_id", F.col("start_seq").alias("seq"), "kind", "attrs_raw", "end_seq", "depth")
    # an element has its own attributes: no other reading of the events, no join
    a = F.explode(F.filter(attribute_array(F.col("attrs_raw")), lambda x: binding_prefix(x["key"]).isNotNull()))
    out = tags.filter(F.col("attrs_raw").contains("xmlns")).select("doc_id", "seq", "end_seq", "depth", a.alias("a"))
    pre, uri = binding_prefix(F.col("a.key")), F.col("a.value")
    return out.select("doc_id", F.col("seq").alias("from_seq"), F.col("end_seq").alias("to_seq"), (F.col("depth") + 1).alias("level"), F.col("a.pos").alias("pos"), pre.alias("prefix"), uri.alias("uri"), binding_error(pre, uri).alias("error"))


def resolve(names: DataFrame, bound: DataFrame, name: str = "name", seq: str = "seq", use_default: bool = True) -> DataFrame:
    """Adds ``ns_status`` (Bound, Unbound, Unknown), ``ns_uri`` and ``local``.

    ``use_default``: names without a prefix take the default namespace (elements do,
    attributes do not).  An empty name unbinds: the default is then Unbound, a prefix
    Unknown.  Needs ``doc_id`` and a ``seq`` that with ``pos``, if there is one, tells
    the rows of a document apart.
    """
    keys = [c for c in ("doc_id", seq, "pos") if c in names.columns]
    pre = prefix(F.col(name))
    rows = names.withColumn("__p", F.coalesce(pre, F.lit("")))
    if not use_default:
        rows = rows.withColumn("__p", F.when(pre.isNotNull(), F.col("__p")))
    rest = [c for c in rows.columns if c not in keys]
    good = bound.filter("error is null")
    if "depth" in names.columns:
        # declarations of one element and prefix: the last one counts
        last = good.groupBy("doc_id", "level", "from_seq", "to_seq", F.col("prefix").alias("__p")).agg(F.max_by("uri", "pos").alias("__uri"))
        openers = last.select("doc_id", "level", "from_seq", "to_seq", "__p", F.struct("__uri").alias("with"))
        hit = enclosing(rows.filter("__p is not null"), openers, F.sequence(F.lit(1), F.col("depth") + 1), ["__p"], seq).select(*keys, "level", "__uri", *rest)
        # names that nothing binds meet nothing
        hit = hit.unionByName(rows.withColumns({"level": F.lit(0), "__uri": F.lit(None).cast("string")}).select(*keys, "level", "__uri", *rest))
        out = hit.groupBy(*keys).agg(F.max_by("__uri", "level").alias("__uri"), *[F.first(c).alias(c) for c in rest])
    else:
        good = good.select(F.col("doc_id").alias("__d"), "from_seq", "to_seq", "level", F.col("pos").alias("__bpos"), F.col("prefix").alias("__bp"), F.col("uri").alias("__uri"))
        hit = rows.join(good, (F.col("doc_id") == F.col("__d")) & (F.col("__p") == F.col("__bp")) & (F.col(seq) >= F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col(seq) <= F.col("to_seq"))), "left")
        # the row itself goes through the aggregation, so that it is read once
        out = hit.groupBy(*keys).agg(F.max_by("__uri", F.struct("level", "__bpos")).alias("__uri"), *[F.first(c).alias(c) for c in rest])
    uri = F.when(F.col("__p") == "xml", XML_NS).when(F.col("__p") == "xmlns", XMLNS_NS).otherwise(F.col("__uri"))
    plain = pre.isNull()
    status = F.when(uri.isNotNull() & (uri != ""), "Bound").when(plain, "Unbound").otherwise("Unknown")
    return out.withColumns({"ns_status": status, "ns_uri": F.when(status == "Bound", uri), "local": local_name(F.col(name))}).drop("__p", "__uri")


def resolve_elements(el: DataFrame, bound: DataFrame) -> DataFrame:
    return resolve(el.withColumn("seq", F.col("start_seq")), bound).drop("seq")


def resolve_events(ev: DataFrame, el: DataFrame, bound: DataFrame) -> DataFrame:
    """Start, Empty and End events with their namespace; all others are Unbound."""
    tags = F.col("kind").isin("Start", "Empty", "End")
    got = resolve(ev.filter(tags), bound)
    rest = ev.filter(~tags).withColumns({"ns_status": F.lit("Unbound"), "ns_uri": F.lit(None).cast("string"), "local": F.lit(None).cast("string")})
    return got.unionByName(rest)


def resolve_in_place(ev: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``resolve_events`` from the events alone, which are read but once: no join, no union.

    A tag asks at each level around it, a declaring one tells at its own; the last that told
    of a prefix at a level binds whatever its element holds.  ``keep``: columns wanted besides
    ``doc_id`` and ``seq``, ``name`` among them (by default all).
    """
    keep = [c for c in ev.columns if c not in ("doc_id", "seq")] if keep is None else keep
    tag = F.col("kind").isin("Start", "Empty", "End")
    # at a start's own depth its end tag follows: all between is deeper
    end = F.when(F.col("kind") == "Empty", F.col("seq")).otherwise(F.lead("seq").over(Window.partitionBy("doc_id", "depth").orderBy("seq")))
    declares = F.col("kind").isin("Start", "Empty") & F.col("attrs_raw").contains("xmlns")
    rows = with_depth(ev).select("doc_id", "seq", "depth", end.alias("__to"), F.when(tag, F.coalesce(prefix(F.col("name")), F.lit(""))).alias("__p"), F.when(declares, F.col("attrs_raw")).alias("__a"), F.struct(F.lit(True).alias("there"), *keep).alias("__row"))
    kind = "array<struct<level:int,p:string,uri:string,pos:int,asks:boolean>>"
    none = F.lit(None).cast("string")
    levels = F.sequence(F.lit(0), F.when(F.col("__p").isNull(), 0).otherwise(F.col("depth") + 1))
    asks = F.transform(levels, lambda n: F.struct(n.alias("level"), F.col("__p").alias("p"), none.alias("uri"), F.lit(0).alias("pos"), F.lit(True).alias("asks"))).cast(kind)
    told = F.transform(attribute_array(F.col("__a")), lambda a: F.struct((F.col("depth") + 1).alias("level"), binding_prefix(a["key"]).alias("p"), a["value"].alias("uri"), a["pos"].alias("pos"), F.lit(False).alias("asks"))).cast(kind)
    told = F.filter(told, lambda t: t["p"].isNotNull() & binding_error(t["p"], t["uri"]).isNull())
    items = F.when(F.col("__a").isNull(), asks).otherwise(F.concat(asks, told))
    x = rows.withColumn("__x", F.explode(items)).select("doc_id", "seq", "__to", "__x.*", F.when(F.col("__x.asks") & (F.col("__x.level") == 0), F.col("__row")).alias("__row"))
    w = Window.partitionBy("doc_id", "level", "p").orderBy("seq", "asks", "pos")
    x = x.withColumn("__o", F.last(F.when(~F.col("asks"), F.struct("uri", F.col("__to").alias("to"))), ignorenulls=True).over(w)).filter("asks")
    holds = F.col("__o").isNotNull() & (F.col("__o.to").isNull() | (F.col("seq") <= F.col("__o.to")))
    out = x.groupBy("doc_id", "seq").agg(F.max_by("__o.uri", F.when(holds, F.col("level"))).alias("__uri"), F.max("p").alias("__p"), F.first("__row", ignorenulls=True).alias("__row"))
    p = F.col("__p")
    uri = F.when(p == "xml", XML_NS).when(p == "xmlns", XMLNS_NS).otherwise(F.col("__uri"))
    out = out.select("doc_id", "seq", *[F.col("__row")[c].alias(c) for c in keep], p, uri.alias("__uri"))
    status = F.when(p.isNotNull() & (F.col("__uri") != ""), "Bound").when(p.isNull() | ((p == "") & ~F.contains("name", F.lit(":"))), "Unbound").otherwise("Unknown")
    tagged = F.when(p.isNotNull(), local_name(F.col("name")))
    return out.withColumns({"ns_status": status, "ns_uri": F.when(status == "Bound", F.col("__uri")), "local": tagged}).drop("__p", "__uri")


def resolve_attributes(attrs: DataFrame, bound: DataFrame) -> DataFrame:
    return resolve(attrs, bound, name="key", use_default=False)


def in_scope(el: DataFrame, bound: DataFrame) -> DataFrame:
    """(doc_id, start_seq, prefix, uri): declarations seen from each element, shadowed ones left out."""
    # a declaring element opens its level with all it declares
    b = bound.filter("error is null").groupBy("doc_id", "level", "from_seq", "to_seq").agg(F.collect_list(F.struct("prefix", "uri", "pos")).alias("all"))
    openers = b.select("doc_id", "level", "from_seq", "to_seq", F.struct("all").alias("with"))
    hit = enclosing(el.select("doc_id", "start_seq", "depth"), openers, F.sequence(F.lit(1), F.col("depth") + 1), seq="start_seq")
    hit = hit.select("doc_id", "start_seq", "level", F.explode("all").alias("b"))
    near = hit.groupBy("doc_id", "start_seq", F.col("b.prefix").alias("prefix")).agg(F.max_by("b.uri", F.struct("level", "b.pos")).alias("uri"))
    return near.filter("uri <> ''")


def nil_elements(ev: DataFrame, bound: DataFrame) -> DataFrame:
    """(doc_id, seq): tags with an attribute ``nil`` of the schema-instance namespace that is true."""
    a = resolve_attributes(attributes(ev).filter(F.col("local") == "nil").drop("local"), bound)
    return a.filter((F.col("ns_uri") == XSI) & F.col("as_bool")).select("doc_id", "seq").distinct()
