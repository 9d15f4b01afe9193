"""Tree structure as intervals: depth, pairing of tags, parents, spans, subtrees.

Every node of a document has the interval [start_seq, end_seq] of its events; a node is
inside another when its interval is.  All of it comes from windows over the events of a
document, so one shuffle by document serves the whole relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import ReaderOptions


def with_depth(ev: DataFrame) -> DataFrame:
    """Adds ``depth`` (root elements have 0) and ``unmatched`` (an end without a start).

    An unmatched end leaves the depth at zero, as an empty stack stays empty; a
    mismatched one still closes the last open element.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    is_end = (F.col("kind") == "End") | ((F.col("kind") == "Error") & F.col("raw").startswith("</"))
    step = F.when(F.col("kind") == "Start", 1).when(is_end, -1).otherwise(0)
    out = ev.withColumn("__s", F.sum(step).over(w))
    out = out.withColumn("__low", F.least(F.min("__s").over(w), F.lit(0)))
    out = out.withColumn("__before", F.coalesce(F.lag("__low").over(w), F.lit(0)))
    after = F.col("__s") - F.col("__low")
    out = out.withColumn("unmatched", is_end & (F.col("__s") < F.col("__before")))
    return out.withColumn("depth", F.when(F.col("kind") == "Start", after - 1).otherwise(after).cast("int")).drop("__s", "__low", "__before")


def _paired(ev: DataFrame) -> DataFrame:
    """Tags with what follows at their depth: the end tag of an open one, and its place."""
    rows = with_depth(ev).filter(F.col("kind").isin("Start", "Empty", "End") | ((F.col("kind") == "Error") & F.col("raw").startswith("</")))
    rows = rows.filter(~F.col("unmatched"))
    w = Window.partitionBy("doc_id", "depth").orderBy("seq")
    return rows.withColumns({"__end": F.lead("seq").over(w), "__name": F.lead("name").over(w), "__raw": F.lead("raw").over(w)} | {f"__{c}": F.lead(c).over(w) for c in ("byte_start", "char_start") if c in ev.columns})


def elements(ev: DataFrame) -> DataFrame:
    """(doc_id, start_seq, end_seq, depth, parent_seq, name, attrs_raw, kind) of each element.

    ``end_seq`` is the element's own ``seq`` where it is empty, null where it never
    closes.  ``parent_seq`` is the start of the enclosing element, null at depth 0.  Of
    events with offsets the inside's are given too: ``in_byte_start`` and the like.
    """
    places = []
    if "byte_end" in ev.columns:
        places = [F.col("byte_end").alias("in_byte_start"), F.col("char_end").alias("in_char_start"), F.col("__byte_start").alias("in_byte_end"), F.col("__char_start").alias("in_char_end")]
    node = _paired(ev).filter(F.col("kind").isin("Start", "Empty"))
    node = node.select("doc_id", F.col("seq").alias("start_seq"), F.when(F.col("kind") == "Empty", F.col("seq")).otherwise(F.col("__end")).alias("end_seq"), "depth", "name", "attrs_raw", "kind", *places)
    # a start opens the level below itself; the last opener before a node is its parent
    level = F.explode(F.when(F.col("kind") == "Start", F.array(F.struct(F.col("depth").alias("at"), F.lit(False).alias("opens")), F.struct((F.col("depth") + 1).alias("at"), F.lit(True).alias("opens")))).otherwise(F.array(F.struct(F.col("depth").alias("at"), F.lit(False).alias("opens")))))
    rows = node.withColumn("__l", level)
    w = Window.partitionBy("doc_id", F.col("__l.at")).orderBy("start_seq")
    rows = rows.withColumn("parent_seq", F.last(F.when(F.col("__l.opens"), F.col("start_seq")), ignorenulls=True).over(w))
    more = [c for c in node.columns if c.startswith("in_")]
    return rows.filter(~F.col("__l.opens")).select("doc_id", "start_seq", "end_seq", "depth", "parent_seq", "name", "attrs_raw", "kind", *more)


def check_ends(ev: DataFrame, options: ReaderOptions = ReaderOptions()) -> DataFrame:
    """Events with end tags checked: an error takes the place of a wrong one.

    Adds offsets, so that errors carry their byte position.
    """
    from .events import with_offsets

    rows = with_depth(with_offsets(ev))
    w = Window.partitionBy("doc_id", "depth").orderBy("seq")
    tag = F.col("kind").isin("Start", "End", "Empty") & ~F.col("unmatched")
    open_name = F.last(F.when(tag & (F.col("kind") == "Start"), F.col("name")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__open", open_name)
    is_end = F.col("kind") == "End"
    code = F.lit(None).cast("string")
    if not options.allow_unmatched_ends:
        code = F.when(is_end & F.col("unmatched"), "UnmatchedEndTag")
    if options.check_end_names:
        code = F.coalesce(code, F.when(is_end & ~F.col("unmatched") & ~F.col("name").eqNullSafe(F.col("__open")), "MismatchedEndTag"))
    msg = F.when(code == "MismatchedEndTag", F.concat(F.lit("expected `</"), F.coalesce("__open", F.lit("")), F.lit(">`, but `</"), "name", F.lit(">` was found"))).otherwise(F.concat(F.lit("`</"), "name", F.lit(">` has no start")))
    error = F.struct(F.lit("IllFormed").alias("class"), code.alias("code"), F.col("byte_start").alias("pos"), msg.alias("msg"))
    return rows.withColumns({"error": F.when(code.isNotNull(), error).otherwise(F.col("error")), "kind": F.when(code.isNotNull(), "Error").otherwise(F.col("kind"))}).drop("__open", "unmatched", "depth")


def spans(ev: DataFrame, el: DataFrame, name: str | None = None) -> DataFrame:
    """(doc_id, start_seq, name, byte_start, byte_end, char_start, char_end) of the inside of elements.

    ``ev`` needs offsets.  An element that never closes has a null end and the error
    ``MissingEndTag``.  Elements without inside (``<a/>``) are left out.
    """
    want = el.filter("kind = 'Start'") if name is None else el.filter((F.col("kind") == "Start") & (F.col("name") == name))
    if "in_byte_start" in el.columns:  # elements of events with offsets know them
        out = want.select("doc_id", "start_seq", "end_seq", "name", *[F.col(f"in_{c}").alias(c) for c in ("byte_start", "char_start", "byte_end", "char_end")])
    else:
        a = ev.select("doc_id", F.col("seq").alias("start_seq"), F.col("byte_end").alias("byte_start"), F.col("char_end").alias("char_start"))
        b = ev.select("doc_id", F.col("seq").alias("end_seq"), F.col("byte_start").alias("byte_end"), F.col("char_start").alias("char_end"))
        out = want.select("doc_id", "start_seq", "end_seq", "name").join(a, ["doc_id", "start_seq"]).join(b, ["doc_id", "end_seq"], "left")
    return out.withColumn("error", F.when(F.col("end_seq").isNull(), "MissingEndTag")).drop("end_seq")


def inner_text(docs: DataFrame, sp: DataFrame, doc_id: str = "doc_id", xml: str = "xml", options: ReaderOptions = ReaderOptions()) -> DataFrame:
    """Adds ``inner``: the raw source between an element's tags, not unescaped.

    ``options`` are those by which the events of ``sp`` were read.
    """
    from .events import source

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(xml).alias("__xml"))
    text = F.substring(source(F.col("__xml"), options), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    return sp.join(d, "doc_id").withColumn("inner", text).drop("__xml")


def enclosing(rows: DataFrame, openers: DataFrame, levels: Column, by: list[str] = [], seq: str = "seq") -> DataFrame:  # noqa: B006
    """Rows with each of ``openers`` whose interval holds them, by level: no join.

    ``openers`` has (doc_id, level, from_seq, to_seq, ``by``, with what else is wanted in a
    struct ``with``); intervals of one level and ``by`` do not overlap, so only the last one
    that begins before a row can hold it.  ``levels``: an array of the levels at which a row
    looks.  A row at the very start of an interval is inside.
    """
    ask = rows.select("doc_id", F.explode(levels).alias("level"), *by, F.col(seq).alias("__at"), F.struct(*rows.columns).alias("__row"))
    tell = openers.select("doc_id", "level", *by, F.col("from_seq").alias("__at"), F.struct("to_seq", "with").alias("__o"))
    both = ask.withColumn("__o", F.lit(None).cast(tell.schema["__o"].dataType)).unionByName(tell.withColumn("__row", F.lit(None).cast(ask.schema["__row"].dataType)))
    # an opener comes before the rows at its own place
    w = Window.partitionBy("doc_id", "level", *by).orderBy("__at", F.col("__o").isNull())
    held = both.withColumn("__in", F.last("__o", ignorenulls=True).over(w)).filter("__row is not null and __in is not null")
    held = held.filter(F.col("__in.to_seq").isNull() | (F.col("__at") <= F.col("__in.to_seq")))
    return held.select("__row.*", "level", "__in.with.*")


def inside(rows: DataFrame, el: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows joined with every element whose interval holds them (strictly inside).

    Rows with their ``depth`` are met by a window a level, in proportion to the result;
    without it by a join over the whole document.
    """
    if "depth" in rows.columns:
        openers = el.select("doc_id", F.col("depth").alias("level"), F.col("start_seq").alias("from_seq"), F.col("end_seq").alias("to_seq"), F.struct(F.col("start_seq").alias("of_seq"), F.col("name").alias("of_name")).alias("with"))
        got = enclosing(rows.filter("depth > 0"), openers, F.sequence(F.lit(0), F.col("depth") - 1), seq=seq)
        return got.filter(F.col(seq) > F.col("of_seq")).drop("level")
    e = el.select("doc_id", F.col("start_seq").alias("of_seq"), F.col("end_seq").alias("__to"), F.col("name").alias("of_name"))
    return rows.join(e, "doc_id").filter((F.col(seq) > F.col("of_seq")) & (F.col("__to").isNull() | (F.col(seq) < F.col("__to")))).drop("__to")


def skip_subtrees(ev: DataFrame, name: str) -> DataFrame:
    """Events without the elements called ``name`` and all they hold; no join.

    An event is skipped while any such element is open or it belongs to one itself.
    """
    rows = with_depth(ev)
    w = Window.partitionBy("doc_id").orderBy("seq")
    opens = (F.col("kind") == "Start") & (F.col("name") == name)
    # the depth of the outermost open element of the name closes at the first end there
    pair = Window.partitionBy("doc_id", "depth").orderBy("seq")
    tag = F.col("kind").isin("Start", "End") & ~F.col("unmatched")
    owner = F.last(F.when(tag & (F.col("kind") == "Start"), F.col("name")), ignorenulls=True).over(pair)
    rows = rows.withColumn("__owner", owner)
    step = F.when(opens, 1).when((F.col("kind") == "End") & ~F.col("unmatched") & (F.col("__owner") == name), -1).otherwise(0)
    rows = rows.withColumn("__in", F.sum(step).over(w) - F.when(opens, 0).otherwise(step))
    gone = (F.col("__in") > 0) | ((F.col("kind") == "Empty") & (F.col("name") == name))
    return rows.filter(~gone).select(*ev.columns)


def tag_counts(ev: DataFrame) -> DataFrame:
    """(doc_id, n_tags): starts and empties of each document."""
    return ev.filter(F.col("kind").isin("Start", "Empty")).groupBy("doc_id").agg(F.count("*").alias("n_tags"))
