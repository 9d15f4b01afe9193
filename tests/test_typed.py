"""Typed reading and writing, files, and streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem import sources
from xylem.operators import bind, emit, events, namespaces, tree
from xylem.options import TypedOptions
from xylem.streaming import stream_events


def read(spark, xml, schema, **kw):
    r = spark.createDataFrame([(xml,)], "c string").select(bind.read_typed(F.col("c"), schema, **kw).alias("r")).first().r
    return None if r is None else r.asDict(True)


def test_read(spark):
    schema = "`@n` INT, t STRING, b BOOLEAN, xs ARRAY<INT>, s STRUCT<`$text`: ARRAY<INT>, `@l`: ARRAY<STRING>>, gone STRING"
    xml = "<p:r n=' 7 ' xmlns:p='u'><p:t>a&amp;<![CDATA[<b>]]></p:t><b>0</b><xs>1</xs><other/><xs> 2 </xs><s l='a  b'>1\t2</s></p:r>"
    assert read(spark, xml, schema) == {"@n": 7, "t": "a&<b>", "b": False, "xs": [1, 2], "s": {"$text": [1, 2], "@l": ["a", "b"]}, "gone": None}


def test_read_problems(spark):
    assert read(spark, "<r><b>yes</b><n>x</n></r>", "b BOOLEAN, n INT") == {"b": None, "n": None}
    assert read(spark, "<r><n>1</m></r>", "n INT") is None
    assert read(spark, None, "n INT") is None
    with pytest.raises(Exception, match="not a int"):
        read(spark, "<r><n>x</n></r>", "n INT", strict=True)


def test_nil(docs):
    xml = "<r xmlns:x='http://www.w3.org/2001/XMLSchema-instance'><a x:nil='1'>v</a><b/><c>v</c><d x:nil='false'>v</d><e nil='true'>v</e></r>"
    ev = events.events(docs(xml))
    el = tree.elements(ev)
    nil = namespaces.nil_elements(ev, namespaces.bindings(ev, el))
    got = {r.name: r.value for r in bind.optional_fields(el.filter("depth = 1"), events.merged_text(ev), nil).collect()}
    assert got == {"a": None, "b": "", "c": "v", "d": "v", "e": "v"}


def write(spark, value, schema, root="r", **kw):
    kind = T.StructType.fromDDL(f"v {schema}")
    return spark.createDataFrame([(value,)], kind).select(emit.to_xml(F.col("v"), kind["v"].dataType, root, TypedOptions(**kw)).alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "schema", "kw", "xml"),
    [
        (("<a", "t", None, ""), "STRUCT<`@a`: STRING, `$text`: STRING, n: INT, e: STRING>", {}, '<r a="&lt;a">t<n/><e/></r>'),
        ((None,), "STRUCT<`@a`: STRING>", {}, "<r/>"),
        ((None,), "STRUCT<`@a`: STRING>", {"empty": "self_closed_space"}, "<r />"),
        ((None,), "STRUCT<`@a`: STRING>", {"empty": "expanded"}, "<r></r>"),
        (([1, None],), "STRUCT<i: ARRAY<INT>>", {}, "<r><i>1</i><i/></r>"),
        ((True, 1), "STRUCT<b: BOOLEAN, i: BIGINT>", {"indent": 2}, "<r>\n  <b>true</b>\n  <i>1</i>\n</r>"),
        ((1, "t", 2), "STRUCT<a: INT, `$text`: STRING, b: INT>", {"indent": 2}, "<r>\n  <a>1</a>t<b>2</b>\n</r>"),
        (("'\">",), "STRUCT<t: STRING>", {"quote": "full"}, "<r><t>&apos;&quot;&gt;</t></r>"),
        (("'\">",), "STRUCT<t: STRING>", {"quote": "minimal"}, "<r><t>'\"></t></r>"),
        (("a]]>",), "STRUCT<t: STRING>", {"text": "cdata"}, "<r><t><![CDATA[a]]]]><![CDATA[>]]></t></r>"),
        (([(1, None), (None, "x")],), "STRUCT<`$value`: ARRAY<STRUCT<one: INT, two: STRING>>>", {}, "<r><one>1</one><two>x</two></r>"),
        (({"k": 1},), "STRUCT<m: MAP<STRING, INT>>", {}, "<r><m><k>1</k></m></r>"),
        ((((1,),),), "STRUCT<a: STRUCT<b: STRUCT<c: INT>>>", {"indent": 1}, "<r>\n <a>\n  <b>\n   <c>1</c>\n  </b>\n </a>\n</r>"),
    ],
)
def test_write(spark, value, schema, kw, xml):
    assert write(spark, value, schema, **kw) == xml


@pytest.mark.parametrize(
    ("schema", "root"),
    [("STRUCT<b: BINARY>", "r"), ("STRUCT<`1a`: INT>", "r"), ("STRUCT<`$text`: ARRAY<ARRAY<INT>>>", "r"), ("STRUCT<`$value`: ARRAY<INT>>", "r"), ("ARRAY<INT>", None), ("STRUCT<`@a`: STRUCT<b: INT>>", "r"), ("STRUCT<a: INT>", "a b")],
)
def test_write_unsupported(spark, schema, root):
    kind = T.StructType.fromDDL(f"v {schema}")["v"].dataType
    with pytest.raises(emit.Unsupported):
        emit.to_xml(F.lit(None), kind, root)


def test_bad_map_key(spark):
    with pytest.raises(Exception, match="no name of an element"):
        write(spark, ({"a b": 1},), "STRUCT<m: MAP<STRING, INT>>")


def test_write_read(spark):
    schema = "STRUCT<`@id`: INT, t: STRING, xs: ARRAY<INT>>"
    assert read(spark, write(spark, (3, "a<&b", [1, 2]), schema), "`@id` INT, t STRING, xs ARRAY<INT>") == {"@id": 3, "t": "a<&b", "xs": [1, 2]}


def test_elements(spark):
    x = emit.element("n", emit.text_element("t", F.lit("<")), emit.cdata_element("c", F.lit("&")), emit.inner(F.array(F.lit("<i/>"), F.lit("<i/>"))), attrs={"a": F.lit(1), "b": F.lit(None), "c": F.lit('"')})
    y = emit.element("n", attrs={"a": F.lit(1), "b": F.lit(2)}, new_lines=True)
    r = spark.range(1).select(x.alias("x"), y.alias("y"), emit.declaration("1.1", "utf-8", "yes").alias("d")).first()
    assert r.x == '<n a="1" c="&quot;"><t>&lt;</t><c><![CDATA[&]]></c><i/><i/></n>'
    assert r.y == '<n a="1"\n   b="2"/>'
    assert r.d == '<?xml version="1.1" encoding="utf-8" standalone="yes"?>'


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes("<?xml version='1.0' encoding='iso-8859-2'?><ř/>".encode("iso-8859-2"))
    (tmp_path / "b.xml").write_bytes(b"\xef\xbb\xbf<b/>")
    got = {r.path.rsplit("/", 1)[1]: r.xml for r in sources.read_documents(spark, str(tmp_path), glob="*.xml").collect()}
    assert got == {"a.xml": "<?xml version='1.0' encoding='iso-8859-2'?><ř/>", "b.xml": "<b/>"}
    assert sources.read_utf8_documents(spark, str(tmp_path / "b.xml")).first().xml == "<b/>"
    spark.createDataFrame([(1, "x"), (2, "y")], "`@id` int, t string").coalesce(1).write.format("xml").option("rowTag", "row").option("attributePrefix", "@").save(str(tmp_path / "rows"))
    back = sources.read_rows(spark, str(tmp_path / "rows"), "row", "`@id` INT, t STRING").orderBy("t").collect()
    assert [tuple(r) for r in back] == [(1, "x"), (2, "y")]
    sources.write_documents(spark.createDataFrame([("<a/>",)], "xml string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "<a/>"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.txt").write_text("<a><b/></a>")
    (src / "two.txt").write_text("<a>& broken</a>")
    stream = spark.readStream.format("text").option("wholetext", "true").load(str(src)).select(F.lit(1).alias("doc_id"), F.col("value").alias("xml"))
    q = stream_events(stream).writeStream.format("memory").queryName("xml_events").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["kind"]: r["count"] for r in spark.table("xml_events").groupBy("kind").count().collect()}
    assert got == {"Start": 2, "Empty": 1, "End": 2, "Error": 1}


def test_entity_map_of_doctype(spark):
    df = spark.createDataFrame([('r [<!ENTITY a "1"><!ENTITY b \'2\'><!ENTITY a "3"><!ENTITY % p "x">]',)], "c string")
    assert df.select(bind.custom_entities(F.col("c")).alias("m")).first().m == {"a": "1", "b": "2"}


def test_typed_maps(spark):
    assert read(spark, "<r><m><a> 1 </a><b>x</b></m></r>", "m MAP<STRING, INT>") == {"m": {"a": 1, "b": None}}


def items(spark, xml, variants, f=bind.read_items):
    got = spark.createDataFrame([(xml,)], "c string").select(f(F.col("c"), variants).alias("i")).first().i
    return None if got is None else [tuple(x.asDict(True).values()) for x in got]


def test_items(spark):
    xml = "<r>one &lt; <![CDATA[two]]><a>1</a> <!-- c --><a/>\n<p:b k='2'>t<c/></p:b>end&#33;</r>"
    assert items(spark, xml, {"a": "INT", "b": "STRUCT<`@k`: INT, `$text`: STRING>"}) == [("$text", "one < two", None, None), ("a", None, 1, None), ("a", None, None, None), ("b", None, None, {"@k": 2, "$text": "t"}), ("$text", "end!", None, None)]
    assert items(spark, "<r/>", {"a": "INT"}) == []
    assert items(spark, None, {"a": "INT"}) is None
    assert items(spark, "<r><x><a>1</a></x><a>2</a></r>", {"a": "INT"}) == [("x", None, None), ("a", None, 2)]


def test_roots(spark):
    assert items(spark, "<?xml version='1.0'?><a>1</a>\n<b>t</b><a>2</a>", {"a": "INT", "b": "STRING"}, bind.read_roots) == [("a", None, 1, None), ("b", None, None, "t"), ("a", None, 2, None)]
    docs = [("<a/>", 1), ("<a/> <!-- --> ", 1), ("", 0), ("<a/><b></b>", 2), ("<a/>x", -1), ("x<a/>", -1), ("<a>x</a>&amp;", -1)]
    got = spark.createDataFrame(docs, "c string, n int").select(bind.root_count(F.col("c")).alias("g"), "n").collect()
    assert [r.g for r in got] == [r.n for r in got]
