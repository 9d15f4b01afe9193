"""Scalar functions on texts and encodings."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.functions import encoding, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "plain", "strict"),
    [
        ("a&amp;lt;b&lt;c", "a&lt;b<c", "a&lt;b<c"),
        ("&#65;&#x41;&#x1F600;", "AA😀", "AA😀"),
        ("&#0;&#xD800;&#x110000;&#-1;&#X41;", "&#0;&#xD800;&#x110000;&#-1;&#X41;", None),
        ("&#00000000000000000000000065;", "A", "A"),
        ("&nope; & &", "&nope; & &", None),
        ("plain", "plain", "plain"),
        ("", "", ""),
    ],
)
def test_unescape(spark, raw, plain, strict):
    assert one(spark, raw, text.unescape) == plain
    assert one(spark, raw, lambda c: text.unescape(c, strict=True)) == strict


@pytest.mark.parametrize(
    ("raw", "code", "name"),
    [("&x;", "UnrecognizedEntity", "x"), ("a&", "UnterminatedEntity", None), ("&lt;&#0;", "InvalidCharRef.IllegalCharacter", "#0"), ("&#+1;", "InvalidCharRef.UnexpectedSign", "#+1"), ("&#x;", "InvalidCharRef.InvalidNumber", "#x"), ("&#xD800;", "InvalidCharRef.InvalidCodepoint", "#xD800")],
)
def test_unescape_errors(spark, raw, code, name):
    assert tuple(one(spark, raw, text.unescape_error)) == (code, name)


def test_custom_and_html_entities(spark):
    assert one(spark, "&who;&lt;", lambda c: text.unescape(c, F.create_map(F.lit("who"), F.lit("me")))) == "me<"
    assert one(spark, "&nbsp;&planck;&NotEqualTilde;", lambda c: text.unescape(c, kind="html")) == "\xa0ℏ≂̸"


def test_escapes(spark):
    raw = "<a & 'b' \"c\">\t\r\n"
    assert one(spark, raw, text.escape) == "&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt;\t\r\n"
    assert one(spark, raw, text.partial_escape) == "&lt;a &amp; 'b' \"c\"&gt;\t\r\n"
    assert one(spark, raw, text.minimal_escape) == "&lt;a &amp; 'b' \"c\">\t\r\n"
    assert one(spark, raw, lambda c: text.list_escape(c, "minimal")) == "&lt;a&#32;&amp;&#32;'b'&#32;\"c\">&#9;&#13;&#10;"


def test_line_ends_and_spaces(spark):
    assert one(spark, "a\r\nb\rc\r\u0085d\u0085e f", text.eol_xml11) == "a\nb\nc\nd\ne\nf"
    assert one(spark, "a\r\nb\r\u0085", text.eol_xml10) == "a\nb\n\u0085"
    assert one(spark, "\xa0 a\t\r\n", text.trim_xml) == "\xa0 a"
    assert one(spark, " \t", text.is_blank) is True


def test_cdata(spark):
    assert one(spark, "a]]>b]]>", text.cdata) == "<![CDATA[a]]]]><![CDATA[>b]]]]><![CDATA[>]]>"
    assert one(spark, "a]]>b", text.cdata_parts) == ["a]]", ">b"]


@pytest.mark.parametrize(("name", "ok"), [("a", True), ("a:b-1.x", True), ("1a", False), ("", False), ("a b", False), ("é·", True), ("-a", False), ("\U00010000", True)])
def test_names(spark, name, ok):
    assert one(spark, name, text.is_xml_name) is ok


@pytest.mark.parametrize(("name", "pre", "local"), [("a", None, "a"), ("p:a", "p", "a"), (":a", "", "a"), ("p:a:b", "p", "a:b"), ("p:", "p", "")])
def test_qnames(spark, name, pre, local):
    assert one(spark, name, text.prefix) == pre
    assert one(spark, name, text.local_name) == local


@pytest.mark.parametrize(
    ("raw", "charset", "plain"),
    [
        (b"\xef\xbb\xbf<a/>", "UTF-8", "<a/>"),
        ("<?xml version='1.0'?>é".encode("utf-16-be"), "UTF-16BE", "<?xml version='1.0'?>é"),
        (b"\xff\xfe" + "<é/>".encode("utf-16-le"), "UTF-16LE", "<é/>"),
        ("<?xml version='1.0' encoding='windows-1251'?>При".encode("cp1251"), "windows-1251", "<?xml version='1.0' encoding='windows-1251'?>При"),
        ("<?xml version='1.0' encoding='koi8-r'?>При".encode("koi8-r"), "KOI8-R", "<?xml version='1.0' encoding='koi8-r'?>При"),
        ("é".encode(), "UTF-8", "é"),
        (b"", "UTF-8", ""),
    ],
)
def test_encodings(spark, raw, charset, plain):
    assert one(spark, bytearray(raw), encoding.effective_charset, "binary") == charset
    assert one(spark, bytearray(raw), encoding.decode_document, "binary") == plain


def test_explicit_encoding(spark):
    assert one(spark, bytearray("é".encode("cp1252")), lambda c: encoding.decode_document(c, "latin1"), "binary") == "é"


def test_charsets_without_the_setting(spark):
    """Java's charsets are open to documents in a session that keeps Spark's own default."""
    raw = "<?xml version='1.0' encoding='x-sjis'?>あ".encode("cp932")
    spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    try:
        assert one(spark, bytearray(raw), encoding.decode_document, "binary").endswith("?>あ")
        with pytest.raises(Exception, match="MALFORMED"):
            one(spark, bytearray(b"\x81"), lambda c: encoding.decode_document(c, "x-sjis"), "binary")
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=40))
def test_escape_round_trip(spark, raw):
    raw = raw.encode("utf-8", "ignore").decode()
    r = spark.createDataFrame([(raw,)], "c string").select(text.unescape(text.escape(F.col("c"))).alias("a"), text.unescape(text.list_escape(F.col("c"))).alias("b")).first()
    assert (r.a, r.b) == (raw, raw)


def test_labels_are_charsets(spark):
    """Every label's charset is one that Java has, and decodes ASCII."""
    known = sorted(set(encoding.labels().values()))
    bits = {c: "a".encode("utf-16-be" if c == "UTF-16BE" else "utf-16-le" if c == "UTF-16LE" else "ascii") for c in known}
    rows = spark.createDataFrame([(c, bytearray(b)) for c, b in bits.items()], "label string, b binary")
    got = rows.select(F.call_function("decode", "b", F.col("label")).alias("t")).collect()
    assert [r.t for r in got] == ["a"] * len(known)
    assert len(encoding.labels()) > 150


@pytest.mark.parametrize(("label", "charset"), [("Latin1", "windows-1252"), (" iso_8859-1:1987 ", "windows-1252"), ("l5", "windows-1254"), ("csISOLatin2", "ISO-8859-2"), ("x-sjis", "windows-31j"), ("cp1251", "windows-1251"), ("UTF8", "UTF-8"), ("unicode", "UTF-16LE"), ("koi", "KOI8-R"), ("asmo-708", "ISO-8859-6"), ("big5", "Big5-HKSCS"), ("gb_2312-80", "GBK"), ("ibm850", "ibm850")])
def test_labels(spark, label, charset):
    assert one(spark, label, encoding.charset_of) == charset


@pytest.mark.parametrize(
    ("value", "kind", "shown"),
    [(1.0, "double", "1"), (-0.5, "double", "-0.5"), (1e20, "double", "1" + "0" * 20), (1.5e-7, "double", "0.00000015"), (-123456789.25, "double", "-123456789.25"), (1e7, "double", "10000000"), (1.25e10, "float", "12500000000"), (float("nan"), "double", "NaN"), (float("-inf"), "double", "-inf"), (0.0, "double", "0"), (7, "bigint", "7"), (None, "double", None)],
)
def test_written_numbers(spark, value, kind, shown):
    assert one(spark, value, lambda c: text.write_number(c, T.StructType.fromDDL(f"v {kind}")["v"].dataType), kind) == shown


@pytest.mark.parametrize(
    ("raw", "kind", "value"),
    [("1.5", "double", 1.5), ("1.5d", "double", None), ("1f", "float", None), ("+2", "int", 2), ("2.0", "int", None), (".5", "double", 0.5), ("5.", "double", 5.0), ("1e3", "double", 1000.0), ("Inf", "double", float("inf")), ("-infinity", "double", float("-inf")), ("0x1", "int", None), ("", "int", None), ("128", "tinyint", None), ("1e1", "decimal(5,1)", 10), ("--1", "int", None)],
)
def test_read_numbers(spark, raw, kind, value):
    got = one(spark, raw, lambda c: text.read_number(c, T.StructType.fromDDL(f"v {kind}")["v"].dataType))
    assert got == value if got is None or value is None else float(got) == value
