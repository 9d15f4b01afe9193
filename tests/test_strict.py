"""The exact reader: events, errors and byte positions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from xylem.operators.strict import read_attributes, read_document
from xylem.options import ReaderOptions

ALL = ReaderOptions().enable_all_checks(True)


def shape(xml, options=ReaderOptions()):
    return [(e.kind, e.content) if e.kind != "Error" else (e.error_code, e.error_pos) for e in read_document(xml, options)]


@pytest.mark.parametrize(
    ("xml", "expected"),
    [
        ("<q>5 &lt; 7 &amp;&amp; 7&gt;5</q>", [("Start", "q"), ("Text", "5 "), ("GeneralRef", "lt"), ("Text", " 7 "), ("GeneralRef", "amp"), ("GeneralRef", "amp"), ("Text", " 7"), ("GeneralRef", "gt"), ("Text", "5"), ("End", "q")]),
        ("rock&roll", [("Text", "rock"), ("UnclosedReference", 4)]),
        ("&&;&#;&#xZ;", [("UnclosedReference", 0), ("GeneralRef", ""), ("GeneralRef", "#"), ("GeneralRef", "#xZ")]),
        ("ab</cd>", [("Text", "ab"), ("UnmatchedEndTag", 2)]),
        ("<one></two><three/>", [("Start", "one"), ("MismatchedEndTag", 5), ("Empty", "three")]),
        ("<!---->", [("Comment", "")]),
        ("<!DOCTYPE>", [("MissingDoctypeName", 9)]),
        ("<!DOCTYPE \t\r\nx>", [("DocType", "x")]),
        ("<!doctype html>", [("DocType", "html")]),
        (".<!DOCTYPE root [<!-- ", [("Text", "."), ("UnclosedDoctype", 1)]),
        ("<!DOCTYPE r [<!ENTITY g '>'><!-- ' ] --><?p '> ?><!ELEMENT e ANY>]>", [("DocType", "r [<!ENTITY g '>'><!-- ' ] --><?p '> ?><!ELEMENT e ANY>]")]),
        ("<!-->", [("UnclosedComment", 0)]),
        ("<!--->", [("UnclosedComment", 0)]),
        (".<!->", [("Text", "."), ("UnclosedComment", 1)]),
        (".<![x]]>", [("Text", "."), ("UnclosedCData", 1)]),
        (".<!Dx>", [("Text", "."), ("UnclosedDoctype", 1)]),
        (".<?", [("Text", "."), ("UnclosedPI", 1)]),
        (".<?>", [("Text", "."), ("UnclosedPI", 1)]),
        (".<?xml ", [("Text", "."), ("UnclosedXmlDecl", 1)]),
        ("<??>", [("PI", "")]),
        ("<?xml?><?xmlx a?>", [("Decl", "xml"), ("PI", "xmlx a")]),
        (".<", [("Text", "."), ("UnclosedTag", 1)]),
        (".<tag a='", [("Text", "."), ("UnclosedSingleQuotedAttributeValue", 1)]),
        ('.<tag a="', [("Text", "."), ("UnclosedDoubleQuotedAttributeValue", 1)]),
        ("<></>", [("Start", ""), ("End", "")]),
        ('<a></a attr=">" >', [("Start", "a"), ("MismatchedEndTag", 3)]),
        ("<a b='>'/>", [("Empty", "a b='>'")]),
        ("<a/ >", [("Start", "a/ ")]),
        ("<![CDATA[a]]b]]>", [("CData", "a]]b")]),
        ("\ufeff<a>", [("Start", "a")]),
        ("\ufeff<a>&x</a>", [("Start", "a"), ("UnclosedReference", 3), ("End", "a")]),
        ("", []),
    ],
)
def test_events(xml, expected):
    assert shape(xml) == expected


def test_error_places_are_bytes():
    assert shape("<é>ü</b>")[-1] == ("MismatchedEndTag", 6)


@pytest.mark.parametrize(("xml", "pos"), [("<!----->", 4), ("<!-- --->", 5), ("<!-- -- -->", 5)])
def test_hyphens(xml, pos):
    assert shape(xml, ALL) == [("DoubleHyphenInComment", pos)]
    assert shape(xml)[0][0] == "Comment"


def test_dangling():
    assert shape("salt & pepper&quot;s &&lt;&", ReaderOptions(allow_dangling_amp=True)) == [("Text", "salt "), ("Text", "& pepper"), ("GeneralRef", "quot"), ("Text", "s "), ("Text", "&"), ("GeneralRef", "lt"), ("Text", "&")]


def test_options():
    assert shape("</a>", ReaderOptions(allow_unmatched_ends=True)) == [("End", "a")]
    assert shape("<a></b>", ReaderOptions(check_end_names=False))[1] == ("End", "b")
    assert shape("<a></a >", ReaderOptions(trim_markup_names_in_closing_tags=False))[1] == ("MismatchedEndTag", 3)
    assert shape("<a/>", ReaderOptions(expand_empty_elements=True)) == [("Start", "a"), ("End", "a")]
    assert shape(" <a> x </a> ", ReaderOptions().trim_text(True)) == [("Start", "a"), ("Text", "x"), ("End", "a")]
    # only the end trimmed: a blank text before markup becomes an empty one
    assert shape(" <a>", ReaderOptions(trim_text_end=True)) == [("Text", ""), ("Start", "a")]


def attrs(tag, start=3, **kw):
    return [(a.key, a.value, a.quote) if a.error is None else (a.error, a.error_pos, a.error_pos2) for a in read_attributes(tag, start, **kw)]


@pytest.mark.parametrize(
    ("tag", "xml", "html"),
    [
        ('img hidden  alt="a cat"', [("ExpectedEq", 12, None), ("alt", "a cat", "double")], [("hidden", "", "none"), ("alt", "a cat", "double")]),
        ("img alt =  ", [("ExpectedValue", 11, None)], [("ExpectedValue", 11, None)]),
        ("img w = 10 h='5'", [("UnquotedValue", 8, None), ("h", "5", "single")], [("w", "10", "unquoted"), ("h", "5", "single")]),
        ("img w = '10 ", [("ExpectedQuote", 12, None)], [("ExpectedQuote", 12, None)]),
        ("img w='1' h=\"2\" w = '3' d='4'", [("w", "1", "single"), ("h", "2", "double"), ("Duplicated", 16, 4), ("d", "4", "single")], [("w", "1", "single"), ("h", "2", "double"), ("Duplicated", 16, 4), ("d", "4", "single")]),
        ("img", [], []),
    ],
)
def test_attributes(tag, xml, html):
    assert attrs(tag) == xml
    assert attrs(tag, html=True) == html


def test_unchecked_duplicates():
    assert attrs("tag a='1' a='2'", checks=False) == [("a", "1", "single"), ("a", "2", "single")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/ab=\"'&;!-[]?é \n", max_size=30))
def test_nothing_is_lost(xml):
    ev = read_document(xml, ReaderOptions(expand_empty_elements=False))
    assert "".join(e.raw for e in ev) == xml
