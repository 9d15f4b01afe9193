"""Reading in order: the light array of pieces, and that it is made once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from xylem import queries as q
from xylem.operators import bind, events
from xylem.options import ReaderOptions

SF = os.environ.get("XYLEM_TESTDATA", "/root/testdata/sf0.001")
BITS = ["<a>", "</a>", "<p:b x='1>'/>", "text", " ", "&amp;", "&#x41;", "<!-- c -->", "<![CDATA[<x>]]>", "<?pi a?>", "<?xml version='1.0'?>", "<!DOCTYPE r>", "<!DOCTYPE >", "é", "</b >", "&", "<", "<!x>", "<?>", "<!--", "﻿", "<a b='"]


def test_pieces_are_the_events(spark, docs):
    rng = random.Random(11)
    xml = ["", "﻿<a/>", *["".join(rng.choices(BITS, k=rng.randint(1, 9))) for _ in range(400)]]
    inside = ReaderOptions(check_end_names=False, allow_unmatched_ends=True)
    rows = docs(*xml).select("xml", bind.pieces(F.col("xml")).alias("p"), events.event_array(F.col("xml"), inside).alias("e"), bind.root_count(F.col("xml")).alias("n"), bind.root_count(F.col("xml"), F.col("p")).alias("m")).collect()
    for r in rows:
        # a type without a name is an error among events
        want = [("DocType" if x.e.error and x.e.error.code == "MissingDoctypeName" else x.e.kind, x.e.raw) for x in r.e]
        assert [(p.kind, p.raw) for p in r.p] == want
        depth = n = 0
        stray = False
        for x in (x.e for x in r.e):
            if depth == 0:
                stray |= x.kind in ("CData", "GeneralRef", "Error") or (x.kind == "Text" and x.content.strip(" \t\r\n") != "")
                n += x.kind in ("Start", "Empty")
            depth = depth + 1 if x.kind == "Start" else max(depth - 1, 0) if x.kind == "End" else depth
        assert r.n == r.m == (-1 if stray else n)


def test_items_of_odd_names(docs):
    xml = ["<r><p:a:b>1</p:a:b><x/>t &amp; <![CDATA[u\r\n]]>&no;<p:y k='v'/><a\n>2</a></r>"]
    got = docs(*xml).select(F.explode(bind.read_items(F.col("xml"), {"a": "INT"})).alias("i")).select("i.tag", "i.$text", "i.a").collect()
    assert [tuple(r) for r in got] == [("a:b", None, None), ("x", None, None), ("$text", "t & u\n&no;", None), ("y", None, None), ("a", None, 2)]


@pytest.mark.parametrize(("name", "most"), [("mixed_through_schema", 1), ("several_roots", 2)])
@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_a_document_is_scanned_once(spark, name, most):
    plan = q.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == most
