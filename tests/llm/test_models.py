"""Exact search, classifiers, WARC derivatives and the pipeline."""

import base64
import gzip
import hashlib
import math
import os
import random
import time
import uuid
import zlib
from fractions import Fraction
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pytest

from xylem.llm import quality, toxicity, warc
from xylem.llm.kdtree import Tree, exact_topk, search
from xylem.llm.labelled import training_sample


def whole(x):
    """floor(64 x) of the double, exactly."""
    return math.floor(Fraction(64) * Fraction(x))


def brute(rows, queries, k):
    out = []
    good = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, x in good:
        if queries(q):
            scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in good if i != q and len(v) == len(x))
            out += [(q, r + 1, i, max(-(2**63 - 1), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [16, 1000])
def test_topk(spark, shard):
    rng = random.Random(1)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)]) for i in range(120)]
    rows += [(200, [0.1, None, 0.2]), (201, None), (202, [float("nan")] * 3), (203, [float("inf")] * 3), (204, rows[4][1]), (205, rows[4][1]), (220, [0.5, 0.5]), (221, [0.1, 0.1]), (240, []), (241, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk(df, df.filter("vec_id % 20 = 0"), k=7, shard=shard, block=4).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % 20 == 0, 7)
    assert exact_topk(df.filter("vec_id < 0"), df.filter("vec_id < 0")).count() == 0


@pytest.mark.parametrize("shard", [2, 1000])
def test_topk_of_repeated_ids(spark, shard):
    """Each row of a query id is a query; candidates of an id count once for each row."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.25, 0.5]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk(df, df.filter("vec_id % 20 = 0"), k=2, shard=shard, block=1).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i == 0, 2)
    assert [tuple(r) for r in exact_topk(df.limit(1), df.limit(1)).collect()] == []


@pytest.mark.parametrize("top", [30.0, 1e6, 1e9, 1e18, 1e300])
def test_topk_of_large_components(spark, top):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-top, top) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk(df, df.filter("vec_id % 20 = 0"), k=40, shard=1000).collect()
    want = brute(rows, lambda i: i % 20 == 0, 40)
    assert sorted(r.score for r in got) == sorted(w[3] for w in want)
    if top < 1e9:
        assert sorted(tuple(r) for r in got) == want


def test_tree_keeps_all_ties():
    ids, v = np.arange(400), np.tile([[1, 2], [2, 1]], (200, 1))
    row, name, score = search(Tree(ids, v, leaf=8), np.array([0]), np.array([[1, 1]]), 5, np.array([-(2**62)]))
    assert sorted(name.tolist()) == [1, 2, 3, 4, 5]
    assert set(score.tolist()) == {3}


def labelled(spark, n, bad, good):
    rng = random.Random(2)
    words = [a + b for a in "bcdfg" for b in "aeiou"]
    docs, labels = [], []
    for i in range(n):
        y = rng.random() < 0.3
        s = [" ".join(rng.choices(words, k=6)) for _ in range(5)]
        if y:
            s[2] += f" {rng.choice(bad)}"
        else:
            s[1] += f" {rng.choice(good)}"
        docs.append((i, ". ".join(s)))
        labels.append((i, int(y)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int"), dict(labels)


def test_toxicity(spark):
    docs, labels, y = labelled(spark, 800, ["nasty", "foul"], ["nice"])
    w, b = toxicity.fit_toxicity(docs, labels, "y")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "..."), (-4, "Be nice. You NASTY thing! Bye")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.union(extra), w, b).collect()}
    held = [i for i in y if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == bool(y[i]) for i in held) >= 0.97 * len(held)
    assert [got[i].score for i in (-1, -2, -3)] == [0, 0, 0]
    (hit,) = got[-4].offending
    assert "Be nice. You NASTY thing! Bye"[hit.start : hit.end] == "You NASTY thing"


def test_quality(spark):
    docs, labels, y = labelled(spark, 500, ["good"], ["BAD!!! BAD!!!"])
    table, bias = quality.fit_quality(docs, labels, "y")
    got = {r.doc_id: r.score for r in quality.score_quality(docs.union(spark.createDataFrame([(-1, None)], "doc_id long, text string")), table, bias).collect()}
    held = [i for i in y if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y[i]) for i in held) >= 0.95 * len(held)
    assert 0 <= got[-1] <= 1


def test_sample_is_bounded_and_spares_the_held_out(spark):
    docs, labels, _ = labelled(spark, 300, ["x"], ["z"])
    marked = docs.selectExpr("doc_id", "cast(doc_id as string) as text")
    texts, y, weight = training_sample(marked, labels, "y", 20)
    assert y.count(0) == y.count(1) == 20
    assert not any(zlib.crc32(t.encode()) % 5 == 0 for t in texts)
    assert sum(weight) == pytest.approx(40)
    assert training_sample(marked, labels.filter("doc_id < 0"), "y", 5) == ([], [], [])
    # an id on many rows counts once, the bytes are bounded, and the order of rows is nothing to it
    many = marked.union(marked.selectExpr("doc_id", "concat(text, 'x') as text")).repartition(3)
    assert training_sample(many, labels, "y", 20) == (texts, y, weight)
    few = training_sample(marked, labels, "y", 20, class_bytes=12)
    assert 0 < len(few[0]) < 20 and set(few[0]) <= set(texts)


def test_scores_of_nothing(spark):
    docs, labels, _ = labelled(spark, 60, ["nasty"], ["nice"])
    w, b = toxicity.fit_toxicity(docs, labels.limit(0), "y")
    clash = docs.selectExpr("doc_id", "text", "'x' as score", "1 as offending")
    assert all(0 <= r.score <= 1 and r.offending == [] for r in toxicity.score_toxicity(clash, w, b).collect())
    assert toxicity.score_toxicity(docs.limit(0), w, b).count() == 0
    table, bias = quality.fit_quality(docs.limit(0), labels, "y")
    assert {r.score for r in quality.score_quality(clash, table, bias).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), table, bias).count() == 0


PAGE = "<html><head><title>A &amp; B</title><style>x{}</style><script>var a='</p>';</script></head><body><!-- no --><p>One<br>two</p><div>three &nbsp; four <a href='/x?a=1&amp;b=2'>link</a></div></body></html>"


def test_text():
    assert warc.plain_text(PAGE) == "A & B\nOne\ntwo\nthree four link"
    assert warc.plain_text("") == warc.plain_text("<p></p>") == ""


def test_records():
    a, b = warc.response_record("1", "http://h/p", PAGE), warc.response_record("2", None, None)
    assert [dict(h)["WARC-Type"] for h, _ in warc.read_records(a + b)] == ["response"] * 2
    assert list(warc.read_records(gzip.compress(a) + gzip.compress(b))) == list(warc.read_records(a + b))
    for broken in (a[:-30], b"WARC/1.1\r\n", b"junk"):
        with pytest.raises(ValueError):
            list(warc.read_records(broken))
    (headers, block) = next(warc.read_records(a))
    h = dict(headers)
    assert h["WARC-Block-Digest"] == warc.digest(block)
    meta, conv = warc.derive(headers, block)
    for mine, body in (meta, conv):
        m = dict(mine)
        assert (m["WARC-Refers-To"], m["WARC-Refers-To-Target-URI"], m["WARC-Block-Digest"]) == (h["WARC-Record-ID"], "http://h/p", warc.digest(body))
    fields = meta[1].decode().split("\r\n")
    assert "outlink: http://h/x?a=1&b=2 a/@href" in fields
    assert "title: A & B" in fields
    assert f"source-payload-digest: {h['WARC-Payload-Digest']}" in fields
    assert all(f"source-header: {k}: {v}" in fields for k, v in headers)
    assert warc.derive([("WARC-Type", "request"), ("WARC-Record-ID", "x")], b"") == []


@pytest.mark.parametrize("bit", ["<script>", "<title>", "<a ", "<a href='", '<a href="x>', "<!--", "<!-- -->", "</script   ", "<p", "<title>x</title>", "<", "<script></script >", "href = ", "&"])
@pytest.mark.parametrize("tail", ["", ">"])
def test_hostile_pages_take_linear_time(bit, tail):
    def seconds(n):
        page = bit * n + tail
        began = time.perf_counter()
        warc.plain_text(page), warc.title_of(page), list(warc.links_of(page))
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(60_000) < 2.0


def test_pages_that_do_not_close():
    assert warc.plain_text("a<script>b <script>c</script>d") == "a d"
    assert warc.plain_text("a<style>b <!-- c") == "ab"
    assert warc.plain_text("a < b <i") == "a < b <i"
    assert warc.title_of("<title>a <title>b</title>c") == "a <title>b"
    assert warc.title_of("<title>a") is None
    assert list(warc.links_of("<a href=x><a href='y z'><a name=q><a href=\"b>c\"><A HREF = 'd><a href=e>")) == ["x", "y z", "b>c", "d", "e"]


def test_archives_are_read_piece_by_piece(monkeypatch):
    made = [warc.response_record(str(i), "http://h/", "x" * (i * 37 % 301)) for i in range(40)]
    want = [r for m in made for r in warc.read_records(m)]
    assert len(want) == 40
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(warc, "_PIECE", piece)
        assert list(warc.read_records(b"".join(made))) == want
        assert list(warc.read_records(b"".join(gzip.compress(m) for m in made) + b"\0\0")) == want
        for broken in (b"".join(made)[:-30], gzip.compress(made[0])[:-12], made[0] + b" junk", made[0] + gzip.compress(made[1])):
            with pytest.raises((ValueError, zlib.error)):
                list(warc.read_records(broken))


class Twin(HTMLParser):
    """The text of well-formed pages by the standard library's parser."""

    blocks = warc._BLOCKS
    opaque = {"script", "style", "template", "noscript"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.depth, self.links, self.title, self.inside = [""], 0, [], None, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.opaque
        if tag in self.opaque:
            self.lines[-1] += " "
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"].strip())
        self.inside |= tag == "title"
        if tag in self.blocks:
            self.lines.append("")

    def handle_endtag(self, tag):
        self.depth -= tag in self.opaque
        self.inside &= tag != "title"
        if tag in self.blocks:
            self.lines.append("")

    def handle_comment(self, data):
        self.lines[-1] += " "

    def handle_data(self, data):
        if self.inside:
            self.title = " ".join(((self.title or "") + data).split())
        if not self.depth:
            self.lines[-1] += data


def test_derivatives_of_the_pages_have_a_twin(spark):
    sf = os.environ.get("XYLEM_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    from xylem.llm.queries import op5_warc

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = {(r.page_id, r.warc_type): r for r in op5_warc(spark, sf).collect()}
    assert set(rows) == {(i, t) for i in pages for t in ("metadata", "conversion")}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for i, p in pages.items():
        twin, payload = Twin(p.html), p.html.encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        source = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response|{i}|{p.url}')}>"
        conv, meta = rows[i, "conversion"], rows[i, "metadata"]
        assert conv.body == "\n".join(s for line in twin.lines if (s := " ".join(line.split())))
        fields = meta.body.split("\r\n")
        assert f"title: {twin.title}" in fields
        assert [f.split(" ")[1] for f in fields if f.startswith("outlink: ")] == [urljoin(p.url, x) for x in twin.links]
        for r in (conv, meta):
            assert (r.refers_to, r.target_uri, r.content_length) == (source, p.url, len(r.body.encode()))
            assert (r.block_digest, r.source_block_digest, r.source_payload_digest) == (sha(r.body.encode()), sha(block), sha(payload))
            assert r.record_id == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{r.warc_type}|{source}')}>"


def test_derivatives_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    out = warc.derivatives(warc.pages_to_responses(none))
    assert out.count() == 0 and warc.record_bytes(out).count() == 0


def test_derivatives(spark):
    df = spark.createDataFrame([(1, "http://h/", PAGE), (2, None, None), (3, "http://h/é", "")], "page_id long, url string, html string")
    out = warc.derivatives(warc.pages_to_responses(df))
    rows = out.collect()
    assert sorted((r.key, r.warc_type) for r in rows) == [(k, t) for k in (1, 2, 3) for t in ("conversion", "metadata")]
    assert len({r.record_id for r in rows}) == 6
    written = {(r.key, r.warc_type): next(warc.read_records(bytes(r.warc))) for r in warc.record_bytes(out).collect()}
    for r in rows:
        headers, block = written[r.key, r.warc_type]
        assert (dict(headers)["WARC-Record-ID"], block.decode()) == (r.record_id, r.body)
    broken = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "key long, warc binary")
    assert [(r.key, r.error is not None) for r in warc.derivatives(broken).collect()] == [(1, True)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    vocab = [a + b + c for a in "bcdfghk" for b in "aeiou" for c in "lmnrst"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, leak = text(60), text(30)
    docs = [(i, text(120)) for i in range(40)]
    docs += [(50, docs[3][1]), (51, docs[4][1].replace(docs[4][1].split()[60], "zzz", 1))]
    docs += [(60, f"{text(50)} {passage} {text(50)}"), (61, f"{text(50)} {passage} {text(50)}")]
    docs += [(70, f"{text(40)} {leak.upper()} {text(40)}"), (80, f"{text(30)}. You nasty foul thing. {text(30)}"), (90, None), (91, ""), (None, text(20))]
    lab = [(200 + i, f"{text(20)}. {'nasty foul ' if i % 2 else 'kind '}{text(5)}. {text(20)}", i % 2) for i in range(300)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs] + [(i, t, "en", "s", len(t)) for i, t, _ in lab]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in lab], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, frame = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / f"s{n}"))
        frame = spark.read.parquet(str(tmp_path / f"s{n}"))
        if n < 4:
            assert frame.columns == before.columns
            seen[n] = {r.doc_id: r.text for r in frame.collect()}
    clean = {*range(40), 60, 61, 90, None}
    assert clean <= set(seen[0]) and 80 not in seen[0]
    assert clean <= set(seen[1]) and not {50, 51} & set(seen[1])
    assert passage in seen[2][60] and passage not in seen[2][61]
    assert seen[2][5] == seen[1][5]
    assert clean <= set(seen[3]) and 70 not in seen[3]
    last = {r.doc_id: r.n_tokens for r in frame.collect()}
    assert set(last) == set(seen[3]) and last[90] == 0


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kind in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_columns_and_rows(spark, tmp_path):
    """Further columns, named like results, and rows with nulls everywhere."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string"
    rows = [(1, "one two three four five six", "en", None, None, "s", "i"), (None, None, None, None, None, None, None), (2, None, None, None, None, None, None), (1, "another text on the same id", None, "x", 7, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / f"s{n}"))
        frame = spark.read.parquet(str(tmp_path / f"s{n}"))
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(rows, key=repr)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4
