"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response record gives two records.  Both point back at it by ``WARC-Refers-To``,
its target and its date; the metadata record keeps the response's own headers and
digests; all records carry block digests, responses payload digests too.  Record ids
follow from the source's, so a task that is run again makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, trim, whole_number

DATE = "1970-01-01T00:00:00Z"
_CRLF = b"\r\n"
_OPAQUE = re.compile(r"<!--|<(script|style|template|noscript)\b", re.I)
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "template", "noscript", "title")}
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*+)[^>]*+>|<[!?/][^>]*+>")
_TITLE = re.compile(r"<title\b[^>]*+>", re.I)
_ANCHOR = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"\bhref\s*+=\s*+", re.I)
_BARE = re.compile(r"[^\s>]+")
#: Elements that begin a new line of text.
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th title tr ul body head html".split())


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One uncompressed WARC/1.1 record; ``Content-Length`` and the block digest are added."""
    named = {k.lower() for k, _ in headers}
    rows = [*headers]
    if "warc-block-digest" not in named:
        rows.append(("WARC-Block-Digest", digest(block)))
    rows.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in rows)
    return b"WARC/1.1\r\n" + head.encode() + _CRLF + block + _CRLF + _CRLF


#: Inflated bytes asked for at a time.
_PIECE = 1 << 20


def inflate(data: bytes) -> Iterator[bytes]:
    """All members of a gzip stream, or the data itself, piece by piece."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        while at < len(data):
            yield bytes(view[at : at + _PIECE])
            at += _PIECE
        return
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        while not d.eof:
            part = d.unconsumed_tail
            if not part:
                part = view[at : at + _PIECE]
                at += len(part)
                if not len(part):
                    raise ValueError("a gzip member is cut off")
            yield d.decompress(part, _PIECE)
        at -= len(d.unused_data)


class _Feed:
    """A byte stream of which no more than the record at hand is held."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at, self.gone = pieces, bytearray(), 0, 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at > _PIECE:
            self.gone += self.at
            del self.held[: self.at]
            self.at = 0
        self.held += piece
        return True

    def want(self, n: int) -> bool:
        """True if ``n`` bytes are there."""
        while len(self.held) - self.at < n:
            if not self.more():
                return False
        return True

    def find(self, what: bytes) -> int:
        """Bytes before ``what``; -1 if it does not come."""
        seen = 0
        while (hit := self.held.find(what, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(what) + 1)
            if not self.more():
                return -1
        return hit - self.at

    def take(self, n: int) -> bytes:
        out = bytes(memoryview(self.held)[self.at : self.at + n])
        self.at += n
        return out


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record; a truncated or foreign rest raises ValueError.

    Archives are inflated as they are read: a record at a time is in memory.
    """
    feed = _Feed(inflate(data))
    while feed.want(1):
        here = feed.gone + feed.at
        if not feed.want(5) or feed.held[feed.at : feed.at + 5] != b"WARC/":
            while not feed.take(len(feed.held) - feed.at).strip():
                if not feed.more():
                    return
            raise ValueError(f"no record at byte {here}")
        size = feed.find(b"\r\n\r\n")
        if size < 0:
            raise ValueError(f"headers at byte {here} have no end")
        headers: list[tuple[str, str]] = []
        for line in feed.take(size).split(_CRLF)[1:]:
            text = line.decode("utf-8", "replace")
            if text[:1] in (" ", "\t") and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {text.strip()}")
            else:
                k, _, v = text.partition(":")
                headers.append((k.strip(), v.strip()))
        feed.take(4)
        here += size + 4
        length = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not length.isdecimal() or not feed.want(int(length)):
            raise ValueError(f"block at byte {here} is cut off")
        yield headers, feed.take(int(length))
        while feed.want(2) and feed.held[feed.at : feed.at + 2] == _CRLF:
            feed.take(2)


def response_record(key: str, url: str | None, body: str | None, date: str = DATE) -> bytes:
    """A response record with a minimal HTTP message around ``body`` (null: empty)."""
    payload = (body or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url or "")), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    return write_record([*headers, ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")], block)


def visible(page: str) -> str:
    """The page without comments and the content of scripts and the like: a blank for each.

    A comment that does not end takes the rest; an opaque element that does not is a tag.
    One look ahead for each kind that never closes, so the time is linear.
    """
    out, at, look = [], 0, 0
    endless: set[str] = set()
    while (m := _OPAQUE.search(page, look)) is not None:
        name = (m[1] or "").lower()
        if not name:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        else:
            close = None if name in endless else _CLOSE[name].search(page, m.end())
            if close is None:
                endless.add(name)
                look = m.end()
                continue
            end = close.end()
        out += [page[at : m.start()], " "]
        at = look = end
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """Text of a page: no markup, scripts or comments; one line a block, blanks collapsed."""
    bits, at = [], 0
    page = visible(page)
    # behind the last > no tag ends: nothing is looked for there
    for m in _TAG.finditer(page, 0, page.rfind(">") + 1):
        bits.append(page[at : m.start()])
        at = m.end()
        name = m[1]
        if name is not None and name.lower() in _BLOCKS:
            bits.append("\x00")
    bits.append(page[at:])
    text = "".join(bits)
    if "&" in text:
        text = html.unescape(text)
    return "\n".join([s for line in text.split("\x00") if (s := " ".join(line.split()))])


def title_of(page: str) -> str | None:
    """Content of the first title element, blanks collapsed."""
    m = _TITLE.search(page, 0, page.rfind(">") + 1)
    close = _CLOSE["title"].search(page, m.end()) if m else None
    return " ".join(html.unescape(page[m.end() : close.start()]).split()) if close else None


def links_of(page: str) -> Iterator[str]:
    """Targets of the page's ``a`` elements, in order."""
    at, last = 0, page.rfind(">") + 1
    unpaired: set[str] = set()  # quotes that do not come again
    while (m := _ANCHOR.search(page, at, last)) is not None:
        stop = page.find(">", m.end())
        href = _HREF.search(page, m.end(), stop)
        if href is None:
            at = stop + 1
            continue
        quote, begin = page[href.end() : href.end() + 1], href.end() + 1
        close = page.find(quote, begin) if quote in ("'", '"') and quote not in unpaired else -1
        if close >= 0:
            yield html.unescape(page[begin:close]).strip()
            at = close + 1
            continue
        if quote in ("'", '"'):
            unpaired.add(quote)
        bare = _BARE.match(page, href.end())
        if bare is not None:
            yield html.unescape(bare[0].strip("\"'")).strip()
        at = max(stop, bare.end() if bare else 0)


def _message(block: bytes, kind: str) -> tuple[str, list[str], bytes]:
    """(status line, header lines, payload) of an HTTP message, or of a bare payload."""
    if "application/http" not in kind:
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], lines[1:], payload


def derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and conversion records of a response; none for other records."""
    h = {k.lower(): v for k, v in reversed(headers)}
    if h.get("warc-type") != "response" or "warc-record-id" not in h:
        return []
    status, lines, payload = _message(block, h.get("content-type", ""))
    charset = next((m[1] for x in lines if (m := re.match(r"content-type:.*charset=([\w-]+)", x, re.I))), "utf-8")
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source, date, target = h["warc-record-id"], h.get("warc-date", DATE), h.get("warc-target-uri")
    linked = [("WARC-Refers-To", source), ("WARC-Refers-To-Date", date)]
    if target is not None:
        linked = [("WARC-Target-URI", target), *linked, ("WARC-Refers-To-Target-URI", target)]
    title = title_of(page)
    fields = [f"source-header: {k}: {v}" for k, v in headers]
    fields += [f"http-status: {status}"] if status else []
    fields += [f"http-header: {x}" for x in lines]
    fields.append(f"source-block-digest: {h.get('warc-block-digest') or digest(block)}")
    fields.append(f"source-payload-digest: {h.get('warc-payload-digest') or digest(payload)}")
    if title is not None:
        fields.append(f"title: {title}")
    for link in links_of(page):
        try:
            fields.append(f"outlink: {urljoin(target or '', link)} a/@href")
        except ValueError:
            fields.append(f"outlink: {link} a/@href")
    out = []
    for kind, mime, body in (("metadata", "application/warc-fields", ("\r\n".join(" ".join(f.split("\n")) for f in fields) + "\r\n").encode()), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode())):
        out.append(([("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Date", date), *linked, ("WARC-Block-Digest", digest(body)), ("Content-Type", mime)], body))
    return out


def pages_to_responses(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, warc): one response record for each page row.

    Null bodies are empty, null addresses left out; null keys and repeated rows give their
    records too.  An empty table gives an empty one.
    """
    source = ready(df).select(whole_number(df, key).alias("key"), df[url].alias("url"), df[body].alias("body"))

    def run(batches):
        for b in batches:
            made = [response_record(str(k), u, x) for k, u, x in zip(*(b.column(c).to_pylist() for c in ("key", "url", "body")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(made, pa.binary())], names=["key", "warc"])

    return source.mapInArrow(run, "key long, warc binary")


_FIELDS = "key long, record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, body string, error string"


def derivatives(df: DataFrame, key: str = "key", warc: str = "warc", with_body: bool = True) -> DataFrame:
    """Metadata and conversion records of the responses in column ``warc``.

    Each row of ``df`` may hold several records, gzipped or not.  Records that are no
    responses give nothing; a broken file gives the records before the break and one row
    with ``error``; null or empty bytes give nothing.  ``body`` is the record's block.
    One narrow pass.
    """
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    source = ready(df).select(whole_number(df, key).alias("key"), df[warc].alias("warc"))

    def rows(k, data):
        try:
            for headers, block in read_records(data or b""):
                h = {a.lower(): b for a, b in reversed(headers)}
                made = derive(headers, block)
                if not made:
                    continue
                payload = h.get("warc-payload-digest") or digest(_message(block, h.get("content-type", ""))[2])
                for mine, body in made:
                    m = dict(mine)
                    yield k, m["WARC-Record-ID"], m["WARC-Type"], m["WARC-Refers-To"], m.get("WARC-Target-URI"), m["WARC-Date"], m["Content-Type"], len(body), m["WARC-Block-Digest"], h.get("warc-block-digest") or digest(block), payload, body.decode() if with_body else None, None
        except (ValueError, zlib.error) as e:
            yield k, *[None] * 11, str(e)

    kinds = {"key": pa.int64(), "content_length": pa.int64()}

    def batch_of(got: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*got, strict=True), strict=True)], names=names)

    def run(batches):
        for b in batches:
            keys, cells, got, size = b.column("key"), b.column("warc"), [], 0
            for i in range(len(b)):
                # rows are handed on by the megabytes they hold, within an archive too
                for r in rows(keys[i].as_py(), cells[i].as_py()):
                    got.append(r)
                    size += len(r[-2] or "")
                    if size > _PIECE or len(got) >= 400:
                        yield batch_of(got)
                        got, size = [], 0
            if got:
                yield batch_of(got)
        trim()

    return source.mapInArrow(run, _FIELDS)


def record_bytes(df: DataFrame) -> DataFrame:
    """Derivative rows as WARC bytes: (key, warc_type, warc), ready for a file writer.

    Rows with an ``error`` write nothing; a null body is an empty block.
    """
    source = ready(df).filter(F.col("error").isNull())

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                linked = [("WARC-Refers-To", r["refers_to"]), ("WARC-Refers-To-Date", r["warc_date"])]
                if r["target_uri"] is not None:
                    linked = [("WARC-Target-URI", r["target_uri"]), *linked, ("WARC-Refers-To-Target-URI", r["target_uri"])]
                out.append(write_record([("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["warc_date"]), *linked, ("WARC-Block-Digest", r["block_digest"]), ("Content-Type", r["content_type"])], (r["body"] or "").encode()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("warc_type"), pa.array(out, pa.binary())], names=["key", "warc_type", "warc"])

    return source.mapInArrow(run, "key long, warc_type string, warc binary")
