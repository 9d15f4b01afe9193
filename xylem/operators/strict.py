"""Exact reading of a single document: every event, error and position.

The pull state machine in plain Python: the reader that the token pattern is held
against, and the one that tells attribute errors.  Errors of well-formedness do not end
the document; errors of syntax do.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from ..options import ReaderOptions

_WS = " \t\r\n"
_TEXT = re.compile(r"[^<&]*")
_REF = re.compile(r"&[^;&<]*")
_NAME = re.compile(r"[^ \t\r\n]*")
_QUOTED = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*""")


class Event(NamedTuple):
    kind: str
    raw: str
    content: str
    name: str | None = None
    attrs_raw: str | None = None
    error_class: str | None = None
    error_code: str | None = None
    error_pos: int | None = None
    error_msg: str | None = None


def _doctype_end(s: str, at: int) -> int:
    """Place after the ``>`` of a declaration whose keyword ends at ``at``; -1 if none."""
    n, inside = len(s), False
    while at < n:
        c = s[at]
        if c in "\"'" and not inside:
            at = s.find(c, at + 1)
            if at < 0:
                return -1
        elif not inside and c == "[":
            inside = True
        elif inside and c == "]":
            inside = False
        elif c == ">" and not inside:
            return at + 1
        elif inside and c == "<":
            if s.startswith("<!--", at):
                at = s.find("-->", at + 4)
                step = 2
            elif s.startswith("<?", at):
                at = s.find("?>", at + 2)
                step = 1
            elif s.startswith("<!ELEMENT", at):
                at = s.find(">", at)
                step = 0
            else:
                m = _QUOTED.match(s, at + 1)
                at = m.end() if m and m.end() < n and s[m.end()] == ">" else -1
                step = 0
            if at < 0:
                return -1
            at += step
        at += 1
    return -1


def read_document(text: str, options: ReaderOptions = ReaderOptions()) -> list[Event]:
    """Events of a document in order; positions are bytes of its UTF-8 form.

    A syntax error is the last event.  An unclosed element is no error.
    """
    out: list[Event] = []
    open_names: list[str] = []
    # positions do not count the mark
    text = text.removeprefix("\ufeff")
    at, n = 0, len(text)
    ascii_only = text.isascii()
    mark = [0, 0]  # characters and bytes counted so far

    def place(i: int) -> int:
        if ascii_only:
            return i
        if i < mark[0]:
            return len(text[:i].encode("utf-8", "surrogatepass"))
        mark[1] += len(text[mark[0] : i].encode("utf-8", "surrogatepass"))
        mark[0] = i
        return mark[1]

    def wrong(kind: str, code: str, pos: int, raw: str, msg: str | None = None) -> None:
        out.append(Event("Error", raw, "", error_class=kind, error_code=code, error_pos=pos, error_msg=msg))

    def emit_text(s: str) -> None:
        out.append(Event("Text", s, s.rstrip(_WS) if options.trim_text_end else s))

    while at < n:
        c = text[at]
        if c not in "<&":
            end = _TEXT.match(text, at).end()
            raw = text[at:end]
            body = raw
            if options.trim_text_start:
                body = raw.lstrip(_WS)
            shown = body.rstrip(_WS) if options.trim_text_end else body
            # a text cut away at its start, or empty at the end of the document, is none
            if (body or not options.trim_text_start) and (shown or end < n):
                out.append(Event("Text", raw, shown))
            at = end
            continue
        if c == "&":
            end = _REF.match(text, at).end()
            if end < n and text[end] == ";":
                out.append(Event("GeneralRef", text[at : end + 1], text[at + 1 : end]))
                at = end + 1
                continue
            raw = text[at:end]
            if options.allow_dangling_amp:
                emit_text(raw)
            else:
                wrong("IllFormed", "UnclosedReference", place(at), raw)
            at = end
            continue
        nxt = text[at + 1 : at + 2]
        if nxt == "!":
            third = text[at + 2 : at + 3]
            if third == "-":
                end = text.find("-->", at + 4) + 3 if text.startswith("--", at + 2) else 2
                if end == 2:
                    wrong("Syntax", "UnclosedComment", place(at), text[at:])
                    return out
                body = text[at + 4 : end - 3]
                if options.check_comments:
                    hit = (body + "-").find("--")
                    if hit >= 0:
                        wrong("IllFormed", "DoubleHyphenInComment", place(at + 4 + hit), text[at:end])
                        at = end
                        continue
                out.append(Event("Comment", text[at:end], body))
            elif third == "[":
                end = text.find("]]>", at + 9) + 3 if text.startswith("[CDATA[", at + 2) else 2
                if end == 2:
                    wrong("Syntax", "UnclosedCData", place(at), text[at:])
                    return out
                out.append(Event("CData", text[at:end], text[at + 9 : end - 3]))
            elif third in ("d", "D"):
                end = _doctype_end(text, at + 2)
                if end < 0 or text[at + 2 : at + 9].upper() != "DOCTYPE":
                    wrong("Syntax", "UnclosedDoctype", place(at), text[at:])
                    return out
                body = text[at + 9 : end - 1].lstrip(_WS)
                if body:
                    out.append(Event("DocType", text[at:end], body))
                else:
                    wrong("IllFormed", "MissingDoctypeName", place(end - 1), text[at:end])
            else:
                wrong("Syntax", "InvalidBangMarkup", place(at), text[at:])
                return out
            at = end
            continue
        if nxt == "?":
            end = text.find("?>", at + 1) + 2
            if end == 1 or end - at < 4:
                kind = "UnclosedXmlDecl" if re.match(r"xml(?:[ \t\r\n]|$)", text[at + 2 : at + 6]) else "UnclosedPI"
                wrong("Syntax", kind, place(at), text[at:])
                return out
            body = text[at + 2 : end - 2]
            if body.startswith("xml") and (len(body) == 3 or body[3] in _WS):
                out.append(Event("Decl", text[at:end], body, "xml", body[3:]))
            else:
                target = _NAME.match(body)[0]
                out.append(Event("PI", text[at:end], body, target, body[len(target) :]))
            at = end
            continue
        end = _QUOTED.match(text, at + 1).end()
        if end >= n or text[end] != ">":
            code = "UnclosedTag"
            if end < n:
                code = "UnclosedDoubleQuotedAttributeValue" if text[end] == '"' else "UnclosedSingleQuotedAttributeValue"
            wrong("Syntax", code, place(at), text[at:])
            return out
        raw, inner = text[at : end + 1], text[at + 1 : end]
        if nxt == "/":
            name = inner[1:]
            if options.trim_markup_names_in_closing_tags:
                name = name.rstrip(_WS) or name
            if open_names:
                expected = open_names.pop()
                if options.check_end_names and name != expected:
                    wrong("IllFormed", "MismatchedEndTag", place(at), raw, f"expected `</{expected}>`, but `</{name}>` was found")
                    at = end + 1
                    continue
            elif not options.allow_unmatched_ends:
                wrong("IllFormed", "UnmatchedEndTag", place(at), raw, f"`</{name}>` has no start")
                at = end + 1
                continue
            out.append(Event("End", raw, name, name))
        else:
            empty = inner.endswith("/")
            body = inner[:-1] if empty else inner
            name = _NAME.match(body)[0]
            if empty and not options.expand_empty_elements:
                out.append(Event("Empty", raw, body, name, body[len(name) :]))
            else:
                out.append(Event("Start", raw, body, name, body[len(name) :]))
                if empty:
                    out.append(Event("End", "", name, name))
                else:
                    open_names.append(name)
        at = end + 1
    return out


class Attr(NamedTuple):
    pos: int
    key: str | None
    value: str | None
    quote: str | None
    error: str | None = None
    error_pos: int | None = None
    error_pos2: int | None = None


def read_attributes(tag: str, start: int = 0, html: bool = False, checks: bool = True) -> list[Attr]:
    """Attributes of a tag's content from ``start`` on, errors among them.

    Positions are characters of ``tag``.  After an error reading goes on where a lenient
    reader would: behind a bare key, an unquoted value, or a repeated key's value.
    """
    out: list[Attr] = []
    seen: dict[str, int] = {}
    at, n = start, len(tag)

    def skip(i: int) -> int:
        while i < n and tag[i] in _WS:
            i += 1
        return i

    def word(i: int, stop: str = _WS) -> int:
        while i < n and tag[i] not in stop:
            i += 1
        return i

    while (at := skip(at)) < n:
        begin = at
        end = word(at + 1, _WS + "=")
        key = tag[begin:end]
        eq = skip(end)
        bare = eq >= n or tag[eq] != "="
        if bare and not html:
            out.append(Attr(len(out), key, None, None, "ExpectedEq", min(eq, n)))
            at = eq
            continue
        if checks and key in seen:
            out.append(Attr(len(out), key, None, None, "Duplicated", begin, seen[key]))
            if bare:
                at = eq
                continue
            value = skip(eq + 1)
            if value < n and tag[value] in "\"'":
                close = tag.find(tag[value], value + 1)
                if close < 0:
                    break
                at = close + 1
            else:
                at = word(value)
            continue
        if checks:
            seen[key] = begin
        if bare:
            out.append(Attr(len(out), key, "", "none"))
            at = eq
            continue
        value = skip(eq + 1)
        if value >= n:
            out.append(Attr(len(out), key, None, None, "ExpectedValue", n))
            break
        if tag[value] in "\"'":
            close = tag.find(tag[value], value + 1)
            if close < 0:
                out.append(Attr(len(out), key, None, None, "ExpectedQuote", n))
                break
            out.append(Attr(len(out), key, tag[value + 1 : close], "double" if tag[value] == '"' else "single"))
            at = close + 1
        elif html:
            end = word(value)
            out.append(Attr(len(out), key, tag[value:end], "unquoted"))
            at = end
        else:
            out.append(Attr(len(out), key, None, None, "UnquotedValue", value))
            at = word(value)
    return out
