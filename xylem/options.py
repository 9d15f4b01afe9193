"""Options of readers and writers; each changes the plan that is built."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ReaderOptions:
    """How documents are read.

    - ``allow_dangling_amp``: a lone ``&`` is text instead of an error.
    - ``allow_unmatched_ends``: an end tag without a start is an event, not an error.
    - ``check_comments``: ``--`` inside a comment is an error.
    - ``check_end_names``: an end tag must name the last open start tag.
    - ``expand_empty_elements``: ``<a/>`` gives a start and an end.
    - ``trim_markup_names_in_closing_tags``: ``</a >`` names ``a``.
    - ``trim_text_start``, ``trim_text_end``: white space around texts is cut; a text
      that is all white space is then left out (``trim_text_start``).
    - ``loose``: a scan by pattern, as SQL does it: nothing is an error; a ``<`` or ``&``
      that opens no markup is passed over, and counts in no offset.
    """

    allow_dangling_amp: bool = False
    allow_unmatched_ends: bool = False
    check_comments: bool = False
    check_end_names: bool = True
    expand_empty_elements: bool = False
    trim_markup_names_in_closing_tags: bool = True
    trim_text_start: bool = False
    trim_text_end: bool = False
    loose: bool = False

    def trim_text(self, on: bool) -> ReaderOptions:
        return replace(self, trim_text_start=on, trim_text_end=on)

    def enable_all_checks(self, on: bool) -> ReaderOptions:
        return replace(self, check_comments=on, check_end_names=on)


@dataclass(frozen=True)
class WriterOptions:
    """How events are written: indentation (``indent_size`` of ``indent_char``), ``<a />``, BOM."""

    indent_char: str = " "
    indent_size: int = 0
    add_space_before_slash_in_empty_elements: bool = False
    write_bom: bool = False


@dataclass(frozen=True)
class TypedOptions:
    """How rows are written as elements.

    ``quote``: ``full``, ``partial`` or ``minimal`` escaping; ``text``: ``text`` or
    ``cdata``; ``empty``: ``self_closed``, ``self_closed_space`` or ``expanded``;
    ``indent``: blanks of one level, zero for none.
    """

    quote: str = "partial"
    text: str = "text"
    empty: str = "self_closed"
    indent: int = 0
    indent_char: str = " "
