"""Escaping, references, line ends, trimming, CDATA and names as column expressions."""

from __future__ import annotations

from functools import cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: XML white space: blank, tab, carriage return, line feed.
SPACES = " \t\r\n"
WS = "[ \\t\\r\\n]"

# The five predefined entities.
PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}
_MINIMAL = [("&", "&amp;"), ("<", "&lt;")]
_PARTIAL = [*_MINIMAL, (">", "&gt;")]
_FULL = [*_PARTIAL, ("'", "&apos;"), ('"', "&quot;")]
_LIST = [("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"), (" ", "&#32;")]

# Name characters of XML 1.1.
_NAME_START = ":A-Z_a-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{2FF}\\x{370}-\\x{37D}\\x{37F}-\\x{1FFF}\\x{200C}-\\x{200D}\\x{2070}-\\x{218F}\\x{2C00}-\\x{2FEF}\\x{3001}-\\x{D7FF}\\x{F900}-\\x{FDCF}\\x{FDF0}-\\x{FFFD}\\x{10000}-\\x{EFFFF}"
_NAME_MORE = "\\-.0-9\\x{B7}\\x{300}-\\x{36F}\\x{203F}-\\x{2040}"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often lambdas refer to it."""
    return F.transform(F.array(value), body)[0]


def _replaced(c: Column, table: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), table, c)


def escape(c: Column) -> Column:
    """``& < > ' "`` become entities."""
    return _replaced(c, _FULL)


def partial_escape(c: Column) -> Column:
    """``& < >`` become entities."""
    return _replaced(c, _PARTIAL)


def minimal_escape(c: Column) -> Column:
    """``& <`` become entities."""
    return _replaced(c, _MINIMAL)


ESCAPES = {"full": escape, "partial": partial_escape, "minimal": minimal_escape}


def list_escape(c: Column, level: str = "full") -> Column:
    """An item of a list: white space becomes character references too."""
    return _replaced(ESCAPES[level](c), _LIST)


@cache
def html_entities() -> dict[str, str]:
    """Named references of HTML 5 that end in a semicolon."""
    return {k[:-1]: v for k, v in html5.items() if k.endswith(";")}


def entity_map(entities: dict[str, str]) -> Column:
    """A constant map column; folded once, whatever its size."""
    mark = "\x01"
    names, values = mark.join(entities), mark.join(entities.values())
    return F.map_from_arrays(F.split(F.lit(names), mark), F.split(F.lit(values), mark))


def resolve_entity(name: Column, kind: str = "xml") -> Column:
    """Text of a named entity (``xml``: the five predefined, ``html``: HTML 5); else null."""
    return F.try_element_at(entity_map(PREDEFINED if kind == "xml" else html_entities()), name)


def char_ref_number(ref: Column) -> Column:
    """Number of ``#10`` or ``#xA`` (no sign, small x); null if malformed or out of range."""
    hexa = F.regexp_extract(ref, "^#x0*([0-9a-fA-F]{1,6})$", 1)
    deci = F.regexp_extract(ref, "^#0*([0-9]{1,7})$", 1)
    n = F.when(hexa != "", F.conv(hexa, 16, 10).cast("int")).when(deci != "", deci.cast("int"))
    return F.when((n >= 1) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), n)


def char_ref_error(ref: Column) -> Column:
    """Why a character reference is bad: ``UnexpectedSign``, ``InvalidNumber``,
    ``IllegalCharacter`` (zero) or ``InvalidCodepoint``; null for good ones."""
    body = F.regexp_replace(ref, "^#x?", "")
    return (
        F.when(char_ref_number(ref).isNotNull(), None)
        .when(body.rlike("^[+-]"), "UnexpectedSign")
        .when(ref.rlike("^#(x[0-9a-fA-F]+|[0-9]+)$"), F.when(body.rlike("^0+$"), "IllegalCharacter").otherwise("InvalidCodepoint"))
        .otherwise("InvalidNumber")
    )


def char_ref(ref: Column) -> Column:
    """Character of a reference without ``&`` and ``;``; null for names and bad numbers."""
    n = char_ref_number(ref)
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def resolve_reference(ref: Column, entities: Column | None = None, kind: str = "xml") -> Column:
    """Text of the inside of a reference, own entities first; null if unknown."""
    own = F.when(ref.startswith("#"), char_ref(ref)).otherwise(resolve_entity(ref, kind))
    return own if entities is None else F.coalesce(F.try_element_at(entities, ref), own)


def unescape(c: Column, entities: Column | None = None, kind: str = "xml", strict: bool = False) -> Column:
    """References resolved in one pass.

    What cannot be resolved stays as it is, or makes the result null (``strict``).
    ``entities`` is a map column of further names.
    """
    parts = F.regexp_extract_all(c, F.lit("&[^;&]*;|[^&]+|&"), F.lit(0))

    def one(x: Column) -> Column:
        inner = F.substring(x, F.lit(2), F.char_length(x) - 2)
        known = F.when(x.endswith(";"), resolve_reference(inner, entities, kind))
        return F.when(~x.startswith("&"), x).otherwise(known if strict else F.coalesce(known, x))

    bits = F.transform(parts, one)
    whole = F.array_join(bits, "")
    if strict:
        whole = F.when(F.exists(bits, lambda x: x.isNull()), None).otherwise(whole)
    return F.when(~F.contains(c, F.lit("&")), c).otherwise(whole)


def unescape_error(c: Column, entities: Column | None = None, kind: str = "xml") -> Column:
    """First problem of a text: struct (code, name), null if all references resolve."""
    parts = F.regexp_extract_all(c, F.lit("&[^;&]*;|[^&]+|&"), F.lit(0))

    def code(x: Column) -> Column:
        inner = F.substring(x, F.lit(2), F.char_length(x) - 2)
        name = (
            F.when(~x.startswith("&"), None)
            .when(~x.endswith(";"), "UnterminatedEntity")
            .when(inner.startswith("#"), F.when(char_ref_error(inner).isNotNull(), F.concat(F.lit("InvalidCharRef."), char_ref_error(inner))))
            .when(resolve_reference(inner, entities, kind).isNull(), "UnrecognizedEntity")
        )
        return F.when(name.isNotNull(), F.struct(name.alias("code"), F.when(x.endswith(";"), inner).alias("name")))

    return F.try_element_at(F.filter(F.transform(parts, code), lambda x: x.isNotNull()), F.lit(1))


def eol_xml10(c: Column) -> Column:
    """``CR LF`` and ``CR`` become ``LF``."""
    return F.regexp_replace(c, "\\r\\n?", "\n")


def eol_xml11(c: Column) -> Column:
    """As XML 1.1: also ``CR NEL``, ``NEL`` and the line separator."""
    return F.regexp_replace(c, "\\r[\\n\\x{85}]?|\\x{85}|\\x{2028}", "\n")


def trim_xml(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def trim_xml_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def trim_xml_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return trim_xml(c) == ""


def cdata_parts(c: Column) -> Column:
    """Contents of the CDATA sections that together hold a text (none may hold ``]]>``)."""
    return F.split(F.replace(c, F.lit("]]>"), F.lit("]]\x00>")), "\x00")


def cdata(c: Column) -> Column:
    """A text as CDATA sections."""
    return F.concat(F.lit("<![CDATA["), F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def xml_bool(c: Column) -> Column:
    """``true``/``1`` and ``false``/``0``; anything else is null."""
    return F.when(c.isin("true", "1"), True).when(c.isin("false", "0"), False)


#: Texts of numbers: sign and digits; digits with a point or an exponent; the names of what is none.
_INTEGER, _DECIMAL, _NO_NUMBER = "[+-]?[0-9]+", "[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?", "[+-]?(?i:inf|infinity|nan)"


def read_number(c: Column, kind: T.DataType) -> Column:
    """A text as a number of a type; null where it is none (no suffixes, no blanks inside)."""
    if isinstance(kind, T.IntegralType):
        return F.when(c.rlike(f"^{_INTEGER}$"), c.try_cast(kind))
    if isinstance(kind, T.DecimalType):
        return F.when(c.rlike(f"^{_DECIMAL}$"), c.try_cast(kind))
    name = F.lower(F.regexp_replace(c, "^[+-]", ""))
    word = F.when(name == "nan", "NaN").otherwise(F.when(c.startswith("-"), "-Infinity").otherwise("Infinity"))
    return F.when(c.rlike(f"^{_DECIMAL}$"), c.try_cast(kind)).when(c.rlike(f"^{_NO_NUMBER}$"), word.try_cast(kind))


def write_number(c: Column, kind: T.DataType) -> Column:
    """A number as text: the fewest digits that tell it, no exponent, no point in a whole one."""
    if not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType):
        return c.cast("string")
    # Java's own digits are not always the fewest
    wide = c.cast("double")
    tries = [F.format_string(f"%.{n - 1}e", wide) for n in ((6, 7, 8, 9) if isinstance(kind, T.FloatType) else (15, 16, 17))]
    shortest = F.coalesce(*[F.when(t.try_cast(kind) == c, t) for t in tries])

    def plain(s: Column) -> Column:
        parts = "^-?([0-9])\\.([0-9]*?)0*e([+-][0-9]+)$"
        more, e = F.regexp_extract(s, parts, 2), F.regexp_extract(s, parts, 3).try_cast("int")
        digits = F.concat(F.regexp_extract(s, parts, 1), more)
        whole = F.concat(F.substring(digits, F.lit(1), e + 1), F.repeat(F.lit("0"), F.greatest(e - F.char_length(more), F.lit(0))))
        rest = F.when(F.char_length(more) > e, F.concat(F.lit("."), F.substring(digits, e + 2, F.char_length(digits)))).otherwise("")
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        return F.concat(F.when(s.startswith("-"), "-").otherwise(""), F.when(e < 0, small).otherwise(F.concat(whole, rest)))

    endless = F.when(c > 0, "inf").otherwise("-inf")
    return F.when(F.isnan(c), "NaN").when(F.abs(c) == F.lit(float("inf")), endless).otherwise(F.coalesce(_few_digits(c, wide, kind), let(shortest, plain)))


def _few_digits(c: Column, wide: Column, kind: T.DataType) -> Column:
    """A number's text where it is sure without trying lengths, else null.

    A whole number below the type's last gapless one has its own digits.  A decimal of no
    more digits than the type always keeps (15, 6) is the shortest if it reads back the same.
    """
    digits, gapless = (6, 2.0**24) if isinstance(kind, T.FloatType) else (15, 2.0**53)
    size, whole = F.abs(wide), wide.try_cast("long")
    java = c.cast("string")
    point = F.rtrim(java.try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    long = java.try_cast("decimal(38,0)").cast("string")
    return (
        F.when(c == 0, F.when(java.startswith("-"), "-0").otherwise("0"))
        .when((size >= 1) & (size < gapless) & (whole.cast("double") == wide), whole.cast("string"))
        # the legacy cast to a text writes exponents
        .when(size < gapless, let(point, lambda t: F.when((F.char_length(t) <= digits + 1) & t.rlike("\\A-?[0-9]+\\.[0-9]+\\z") & (t.try_cast(kind) == c), t)))
        .when(size < 1e37, let(long, lambda t: F.when((F.char_length(F.rtrim(t, F.lit("0"))) <= digits) & (t.try_cast(kind) == c), t)))
    )


def is_xml_name(c: Column) -> Column:
    return c.rlike(f"^[{_NAME_START}][{_NAME_START}{_NAME_MORE}]*$")


def xs_list(c: Column) -> Column:
    """Items of a white-space separated list."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def local_name(name: Column) -> Column:
    """What follows the first colon; all of it without one."""
    return F.when(F.contains(name, F.lit(":")), F.regexp_extract(name, "(?s)^[^:]*:(.*)$", 1)).otherwise(name)


def prefix(name: Column) -> Column:
    """What precedes the first colon; null without one."""
    return F.when(F.contains(name, F.lit(":")), F.regexp_extract(name, "(?s)^([^:]*):", 1))


def is_xml_prefix(name: Column) -> Column:
    """True for a prefix, or a name with it, that is bound to the XML namespace."""
    return F.coalesce(prefix(name), name) == "xml"


def is_xmlns_prefix(name: Column) -> Column:
    """True for a prefix, or a name with it, that declares prefixes."""
    return F.coalesce(prefix(name), name) == "xmlns"
