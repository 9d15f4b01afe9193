"""Encodings: detection by the first bytes, labels, and decoding of whole documents."""

from __future__ import annotations

from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import entity_map


def detect_encoding(c: Column) -> Column:
    """Struct (charset, bom_length) by byte order mark or the first four bytes; else null."""
    head = F.hex(F.substring(c, 1, 4))

    def found(charset: str, bom: int) -> Column:
        return F.struct(F.lit(charset).alias("charset"), F.lit(bom).alias("bom_length"))

    return (
        F.when(head.startswith("FEFF"), found("UTF-16BE", 2))
        .when(head.startswith("FFFE"), found("UTF-16LE", 2))
        .when(head.startswith("EFBBBF"), found("UTF-8", 3))
        .when(head == "003C003F", found("UTF-16BE", 0))
        .when(head == "3C003F00", found("UTF-16LE", 0))
        .when(head == "3C3F786D", found("UTF-8", 0))
    )


def declared_encoding(c: Column) -> Column:
    """Label of the encoding named by an XML declaration in ASCII-compatible bytes; else null."""
    head = F.decode(F.substring(c, 1, 256), "ISO-8859-1")
    label = F.regexp_extract(head, "^(?:\\x{EF}\\x{BB}\\x{BF})?<\\?xml[ \\t\\r\\n][^>]*?encoding[ \\t\\r\\n]*=[ \\t\\r\\n]*[\"']([A-Za-z0-9._:-]+)[\"']", 1)
    return F.nullif(label, F.lit(""))


def _families() -> dict[str, list[str]]:
    """Labels of each Java charset, by the rules browsers use."""
    out = {
        "UTF-8": ["utf-8", "utf8", "unicode-1-1-utf-8", "unicode11utf8", "unicode20utf8", "x-unicode20utf8"],
        "UTF-16LE": ["utf-16", "utf-16le", "unicode", "ucs-2", "iso-10646-ucs-2", "csunicode", "unicodefeff"],
        "UTF-16BE": ["utf-16be", "unicodefffe"],
        "IBM866": ["ibm866", "866", "cp866", "csibm866"],
        "KOI8-R": ["koi8-r", "koi8", "koi", "koi8_r", "cskoi8r"],
        "KOI8-U": ["koi8-u", "koi8-ru"],
        "x-MacRoman": ["macintosh", "mac", "x-mac-roman", "csmacintosh"],
        "x-MacCyrillic": ["x-mac-cyrillic", "x-mac-ukrainian"],
        "GBK": ["gbk", "x-gbk", "gb2312", "gb_2312", "gb_2312-80", "chinese", "csgb2312", "csiso58gb231280", "iso-ir-58"],
        "GB18030": ["gb18030"],
        "Big5-HKSCS": ["big5", "big5-hkscs", "cn-big5", "csbig5", "x-x-big5"],
        "EUC-JP": ["euc-jp", "x-euc-jp", "cseucpkdfmtjapanese"],
        "ISO-2022-JP": ["iso-2022-jp", "csiso2022jp"],
        "windows-31j": ["shift_jis", "shift-jis", "sjis", "x-sjis", "ms_kanji", "ms932", "windows-31j", "csshiftjis"],
        "x-windows-949": ["euc-kr", "korean", "ks_c_5601-1987", "ks_c_5601-1989", "ksc5601", "ksc_5601", "windows-949", "cseuckr", "csksc56011987", "iso-ir-149"],
        "windows-874": ["windows-874", "dos-874", "tis-620", "iso-8859-11", "iso8859-11", "iso885911"],
    }
    for n in range(1250, 1259):
        out[f"windows-{n}"] = [f"windows-{n}", f"cp{n}", f"x-cp{n}"]
    # number, Java charset, registry number, year, further names
    iso = [
        (1, "windows-1252", 100, 1987, "latin1 l1 ascii us-ascii ansi_x3.4-1968 cp819 ibm819"), (2, "ISO-8859-2", 101, 1987, "latin2 l2"), (3, "ISO-8859-3", 109, 1988, "latin3 l3"),
        (4, "ISO-8859-4", 110, 1988, "latin4 l4"), (5, "ISO-8859-5", 144, 1988, "cyrillic"), (6, "ISO-8859-6", 127, 1987, "arabic asmo-708 ecma-114 iso-8859-6-e iso-8859-6-i csiso88596e csiso88596i"),
        (7, "ISO-8859-7", 126, 1987, "greek greek8 ecma-118 elot_928 sun_eu_greek"), (8, "ISO-8859-8", 138, 1988, "hebrew visual iso-8859-8-e csiso88598e logical iso-8859-8-i csiso88598i"),
        (9, "windows-1254", 148, 1989, "latin5 l5"), (13, "ISO-8859-13", None, None, ""), (15, "ISO-8859-15", None, None, "l9 csisolatin9"), (16, "ISO-8859-16", None, None, ""),
    ]
    for n, charset, ir, year, more in iso:
        names = [f"iso-8859-{n}", f"iso8859-{n}", f"iso8859{n}", f"iso_8859-{n}", *more.split()]
        names += [f"iso-ir-{ir}", f"iso_8859-{n}:{year}"] if ir else []
        names += [f"csiso{x}" for x in more.split()[:1] if x.startswith(("latin", "cyrillic", "arabic", "greek", "hebrew"))]
        out.setdefault(charset, []).extend(names)
    # Latin 6 and 8 have no charset in Java: the nearest ones that differ in few signs are not theirs
    return out


@cache
def labels() -> dict[str, str]:
    """Java charset of each known label."""
    return {label: charset for charset, names in _families().items() for label in names}


def charset_of(label: Column) -> Column:
    """Java charset of an encoding label; a label that is not known is taken as a charset's name."""
    low = F.lower(F.trim(label))
    return F.coalesce(F.try_element_at(entity_map(labels()), low), low)


def effective_charset(c: Column, explicit: str | None = None) -> Column:
    """Explicit beats the declaration, which beats the mark; UTF-8 otherwise.

    A document of two-byte characters is read by its mark: its declaration cannot be
    seen as single bytes.
    """
    if explicit is not None:
        return charset_of(F.lit(explicit))
    found = detect_encoding(c)["charset"]
    wide = found.isin("UTF-16BE", "UTF-16LE")
    return F.when(wide, found).otherwise(F.coalesce(charset_of(declared_encoding(c)), found, F.lit("UTF-8")))


def strip_bom(c: Column) -> Column:
    """A text without the byte order mark at its start."""
    return F.regexp_replace(c, "^\\x{FEFF}", "")


def _decode(c: Column, charset: Column) -> Column:
    """Spark's ``decode`` open to all charsets of Java; in SQL a session's setting decides that."""
    jvm = SparkContext._active_spark_context._jvm
    node = jvm.org.apache.spark.sql.classic.ExpressionUtils
    raw, name = (node.expression(x._jc) for x in (c, charset))
    return Column(node.column(jvm.org.apache.spark.sql.catalyst.expressions.StringDecode(raw, name, True, False)))


def decode_document(c: Column, explicit: str | None = None) -> Column:
    """Text of a document's bytes, without its mark; malformed bytes raise an error.

    Every Java charset is taken, whatever ``spark.sql.legacy.javaCharsets`` says.
    """
    return strip_bom(_decode(c, effective_charset(c, explicit)))
