"""Scalar rules over Unicode text, as JVM-side expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Code points that carry no usable text: U+FFFD, controls, unassigned (noncharacters too), private use, surrogates.
UNUSABLE = r"[\x{FFFD}\p{Cc}\p{Cn}\p{Co}\p{Cs}]"
COMBINING, NON_BMP = r"\p{M}", r"[\x{10000}-\x{10FFFF}]"
VARIATION, JOINER = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]", r"\x{200D}"
BIDI_CONTROL = r"[\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"


_rtl: dict[str, str] = {}


def rtl() -> str:
    """A pattern of all code points that the JVM's table says run right to left (R and AL): ranges, found once for an application."""
    spark = SparkSession.active()
    key = spark.sparkContext.applicationId
    if key not in _rtl:
        points = spark.range(0x110000).filter("id < 55296 OR id > 57343")
        kind = F.call_function("reflect", F.lit("java.lang.Character"), F.lit("getDirectionality"), F.col("id").cast("int"))
        found = sorted(r[0] for r in points.filter(kind.isin("1", "2")).collect())  # some thousands, whatever the data
        runs: list[list[int]] = []
        for p in found:
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        _rtl[key] = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]"
    return _rtl[key]


def plain(text: Column) -> Column:
    """Whether all of a text is ASCII: told by its lengths, without a look at its characters."""
    return F.octet_length(text) == F.char_length(text)


def usable(text: Column) -> Column:
    """Null and empty texts aren't usable. One printable ASCII character, as most are, needs no pattern."""
    simple = (F.octet_length(text) == 1) & text.between(" ", "~")
    return F.when(text.isNull(), False).when(simple, True).otherwise((text != "") & ~text.rlike(UNUSABLE))


def all_usable(texts: Column) -> Column:
    """Whether every text of an array is usable; those of an empty one are."""
    said = F.array_join(texts, "")
    return F.coalesce((F.size(F.array_compact(texts)) == F.size(texts)) & ~F.array_contains(texts, "") & ~said.rlike(UNUSABLE), F.lit(True))


def count_of(text: Column, pattern: str) -> Column:
    """How often a pattern of characters beyond ASCII matches."""
    return F.when(text.isNull() | plain(text), F.lit(0)).otherwise(F.regexp_count(text, F.lit(pattern))).cast("bigint")


def canonical(text: Column) -> Column:
    """A text without blanks of any kind, for comparing reading orders."""
    return F.regexp_replace(text, r"[\p{Z}\s\x1c-\x1f]", "")


def code_points(text: Column) -> Column:
    return F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


#: Escapes of annotation lines, in order, and of HTML.
DATA_ESCAPES = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")]
PROPERTY_ESCAPES = [*DATA_ESCAPES, (":", "%3A"), (",", "%2C")]
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("|", "&#124;"), ("\r", "&#13;"), ("\n", "&#10;")]


def escape_data(text: Column) -> Column:
    return replaced(text, DATA_ESCAPES)


def escape_property(text: Column) -> Column:
    return replaced(text, PROPERTY_ESCAPES)


def escape_html(text: Column) -> Column:
    return replaced(text, HTML_ESCAPES)


def escape_terminal(text: Column) -> Column:
    """Controls, format characters and line separators as \\uXXXX, beyond the BMP \\UXXXXXXXX."""
    unsafe = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\p{Cs}]"
    code = lambda c: F.ascii(c).cast("bigint")
    shown = lambda c: F.when(code(c) > 0xFFFF, F.concat(F.lit("\\U"), F.lpad(F.hex(code(c)), 8, "0"))).otherwise(F.concat(F.lit("\\u"), F.lpad(F.hex(code(c)), 4, "0")))
    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(unsafe), shown(c)).otherwise(c))
    return F.when(text.rlike(unsafe), F.array_join(each, "")).otherwise(text)


def bounded_name(name: Column, fallback: str, most: int = 128) -> Column:
    """A name without controls, of at most so many code points; the fallback for null and blank ones."""
    clean = F.substring(F.regexp_replace(name, r"\p{Cc}", ""), 1, most)
    blank = ~name.rlike(r"[^\t-\r\x1c-\x1f\p{Z}]|[\xA0\x{2007}\x{202F}]")
    return F.when(name.isNull() | blank | (clean == ""), F.lit(fallback)).otherwise(clean)


def error_text(message: Column) -> Column:
    """One line of at most 500 characters."""
    return F.substring(F.trim(F.translate(message, "\r\n\t", "   ")), 1, 500)


def is_subset(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Z]{6}\+.+$"), F.lit(False))
