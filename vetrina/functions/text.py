"""Column expressions for text: all built-in, codegen-friendly, no UDFs."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


#: Prices keep every digit: 20 before the point, 18 behind it.
DECIMAL = "decimal(38,18)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that a row evaluates once, however often ``body``
    uses it: a lambda's variable. Common subexpressions inside higher-order
    functions are evaluated each time else, and a filter that moves below a
    projection takes a copy of the column's expression per use."""
    return F.transform(F.array(value), body)[0]


def capacity(title) -> Column:
    """First ``<digits> ml`` of a title as ``'N ml'``; NULL when absent."""
    digits = F.regexp_extract(_c(title), P.CAPACITY, 1)
    return F.when(digits != "", F.concat(digits, F.lit(" ml")))


def strip_suffix(uri, suffix: str = P.RICH_SNIPPET) -> Column:
    """Remove one trailing ``suffix``."""
    u = _c(uri)
    return F.when(u.endswith(suffix), u.substr(F.lit(1), F.length(u) - len(suffix))).otherwise(u)


def strip_all(uri, marker: str = P.RICH_SNIPPET) -> Column:
    """Remove every occurrence of ``marker``."""
    return F.replace(_c(uri), F.lit(marker), F.lit(""))


def trim_ws(s) -> Column:
    return F.regexp_replace(_c(s), P.TRIM_WS, "")


def _code_point(number: Column) -> Column:
    """The character that a numeric reference stands for: of 128 to 159 the
    Windows one, U+FFFD for zero, surrogates and numbers past the last code
    point, nothing for other controls and non-characters."""
    windows = F.array(*(F.lit(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(0x80, 0xA0)))
    raw = F.unhex(F.lpad(F.hex(number), 8, "0"))
    none = (number.between(1, 8) | number.isin(0xB, 0x7F) | number.between(0xE, 0x1F) | number.between(0xFDD0, 0xFDEF)
            | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    return (F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("\ufffd"))
             .when(number.between(0x80, 0x9F), F.element_at(windows, (number - 0x7F).cast("int")))
             .when(none, F.lit("")).otherwise(F.decode(raw, "UTF-32")))


#: Slots of the table of named references; about two names share one.
_NAME_SLOTS = 1024
#: The longest name that counts without its semicolon, also as a prefix.
_LONGEST_BARE = max(len(k) for k in html5 if not k.endswith(";"))


def _named() -> Callable[[Column], Column]:
    """Look-up of a reference's name (with its semicolon, if it has one): a
    hashed table, one constant of the plan."""
    slots: list[dict[str, str]] = [{} for _ in range(_NAME_SLOTS)]
    for name, value in html5.items():
        slots[zlib.crc32(name.encode()) % _NAME_SLOTS][name] = value
    table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>")
    return lambda name: F.try_element_at(F.element_at(table, (F.crc32(name.cast("binary")) % _NAME_SLOTS + 1).cast("int")), name)


def char_references(s) -> Column:
    """Decimal, hexadecimal and named (HTML5) character references decoded,
    each once; names that may lack their semicolon also as the longest prefix
    of what follows. Anything else after an ampersand stays."""
    named = _named()

    def numeric(ref):
        digits = F.regexp_extract(ref, r"\A#[xX]?0*([0-9A-Fa-f]*)", 1)
        number = F.when(F.length(digits) > 7, F.lit(1 << 30)).when(ref.rlike("\\A#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(
            F.when(digits == "", F.lit(0)).otherwise(digits.cast("long")))
        return _code_point(F.coalesce(number, F.lit(0)))

    def prefix(ref, n):
        value = named(F.substring(ref, 1, n))
        return F.when(F.length(ref) > n, F.concat(value, F.substring(ref, n + 1, 33)))

    def part(x):
        ref = F.regexp_extract(x, P.CHAR_REFERENCE, 1)
        char = F.when(ref.startswith("#"), numeric(ref)).when(ref != "", F.coalesce(named(ref), *(prefix(ref, n) for n in range(_LONGEST_BARE, 1, -1))))
        return F.coalesce(F.concat(char, F.substring(x, F.length(ref) + 1, F.length(x))), F.concat(F.lit("&"), x))

    parts = F.split(_c(s), "&", -1)
    return F.when(_c(s).contains("&"), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), part), ""))).otherwise(_c(s))


def html_to_text(html) -> Column:
    """Each run of comments, scripts, styles and tags becomes one space;
    character references are decoded and the ends trimmed. Non-HTML text passes."""
    return trim_ws(char_references(F.regexp_replace(_c(html), P.HTML_RUN, " ")))


def parse_cap(price) -> Column:
    """``'<30'`` or ``'< 30'`` -> 30 as a decimal; anything else NULL."""
    body = F.trim(F.replace(_c(price), F.lit("<"), F.lit("")))
    return F.when(body.rlike(P.DECIMAL_TEXT), body.try_cast(DECIMAL))


def decimal_or_null(text) -> Column:
    """Xsd:decimal cast; exponents, commas and blanks give NULL."""
    t = _c(text)
    return F.when(t.rlike(P.DECIMAL_TEXT), F.trim(t).try_cast(DECIMAL))


def collapse_spaces(s) -> Column:
    return F.regexp_replace(F.trim(_c(s)), r"\s+", " ")


def capitalise_words(s) -> Column:
    """Split on blanks, first letter upper and the rest lower, one space."""
    return F.initcap(F.lower(collapse_spaces(s)))


def to_keywords(category, label, cap, brand, price) -> Column:
    """``category label capacity brand minori di N euro``, lower-cased and
    trimmed, absent (NULL or empty) parts skipped."""

    def part(c):
        v = F.lower(F.trim(_c(c)))
        return F.when(v != "", v)

    p = F.trim(F.replace(_c(price), F.lit("<"), F.lit("")))
    price_part = F.when(p != "", F.concat(F.lit("minori di "), p, F.lit(" euro")))
    return F.concat_ws(" ", part(category), part(label), part(cap), part(brand), price_part)


def tokens(text) -> Column:
    """Lower-case word tokens (letters, digits, '#', '&', apostrophe inside)."""
    return F.filter(
        F.split(F.lower(_c(text)), r"[^\p{L}\p{Nd}#&']+"),
        lambda t: t != "",
    )
