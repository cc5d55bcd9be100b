"""Text expressions."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import finite

# The two word-boundary patterns of the camelCase rule.
_WORD_START = "(.)([A-Z][a-z]+)"
_CAPITAL_AFTER_LOWER = "([a-z0-9])([A-Z])"

# Named entities of markup, their characters, and the pieces a text is cut into.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0"}
_ENTITY_PIECES = "&(?:amp|lt|gt|quot|apos|nbsp|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});|&|[^&]+"


def camel_to_snake(value: Column) -> Column:
    """camelCase text to snake_case."""
    words = F.regexp_replace(value, _WORD_START, "$1_$2")
    return F.lower(F.regexp_replace(words, _CAPITAL_AFTER_LOWER, "$1_$2"))


def snake_name(name: str) -> str:
    """The same rule for one column name, applied while the plan is built: a capital
    begins a word before a small letter, and after a small letter or a digit."""

    def begins(at: int) -> bool:
        before, after = name[at - 1], name[at + 1 : at + 2]
        return "A" <= name[at] <= "Z" and ("a" <= after <= "z" or "a" <= before <= "z" or "0" <= before <= "9")

    cuts = [0, *filter(begins, range(1, len(name))), len(name)]
    return "_".join(name[a:b] for a, b in pairwise(cuts)).lower()


def market_cap_millions(text: Column, empty_as_zero: bool = True) -> Column:
    """``$1.5B`` style text to millions.

    The first character is the currency sign and is always cut; with an ``M``
    or ``B`` the last one is cut too. Malformed text gives NULL, and so do NaN and
    infinity.
    """
    inner = text.substr(F.lit(2), F.length(text) - F.lit(2)).try_cast("double")
    tail = text.substr(F.lit(2), F.length(text)).try_cast("double")
    parsed = F.when(text.contains("M"), inner).when(text.contains("B"), inner * F.lit(1000.0))
    if empty_as_zero:
        parsed = parsed.when(text == "", F.lit(0.0))
    return finite(parsed.otherwise(tail / F.lit(1e6)))


def unescaped(text: Column) -> Column:
    """Text with its entities decoded once, left to right: named ones, and code points in
    decimal or hex. Numbers that are no character stay as they are."""

    def character(code: Column) -> Column:
        known = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def decoded(piece: Column) -> Column:
        digits = F.rtrim(piece, F.lit(";"))
        decimal = F.substring(digits, 3, 7).try_cast("long")
        hexadecimal = F.conv(F.substring(digits, 4, 6), 16, 10).try_cast("long")
        value = F.when(piece.startswith("&#x") | piece.startswith("&#X"), character(hexadecimal))
        value = value.when(piece.startswith("&#"), character(decimal))
        for name, plain in ENTITIES.items():
            value = value.when(piece == name, F.lit(plain))
        return F.coalesce(value, piece)

    pieces = F.regexp_extract_all(text, F.lit(_ENTITY_PIECES), F.lit(0))
    return F.when(~text.contains("&"), text).otherwise(F.array_join(F.transform(pieces, decoded), ""))


def host_port(host: Column, port: Column) -> Column:
    """``host:port``; NULL if either part is missing."""
    return F.when(host.isNotNull() & port.isNotNull(), F.concat_ws(":", host, port))


def stamp_text(ts: Column) -> Column:
    """Time stamp as ``2024-01-31-23-59-58``.

    Built from its text form, since date formats go through the session time zone.
    """
    return F.translate(F.substring(ts.cast("string"), 1, 19), " :", "--")


def iso_timestamp(text: str) -> Column:
    """Literal for an ISO date or date-time, without a time zone."""
    return F.to_timestamp_ntz(F.lit(text))
