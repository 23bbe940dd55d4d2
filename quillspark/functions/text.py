"""Column functions on text: strip, titles, decks, notes, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a character class of both Java and RE2.
BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same for Java alone, which tests it by a character's kind and not range by range.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
_SPACES = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode white space included. What is between them is not searched."""
    return F.btrim(text, F.lit(_SPACES))


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines without their ends; no empty line after a last line end."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def trim_title(title: Column, separator: str, keep_if_absent: bool = False) -> Column:
    """What stands before the last ``separator``; the title itself for an empty one; '' (or the title) if it is absent."""
    if not separator:
        return title
    times = ((F.length(title) - F.length(F.replace(title, F.lit(separator), F.lit("")))) / len(separator)).cast("int")
    cut = F.call_function("substring_index", title, F.lit(separator), times)
    return F.when(times > 0, cut).otherwise(title if keep_if_absent else F.lit(""))


def deck_name(author: Column, title: Column, structure: bool = True) -> Column:
    return F.concat_ws("::", F.lit("books"), author, title) if structure else title


def deck_id(name: Column) -> Column:
    """The SHA-1 of the name modulo 2^32."""
    return F.conv(F.right(F.sha1(name), F.lit(8)), 16, 10).cast("long")


def note_guid(author: Column, title: Column, end: Column) -> Column:
    """The same for a note whenever its book is exported again."""
    return F.sha2(F.concat_ws("__", html_escape(author), html_escape(title), end.cast("string")), 256)


def reverse_text(text: Column) -> Column:
    """The stand-in for a translation: code points backwards."""
    return F.reverse(text)


def ratio(n: Column, d: Column) -> Column:
    """n / d to one decimal, exact ties to even; 0 if there is nothing to divide by. Whole numbers alone decide the digit."""
    n, d = n.cast("long"), F.when(d > 0, d).cast("long")
    q = F.call_function("div", n * 10, d)
    r = n * 10 - q * d
    up = F.when((r * 2 > d) | ((r * 2 == d) & (q % 2 == 1)), 1).otherwise(0)
    return F.coalesce((q + up) / F.lit(10.0), F.lit(0.0))


def percentage(n: Column, d: Column) -> Column:
    """n / d in per cent, truncated; 0 if there is nothing to divide by."""
    return F.coalesce((n.cast("double") / F.when(d > 0, d).cast("double") * 100).cast("long"), F.lit(0).cast("long"))


def level_of(rank: Column, bands: list[tuple[int, int]]) -> Column:
    """Index of the first band [low, high) that holds ``rank``, or 0."""
    out = F.lit(0)
    for i, (low, high) in reversed(list(enumerate(bands))):
        out = F.when((rank >= low) & (rank < high), i).otherwise(out)
    return out
