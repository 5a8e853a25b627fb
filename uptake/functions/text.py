"""Unicode-aware text expressions.

Spark's own ``trim`` knows only the ASCII space and ``initcap`` only capitalises after a space, so
both are extended here with built-in expressions that stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space.
WHITESPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

_CASED = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]"
_WORD_START = f"(?<!{_CASED})(?={_CASED})"
_MARK = "\u0001 "


def strip(text: Column) -> Column:
    """Drop leading and trailing white space of any kind, NBSP included."""
    return F.btrim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """Turn every run of white space into one space and trim the ends."""
    return F.btrim(F.regexp_replace(text, WHITESPACE_RUN, " "), F.lit(" "))


def title_case(text: Column) -> Column:
    """Capitalise each run of letters and lower the rest, after any non-letter.

    A marker that ends in a space goes before each run, ``initcap`` then capitalises every run
    (and lowers the rest), and the marker comes out again.
    """
    marked = F.regexp_replace(text, _WORD_START, _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def contains_any(text: Column, fragments) -> Column:
    """True where ``text`` holds at least one of the literal fragments."""
    found = F.lit(False)
    for fragment in fragments:
        found = found | text.contains(fragment)
    return found
