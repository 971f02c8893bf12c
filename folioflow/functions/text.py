"""Text functions whose results do not depend on an engine's idea of white space.

White space here is ASCII's and that of Unicode's space separators, line and paragraph separator, and the byte order mark. All
functions take and return Spark columns; lengths and positions count code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, and the invisible characters that titles are cleared of.
WS_CODES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
INVISIBLE_CODES = (*range(0x200B, 0x2010), *range(0x2028, 0x2030), 0xFEFF)
WS = "[" + "".join(map(chr, WS_CODES)) + "]"
INVISIBLE = "[" + "".join(map(chr, INVISIBLE_CODES)) + "]"
#: Places between a word character (ASCII letter, digit, underscore) and none, before and after a word.
BEFORE_WORD, AFTER_WORD = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+\\z", "")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def norm_title(text: Column) -> Column:
    """Without invisible characters, in lower case, runs of white space as one space, trimmed."""
    return trim(F.regexp_replace(F.lower(strip_invisible(text)), f"{WS}+", " "))


def norm_search(text: Column) -> Column:
    """In lower case, no white space around hyphens, runs of white space as one space; not trimmed."""
    spaced = F.translate(F.lower(text), "".join(map(chr, WS_CODES)), " " * len(WS_CODES))  # one kind of space makes the patterns quick
    return F.regexp_replace(F.regexp_replace(spaced, " *- *", "-"), "  +", " ")


def norm_query(query: str) -> str:
    """What :func:`norm_search` makes of a query."""
    return re.sub(f"{WS}+", " ", re.sub(f"{WS}*-{WS}*", "-", query.lower()))


def count_occurrences(text: Column, word: str) -> Column:
    """How often ``word`` occurs in ``text``, from left to right without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("long")


def index_of(text: Column, word: str) -> Column:
    """The place of the first ``word`` from 0, or -1."""
    return F.instr(text, F.lit(word)) - 1


def snippet(text: Column, at: Column, normal_length: Column, query_length: int, margin: int = 75) -> Column:
    """The part of ``text`` around a hit at ``at`` of its normalised form: the place is carried over by the lengths' ratio."""
    length = F.length(text)
    start = F.when((at <= 0) | (length == 0), F.lit(0)).otherwise(F.least(F.floor(at / normal_length * length).cast("int"), length - 1))
    a, b = F.greatest(F.lit(0), start - margin), F.least(length, start + query_length + margin)
    body = trim(F.substr(text, a + 1, b - a))
    return F.concat(F.when(a > 0, "...").otherwise(""), body, F.when(b < length, "...").otherwise(""))


def section_number(title: Column) -> Column:
    """The number that a title begins with ("7.3.4", "1" of "1. Introduction", "Annex A.1", "Appendix B"), or null."""
    t = trim(strip_invisible(title))

    def group(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))

    appendix = F.regexp_replace(group(f"^((?i:Appendix){WS}+[A-Za-z])"), "^(?i:appendix)", "Appendix")
    return F.coalesce(group(f"^([0-9]+(?:\\.[0-9]+)*){WS}+"), group(f"^([0-9]+)\\.{WS}+[A-Z]"), group(f"^((?i:Annex){WS}+[A-Za-z](?:\\.[0-9]+)*)"), appendix)


def section_title(title: Column, number: Column) -> Column:
    """A title without the number and without a leading "(normative)" or "(informative)"; whole where there is no such number."""
    head = f"^(?:[0-9]+(?:\\.[0-9]+)*|(?i:Annex){WS}+[A-Za-z](?:\\.[0-9]+)*){WS}+"
    bare = F.regexp_replace(F.regexp_replace(title, head, ""), f"^\\((?i:normative|informative)\\){WS}*", "")
    return F.when(number.isNotNull() & F.rlike(title, F.lit(head)), bare).otherwise(title)


def is_likely_term(text: Column) -> Column:
    """Whether a trimmed paragraph may be a term: short, no closing punctuation, none of the usual openings, no bare number."""
    no_end = ~F.endswith(text, F.lit(".")) & ~F.endswith(text, F.lit(":")) & ~F.endswith(text, F.lit(")"))
    starts = [~F.startswith(text, F.lit(s)) for s in ("NOTE", "EXAMPLE", "[", "For the purposes", "ISO ")]
    out = (F.length(text) > 0) & (F.length(text) < 80) & no_end & ~F.rlike(text, F.lit("^[0-9]+(\\.[0-9]+)*\\z"))
    for s in starts:
        out &= s
    return out


def subtree(number: Column, root: str) -> Column:
    """Whether a section number is ``root`` or below it."""
    return (number == root) | F.startswith(number, F.lit(root + "."))
