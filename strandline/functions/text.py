"""Column functions on text that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, no-break spaces included; the same class works in RE2.
WHITE = r"[\s\x0B\x85\p{Z}]"
#: A line that only repeats the breadcrumb of its chunk.
SECTION_LINE = rf"(?i)^{WHITE}*SECTION:"


#: The characters of ``WHITE``, for a trim that looks at the ends only.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(c: Column) -> Column:
    """``c`` without white space of any kind at both ends; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    """``trimmed``, with null for what is then empty."""
    t = trimmed(c)
    return F.when(t != "", t)


def folded(c: Column) -> Column:
    """One letter case; by way of upper case, so that letters with two lower-case forms agree."""
    return F.lower(F.upper(c))


def lines(c: Column) -> Column:
    """The lines of a text, split at newline characters; none is dropped."""
    return F.split(c, "\n", -1)


def is_section(line: Column) -> Column:
    return line.rlike(SECTION_LINE)


def body(c: Column) -> Column:
    """The text without its SECTION line (the first such line, wherever it stands), not trimmed."""
    whole = lines(c)
    at = F.array_position(F.transform(whole, is_section), True).cast("int")
    rest = F.array_join(F.concat(F.slice(whole, 1, at - 1), F.slice(whole, at + 1, F.size(whole))), "\n")
    first = F.substring_index(c, "\n", 1)
    # the common case, the line standing first, needs no array
    return F.when(is_section(first), F.substr(c, F.length(first) + 2)).when(at > 0, rest).otherwise(c)


def letters_digits(c: Column) -> Column:
    """Only letters and digits, in one case."""
    return F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", "")


def words(c: Column) -> Column:
    """Runs of letters and digits, in one case."""
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
