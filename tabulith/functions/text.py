"""String expressions that agree with Unicode-aware rules; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All code points that count as blank, from the rule itself.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def _class(rule) -> str:
    """A character class of all code points for which rule holds."""
    parts, start = [], None
    for i in range(0x110001):
        inside = i < 0x110000 and rule(chr(i))
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            parts.append(f"\\x{{{start:x}}}-\\x{{{i - 1:x}}}")
            start = None
    return "".join(parts)


#: Digits of all scripts, superscripts and circled ones included.
DIGITS = _class(str.isdigit)
DIGIT = f"[{DIGITS}]"


def strip(c: Column) -> Column:
    """c without blanks at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    """Whether c holds anything but blanks."""
    return F.length(strip(c)) > 0


def first_of(*columns: Column) -> Column:
    """The first column that isn't null or empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def matches(c: Column, pattern: str) -> Column:
    """How many matches of pattern c holds."""
    return F.regexp_count(c, F.lit(pattern))


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def counted(c: Column, plain: str, full: str) -> Column:
    """How many characters of a class c holds: where all of c is ASCII by taking the others out, which is much faster than listing matches, else by the full class."""
    others = "".join(chr(i) for i in range(128) if not re.match(plain, chr(i)))
    return F.when(is_ascii(c), F.length(F.translate(c, others, ""))).otherwise(matches(c, full))


def occurrences(c: Column, what: str) -> Column:
    """How often one character stands in c."""
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def repeats(c: Column, n: int) -> Column:
    """Whether some piece of n characters stands in c twice; overlaps count."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) > n, F.size(pieces) != F.size(F.array_distinct(pieces))).otherwise(False)


def quoted(term: str) -> str:
    """A term as a pattern that matches it literally, in both regular-expression dialects."""
    return "".join(f"\\{ch}" if ch in r"\.^$|?*+()[]{}-&#" else ch for ch in term)
