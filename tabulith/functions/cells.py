"""Expressions on table cells: header types, gates' patterns, uncertainties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulith.functions.text import filled, strip

# The columns of the output record, in order.
COLUMNS = (
    "Sample", "Nation/Region/GeoTectonic unit/Groups", "Tectonic unit", "Subtectonic unit/Sub groups", "Longitude", "Latitude", "Lithology", "Pluton", "Age(Ma)",
    "Sm", "Nd", "147Sm/144Nd", "143Nd/144Nd", "2σ", "fSm/Nd", "εNd(t)", "TDM1", "TDM2", "Ref. Author", "Ref. Year", "Ref. Journal", "Title", "Volume", "Page", "DOI",
)
HEADERS = COLUMNS[:18]
REGION, TECTONIC, SUBTECTONIC = COLUMNS[1:4]
RATIO, SIGMA = "143Nd/144Nd", "2σ"

# Patterns that headers and cells are recognised by.
SM_ND = r"(ε|ɛ|e|E)Nd ?\(([DIGITS]+|t|T)\)|1?43 ?Nd|1?44 ?Nd|1?47 ?Sm|\(cid:[DIGITS]+\)Nd|fSm/Nd|Sm/Nd"
ENCODED = r"\(cid:[0-9]+\)"
CONFUSED = r"I．|O．|o．|．I|．O|．o|[0-9IoO]土[0-9IoO]|[0-9IoO]士[0-9IoO]"
_SEPARATOR = r"([°\"'‘′’＇″¢Oo`]|\(cid:[0-9]+\))"  # marks of degrees, minutes and seconds, as decoders confuse them
DEGREES = rf"[1-3]?[0-9]?[0-9]{_SEPARATOR}[0-6]?[0-9]{_SEPARATOR}[0-6]?[0-9]{_SEPARATOR}\.?[0-9]?[0-9]?[0-9]?"
ISOTOPE_PAPER = r"εNd|Sr-Nd|Sr-Nd-Hf|143Nd/144Nd|Nd isotope|isotopic|TDM"
NO_BACKSLASH = r"[!-/:-@\[\]-`{-~]"  # ASCII punctuation but the backslash

#: Types by words that a lower-case header contains; the first rule that holds decides.
BY_WORD = (
    ("Sample", ("samp",)),
    (SUBTECTONIC, ("subtectonic", "sub groups", "subgroups")),
    (REGION, ("nation", "region", "ocean", "locality", "geotectonic", "groups")),
    (TECTONIC, ("tectonic",)),
    ("Latitude", ("latitude",)),
    ("Longitude", ("longitude",)),
    ("Lithology", ("lithology", "rock", "description")),
    ("Pluton", ("pluton",)),
    ("Age(Ma)", ("age",)),
)
#: Types by a pattern in the header as it stands.
BY_PATTERN = (("147Sm/144Nd", "1?47 ?Sm"), (RATIO, "1?43 ?Nd"), (SIGMA, "2σ|± ?2"), ("εNd(t)", "(ε|ɛ|e|E)Nd"), ("fSm/Nd", "(?i)fsm/?nd"), ("TDM1", "TDM1"), ("TDM2", "TDM2"))


def sm_nd_pattern(digits: str) -> str:
    return SM_ND.replace("[DIGITS]", f"[{digits}]")


def has_sm_nd(c: Column) -> Column:
    """Whether a cell names an Sm-Nd quantity."""
    from tabulith.functions.text import DIGITS

    return (F.contains(c, F.lit("Nd")) | F.contains(c, F.lit("Sm"))) & c.rlike(sm_nd_pattern(DIGITS))


def is_coordinate(c: Column) -> Column:
    """Whether a cell holds degrees, minutes and seconds."""
    return filled(c) & c.rlike(DEGREES)


def names_sample(c: Column) -> Column:
    """Whether a cell speaks of samples."""
    return F.contains(F.lower(c), F.lit("sample"))


def is_value(c: Column) -> Column:
    """Not blank and without ASCII letters."""
    return filled(c) & ~c.rlike("[A-Za-z]")


def header_type(c: Column) -> Column:
    """The output column that a header stands for, or the empty string. Null is untyped."""
    low = F.lower(c)
    kind = None
    for name, words in BY_WORD:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    head = F.when(F.contains(c, F.lit("(")), F.substring_index(c, "(", 1)).otherwise(F.substring_index(c, "[", 1))
    bare = strip(F.lower(F.regexp_replace(head, NO_BACKSLASH, "")))
    for element in ("Sm", "Nd"):
        kind = kind.when(bare.isin(element.lower(), f"{element.lower()} ppm"), element)
    for name, pattern in BY_PATTERN:
        hit = c.rlike(pattern)
        kind = kind.when(hit & ~F.contains(low, F.lit("sr")) if name == SIGMA else hit, name)
    return F.coalesce(kind, F.lit(""))


def split_uncertainty(ratio: Column, sigma: Column) -> tuple[Column, Column]:
    """The ratio and its uncertainty: 'a±b' and 'a(b)' are taken apart, and then replace sigma."""
    parts = F.split(ratio, "±")
    left, right = F.instr(ratio, "("), F.instr(ratio, ")")
    paired = (left > 0) & (right > left)
    inside = F.substring(ratio, left + 1, right - left - 1)
    by_sign = F.contains(ratio, F.lit("±"))
    return (
        F.when(by_sign, parts[0]).when(paired, F.substring_index(ratio, "(", 1)).otherwise(ratio),
        F.when(by_sign, parts[1]).when(paired, inside).otherwise(sigma),
    )


def sigma_digits(c: Column) -> Column:
    """Significant digits of a decimal uncertainty: neither dots nor leading zeros. Others stay."""
    return F.when(F.contains(c, F.lit(".")), F.regexp_replace(F.regexp_replace(c, r"\.", ""), "^0+", "")).otherwise(c)


def settled(ratio: Column, sigma: Column) -> tuple[Column, Column]:
    """Uncertainty split, digits taken, both stripped."""
    a, b = split_uncertainty(ratio, sigma)
    return strip(a), strip(sigma_digits(b))
