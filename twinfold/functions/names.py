"""File-name functions: normalisation, edit-distance ratio, copy markers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The three patterns of name normalisation, in order of use.
TRAILING_COUNTER = r"(?iUd)[\(\[\{]?\s*(copy|\d+)\s*[\)\]\}]?$"
NOISE_WORDS = r"(?iU)\b(copy|copie|kopie|kopya|duplicate|final|new|edit|edited)\b"
NON_ALPHANUMERIC = r"[^\p{L}\p{Nd}]+"
#: Characters beyond the basic plane count as separators.
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
#: All Unicode white space at either end; the built-in trim strips U+0020 only.
OUTER_SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, OUTER_SPACE, "")


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def normalize(name: Column) -> Column:
    """What is left of a name without one trailing counter, noise words and separators."""
    low = strip(F.lower(F.regexp_replace(name, ASTRAL, " ")))
    bare = F.regexp_replace(F.regexp_replace(low, TRAILING_COUNTER, ""), NOISE_WORDS, "")
    return strip(F.regexp_replace(bare, NON_ALPHANUMERIC, " "))


def ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty names are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def copy_marker_score(name: Column) -> Column:
    """How much a name looks like a copy's: 2 for a word for copy, 1 for a bracketed number, 1 for a dash."""
    low = F.lower(name)
    word = F.contains(low, F.lit("copy")) | F.contains(low, F.lit("copie")) | F.contains(low, F.lit("kopya"))
    return word.cast("int") * 2 + low.rlike(r"\(\d+\)").cast("int") + F.contains(low, F.lit(" - ")).cast("int")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def directory_name(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case, with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
