"""Text and number functions with the semantics the audit operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\n\r\f\x0B]+"
#: Words of the language that say nothing about evidence.
NOISE = ("const", "let", "var", "await", "async", "function", "return", "new", "true", "false")
SEVERITIES = ("critical", "high", "medium", "low")


def flat(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalized(text: Column) -> Column:
    return F.lower(flat(text))


def tokens(text: Column) -> Column:
    """Identifiers of three characters or more that are no noise words; repeats stay, case counts."""
    found = F.regexp_extract_all(text, F.lit("[a-zA-Z_][a-zA-Z0-9_]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*NOISE))


def hit_ratio(words: Column, text: Column) -> Column:
    """The share of words that text contains, in lower case; 0 without words."""
    hits = F.size(F.filter(words, lambda t: F.contains(text, F.lower(t))))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Word sets' Jaccard similarity; 0 if either has no word."""
    x, y = (F.array_distinct(F.filter(F.split(normalized(t), " "), lambda w: w != "")) for t in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def bucket(line: Column, width: int) -> Column:
    """Floor division: negative lines go down, not towards zero. A missing line counts as 0."""
    return F.floor(F.coalesce(line, F.lit(0)) / width).cast("int")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).when(severity == "low", 3).otherwise(4)


def category(item: Column) -> Column:
    """The capital letters an item starts with, else 'none'."""
    letters = F.regexp_extract(F.coalesce(item, F.lit("")), "^([A-Z]+)", 1)
    return F.when(letters == "", "none").otherwise(letters)


def as_int(value: Column, default: int | None = None) -> Column:
    """Lenient integer: what is no whole number becomes the default."""
    return F.coalesce(value.try_cast("int"), F.lit(default).cast("int"))


def numbered(lines: Column, first: Column) -> Column:
    """Lines with right-aligned numbers, joined."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.format_string("%4d | ", first + i), x)), "\n")
