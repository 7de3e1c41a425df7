"""Building blocks for text rewriting as columns.

Patterns are Java's. (?U) gives word, digit and space classes their Unicode meaning and (?d)
makes line feed the only line end, which is what the fixed patterns expect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def weave(gaps: Column, middles: Column) -> Column:
    """gap, middle, gap, ... as one string; gaps has one element more."""
    return F.array_join(F.zip_with(gaps, middles, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def rewrite(text: Column, pattern: str, rule: Callable[..., Column]) -> Column:
    """Every match replaced by rule(match) or rule(match, index): a callback without a UDF."""
    return weave(F.split(text, pattern, -1), F.transform(matches(text, pattern), rule))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key_of(text: Column) -> Column:
    """Lower-case letters a-z and digits only, for forgiving comparisons."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def yaml_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def escaped(text: Column) -> Column:
    """A backslash before characters that Markdown reads as markup."""
    return F.regexp_replace(text, r"([\\`*_\[\]])", r"\\$1")
