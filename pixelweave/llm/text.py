"""Column expressions on whole texts, shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: space and U+0009..U+000D.
BLANK = "[\\x20\\x09-\\x0D]+"


def whole(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def spaced(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def word_chars(line: Column) -> Column:
    """Code points in the words of a text already ``spaced``."""
    return F.length(F.replace(line, F.lit(" "), F.lit(""))).cast("long")


def word_count(line: Column, chars: Column) -> Column:
    """Words of a text already ``spaced``, given their code points."""
    return F.when(line == "", F.lit(0)).otherwise(F.length(line) - chars + 1).cast("long")
