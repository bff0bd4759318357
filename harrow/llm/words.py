"""What a word is, in native expressions and in Python, for the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[ \t\n\x0B\f\r]+"
WORD = re.compile("[^\\x20\\x09-\\x0d]+")


def words(text: Column) -> Column:
    """array<string> of the maximal runs of characters that aren't ASCII white space; null: empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS)
    return F.filter(parts, lambda w: w != F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
