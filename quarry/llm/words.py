"""Words, as all operators here take them: runs of characters other than ASCII white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for each row.

    Binding it as a lambda variable keeps Catalyst from copying a costly
    expression to each of its uses when projections and filters are merged.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_words(text: bytes) -> list[bytes]:
    """The words of UTF-8 bytes with A-Z in lower case, for Python workers.

    bytes.lower() changes A-Z only, and bytes.split() parts at the same six
    white-space bytes.
    """
    return text.lower().split()
