"""Column helpers for operators made of DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java pattern of the white space that separates words.
GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), then).getItem(0)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")
