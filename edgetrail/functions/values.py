"""Absent-value handling and number parsing shared by the other functions.

Log records mark an absent value in three ways: the key is missing, the value is
``"-"`` or the value is ``""``.  Two fallback chains treat these differently:

* ``present``: the first chain member whose key exists wins, even if it is empty;
* ``truthy``: empty text is skipped, but ``"-"`` is a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(*cols: Column) -> Column:
    return F.coalesce(*cols)


def filled(col: Column) -> Column:
    """NULL for empty text.

    Written as a condition: ``nullif`` would put a projection of its own into the plan.
    """
    return F.when(col != "", col)


def truthy(*cols: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cols])


def known(col: Column) -> Column:
    """NULL unless the text carries a value, i.e. is neither missing, ``""`` nor ``"-"``."""
    return F.when(~col.isin("", "-"), col)


def is_known(col: Column) -> Column:
    return F.coalesce(~col.isin("", "-"), F.lit(False))


def to_long(col: Column) -> Column:
    """Whole number or 0; text with a fraction is not a whole number."""
    return F.coalesce(col.try_cast("bigint"), F.lit(0).cast("bigint"))


def to_double(col: Column) -> Column:
    """A number or 0; a type letter after the digits, as in ``5d``, is no part of a number."""
    return F.coalesce(F.when(~col.rlike(r"[0-9.][dDfF]\s*$"), col.try_cast("double")), F.lit(0.0))


def parse_flag(col: Column, fallback: bool = False) -> Column:
    """true / 1 / yes / on in any case; empty or missing text gives the fallback."""
    parsed = F.lower(F.trim(col)).isin("true", "1", "yes", "on")
    return F.when(filled(col).isNull(), F.lit(fallback)).otherwise(parsed)


def parse_positive_int(col: Column, fallback: int | None = None) -> Column:
    """Leading digits as a positive whole number (``"12px"`` is 12), else the fallback."""
    digits = F.regexp_extract(F.trim(col), r"^\+?([0-9]+)", 1)
    number = filled(digits).try_cast("bigint")
    return F.coalesce(F.when(number > 0, number), F.lit(fallback).cast("bigint"))
