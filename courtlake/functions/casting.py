"""Typed reads of loosely typed text.

ANSI mode is on by default in Spark 4, so a plain cast of bad text fails the job.
Each helper states what bad text becomes instead.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that a CSV reader of the usual data-frame tools takes as missing.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Month/day/year, with or without a time of day, and dates with the month's name.
DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm a", "MMM d, yyyy", "MMM d, yyyy H:mm")

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def text(c: Column) -> Column:
    """Text with the usual missing markers turned into NULL."""
    return F.when(c.isin(*MISSING_TEXT), F.lit(None)).otherwise(c)


def number(c: Column) -> Column:
    """Text to double; NULL for anything that is not a plain number.

    The pattern keeps out what the JVM parser would take, such as ``1d`` or ``NaN``.
    """
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def number_or_zero(c: Column) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def whole(c: Column, to: str = "int") -> Column:
    """Text to an integer type by way of double, so ``'2003.0'`` gives 2003."""
    return number(c).try_cast(to)


def whole_or_zero(c: Column, to: str = "int") -> Column:
    return F.coalesce(whole(c, to), F.lit(0).cast(to))


def identifier(c: Column) -> Column:
    """Text to long without passing through double when it is written as an integer."""
    return F.coalesce(c.try_cast("bigint"), whole(c, "bigint"))


def flag(c: Column, missing: bool | None = None) -> Column:
    """Number or text to boolean; ``missing`` is the value for absent input."""
    parsed = F.coalesce(number(c) != 0, F.trim(c).try_cast("boolean"))
    return F.coalesce(parsed, F.lit(missing).cast("boolean"))


def may_fit(c: Column, form: str) -> Column:
    """Whether a text has the separators of a date format, and no others."""
    return reduce(and_, (c.contains(mark) == F.lit(mark in form) for mark in "/,:"))


def timestamp(c: Column) -> Column:
    """ISO text (``T`` or blank between date and time) or one of ``DATE_FORMATS`` to a zoneless timestamp.

    NULL for other text; a load counts and sets aside the rows that need the date. Each failed trial raises an error
    inside, far dearer than a date that is read, so only forms that a text may have are tried: none that starts with
    a letter or with month and slash is ISO.
    """
    trimmed = F.trim(c)
    other = F.locate("/", trimmed).between(2, 3) | F.substring(trimmed, 1, 1).between("A", "z")
    iso = F.when(~other, trimmed.try_cast("timestamp_ntz"))
    others = [
        F.when(may_fit(trimmed, f), F.try_to_timestamp(trimmed, F.lit(f)).cast("timestamp_ntz")) for f in DATE_FORMATS
    ]
    return F.coalesce(iso, *others)
