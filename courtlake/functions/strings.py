"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_name(first: Column, second: Column) -> Column:
    """``first second`` where a NULL part counts as empty text."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(second, F.lit("")))


def strict_name(first: Column, second: Column) -> Column:
    """``first second``; NULL when either part is NULL."""
    return F.concat(first, F.lit(" "), second)


def contains_ignoring_case(c: Column, needle: str, wildcards: bool = False) -> Column:
    """Case-insensitive substring test.

    With ``wildcards=True`` the characters ``%`` and ``_`` keep their LIKE meaning;
    by default they are matched as themselves.
    """
    if not wildcards:
        for special in ("\\", "%", "_"):
            needle = needle.replace(special, "\\" + special)
    return c.ilike(f"%{needle}%")
