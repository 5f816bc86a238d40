"""Top-k and pages. A page is sorted by a total order, so that pages do not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows; each task keeps only its own ``n`` (no full sort)."""
    return df.orderBy(*order).limit(n)


def total_of(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def page_after(df: DataFrame, keys: dict[str, bool], last: dict[str, object] | None, limit: int) -> DataFrame:
    """The ``limit`` rows that follow the row with the keys ``last`` (the first ones without it).

    ``keys`` maps the columns of a total order to whether they descend. Each task keeps only ``limit``
    rows, however deep the page is; an offset would make it keep all rows before the page too. NULLs come
    first in ascending and last in descending keys.
    """
    if limit < 1:
        raise ValueError(f"invalid page: limit={limit} (>= 1)")
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in keys.items()]
    if last is None:
        return df.orderBy(*order).limit(limit)
    beyond, same = F.lit(False), F.lit(True)
    for c, down in keys.items():
        here, at = F.col(c), F.lit(last[c])
        if last[c] is None:
            further = F.lit(False) if down else here.isNotNull()
        else:
            further = (here < at) | here.isNull() if down else here > at
        beyond, same = beyond | (same & F.coalesce(further, F.lit(False))), same & here.eqNullSafe(at)
    return df.filter(beyond).orderBy(*order).limit(limit)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, max_limit: int | None = None) -> DataFrame:
    """One page of ``df`` with the overall row count as column ``total``.

    The count is a scalar subquery, not a window over all rows.
    """
    if limit < 1 or offset < 0 or (max_limit is not None and limit > max_limit):
        raise ValueError(f"invalid page: limit={limit} (1..{max_limit}), offset={offset} (>= 0)")
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn("total", total_of(df).scalar())
