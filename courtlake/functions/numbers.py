"""Guarded arithmetic. Under ANSI mode a bare division by zero fails the job."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """``part / whole``, and 0 unless ``whole`` is positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def ratio_or_null(part: Column, whole: Column) -> Column:
    """``part / whole``, and NULL when ``whole`` is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def ratio_of_sums(part: str, whole: str) -> Column:
    """Aggregate: sum of one column over sum of another, NULL when nothing was attempted."""
    return ratio_or_null(F.sum(part), F.sum(whole))


def weighted_sum(terms: list[tuple[Column, float]]) -> Column:
    """Sum of ``column * weight``; NULL when any term is NULL."""
    return reduce(add, (c * F.lit(float(weight)) for c, weight in terms))


def standard_score(value: Column, mean: Column, deviation: Column) -> Column:
    """z-score; 0 where the deviation is 0 or unknown."""
    score = F.when(deviation == 0, F.lit(0.0)).otherwise((value - mean) / F.nullif(deviation, F.lit(0.0)))
    return F.coalesce(score, F.lit(0.0))
