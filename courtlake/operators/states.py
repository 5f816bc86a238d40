"""Aggregates as mergeable states: sums, counts and maxima per key, from which the results are finished.

``state`` reduces rows, ``merged`` reduces states, and both keep one row per key. So the state of all rows is
that of any split of them, merged in any order, and a day's rows can be added without the rows before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, LARGEST = "added", "largest"


@dataclass(frozen=True)
class Measure:
    """One result: what of each row goes into the state (expression, and how states combine), and how it is finished."""

    parts: dict[str, tuple[Column, str]]
    finish: Column


def number(name: str, condition: Column | None = None) -> Measure:
    """Rows, or rows that meet a condition."""
    one = F.lit(1) if condition is None else F.when(condition, 1).otherwise(0)
    return Measure({f"{name}__n": (one.cast("bigint"), ADDED)}, F.col(f"{name}__n").alias(name))


def total(name: str, value: Column) -> Measure:
    """Sum of the known values; NULL if none is known."""
    known = F.when(F.col(f"{name}__n") > 0, F.col(f"{name}__sum"))
    return Measure(_sum_and_count(name, value), known.alias(name))


def mean(name: str, value: Column) -> Measure:
    """Mean of the known values; NULL if none is known."""
    return Measure(_sum_and_count(name, value), (F.col(f"{name}__sum") / F.nullif(F.col(f"{name}__n"), F.lit(0))).alias(name))


def ratio(name: str, upper: Column, lower: Column, factor: float = 1.0) -> Measure:
    """Sum by sum, NULL where the lower one is 0 or no value is known."""
    parts = {f"{name}__upper": (F.coalesce(upper, F.lit(0)), ADDED), f"{name}__lower": (F.coalesce(lower, F.lit(0)), ADDED)}
    value = F.col(f"{name}__upper").cast("double") / F.nullif(F.col(f"{name}__lower").cast("double"), F.lit(0.0))
    return Measure(parts, (value * factor).alias(name))


def latest(name: str, value: Column) -> Measure:
    return Measure({f"{name}__max": (value, LARGEST)}, F.col(f"{name}__max").alias(name))


def _sum_and_count(name: str, value: Column) -> dict[str, tuple[Column, str]]:
    known = F.when(value.isNotNull(), 1).otherwise(0).cast("bigint")
    return {f"{name}__sum": (F.coalesce(value, F.lit(0)), ADDED), f"{name}__n": (known, ADDED)}


@dataclass(frozen=True)
class KeyedState:
    """A table of measures per key."""

    keys: dict[str, Column]
    measures: list[Measure]
    where: Callable[[DataFrame], DataFrame] = lambda rows: rows

    @property
    def _parts(self) -> dict[str, tuple[Column, str]]:
        return {name: part for m in self.measures for name, part in m.parts.items()}

    def state(self, rows: DataFrame) -> DataFrame:
        """One row per key, combined in each task before the shuffle."""
        shaped = self.where(rows).select(*[c.alias(k) for k, c in self.keys.items()], *[c.alias(p) for p, (c, _) in self._parts.items()])
        return self.merged(shaped)

    def merged(self, states: DataFrame) -> DataFrame:
        """States of the same keys as one."""
        how = {ADDED: F.sum, LARGEST: F.max}
        return states.groupBy(*self.keys).agg(*[how[kind](p).alias(p) for p, (_, kind) in self._parts.items()])

    def added(self, state: DataFrame, rows: DataFrame) -> DataFrame:
        """The state with further rows."""
        return self.merged(state.unionByName(self.state(rows)))

    def finished(self, state: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """The results; with fewer ``keys``, states are merged further first."""
        if keys is not None:
            state = KeyedState({k: F.col(k) for k in keys}, self.measures).merged(state)
        return state.select(*(keys or self.keys), *[m.finish for m in self.measures])
