"""Declarative data tests. Each returns failing values; the report counts them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows where ``column`` is missing."""
    return df.filter(F.col(column).isNull())


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number of rows. NULL is not a value."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_records"))
    return counted.filter(F.col("n_records") > 1)


def orphaned_values(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Values of ``column`` unknown to the parent, with their number of rows.

    Both sides are reduced to one row per value before the join, so a frequent value costs nothing.
    """
    values = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_records"))
    return values.join(parent.select(F.col(field).alias(column)).distinct(), column, "left_anti")


def split_required(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with all required values, and the others. No row is in both or in neither."""
    complete = reduce(and_, [F.col(c).isNotNull() for c in required])
    return df.filter(complete), df.filter(~complete)


@dataclass(frozen=True)
class Check:
    """One data test on a table."""

    name: str
    table: DataFrame
    kind: str  # not_null | unique | relationships
    column: str
    parent: DataFrame | None = None
    field: str | None = None

    def failures(self) -> DataFrame:
        """One row with column ``failures``."""
        if self.kind == "not_null":
            return self.table.agg(F.count_if(F.col(self.column).isNull()).alias("failures"))
        if self.kind == "unique":
            return repeated_values(self.table, self.column).agg(F.count(F.lit(1)).alias("failures"))
        if self.kind == "relationships":
            orphans = orphaned_values(self.table, self.column, self.parent, self.field)
            return orphans.agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("failures"))
        raise ValueError(f"unknown kind of check: {self.kind}")


def report(checks: list[Check]) -> DataFrame:
    """One row per check: name, failures, passed. The not-null checks of a table share one pass."""
    rows: list[DataFrame] = []
    by_table: dict[int, list[Check]] = {}
    for check in checks:
        if check.kind == "not_null":
            by_table.setdefault(id(check.table), []).append(check)
        else:
            rows.append(check.failures().select(F.lit(check.name).alias("check_name"), "failures"))
    for group in by_table.values():
        slots = {f"_c{n}": c for n, c in enumerate(group)}
        counts = group[0].table.agg(*[F.count_if(F.col(c.column).isNull()).alias(slot) for slot, c in slots.items()])
        pairs = [
            F.struct(F.lit(c.name).alias("check_name"), F.col(slot).alias("failures")) for slot, c in slots.items()
        ]
        rows.append(counts.select(F.inline(F.array(*pairs))))
    combined = reduce(DataFrame.unionByName, rows)
    return combined.withColumn("passed", F.col("failures") == 0)
