"""Operators on logical keys: latest row, lookup, load of absent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake.operators.skew import fits_broadcast
from courtlake.operators.windows import top_per_key
from courtlake.session import cut_lineage


def latest_per_key(df: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (which should be total)."""
    return top_per_key(df, on, order, 1)


def build_lookup(df: DataFrame, on: list[str], value: str, sequence: Column) -> DataFrame:
    """Key to value; on a repeated key the entry with the highest ``sequence`` wins."""
    return df.groupBy(*on).agg(F.max_by(value, sequence).alias(value))


def lookup_join(df: DataFrame, lookup: DataFrame, on: dict[str, str], value: str, name: str) -> DataFrame:
    """Replace key columns of ``df`` by the looked-up value; rows without a match are dropped.

    ``on`` maps columns of ``df`` to those of ``lookup``, which the caller should have measured.
    """
    renamed = lookup.select(*[F.col(theirs).alias(ours) for ours, theirs in on.items()], F.col(value).alias(name))
    return df.join(renamed, list(on)).drop(*on)


def insert_if_absent(batch: DataFrame, existing: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """The rows of ``batch`` to append: one per key, and only keys not in ``existing``.

    Copies of a key within the batch are reduced first, by ``order``, before any shuffle by key.
    Rows with a NULL in the key cannot be identified again and are left out. A small batch is
    broadcast to find its keys in ``existing`` without shuffling that table.
    """
    usable = batch.dropna(subset=on)
    fresh = cut_lineage(latest_per_key(usable, on, order))
    known = existing.select(*on).distinct()  # a repeated key must not crowd one task of the join
    wanted = fresh.select(*on)
    if fits_broadcast(wanted):
        known = known.join(F.broadcast(wanted), on, "left_semi")
    return fresh.join(known, on, "left_anti")
