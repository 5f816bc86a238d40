"""Keeping joins and windows even when one key holds a large part of the rows.

Joins: ``measured`` marks a derived table for broadcast only after counting it, and leaves a
larger one to a shuffle join, where adaptive execution splits skewed partitions.

Windows: adaptive execution cannot split a window partition, so ``HotKeys`` and
``place_in_blocks`` cut the timeline of a crowded key into blocks of bounded size, even within a day. Each
block also receives the rows just before it, so a frame that looks back a fixed number of rows gives
exactly the result of the uncut window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlake.session import cut_lineage

HOT_ROWS = 1_000_000
"""A key below this many rows is never worth splitting."""

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table is within the broadcast bound, by rows and by bytes of text."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    fixed = F.lit(16 * len(df.columns))
    width = reduce(add, sizes, fixed).cast("long")
    rows, used = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= max_rows and (used or 0) <= max_bytes


def measured(derived: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a derived table (an aggregate, a lookup) once, and mark it for broadcast if it fits.

    A join with the result leaves the other side unshuffled when the table is within the bound.
    Beyond it both sides are shuffled on the key.
    """
    derived = cut_lineage(derived)
    return F.broadcast(derived) if fits_broadcast(derived, max_rows) else derived


@dataclass(frozen=True)
class HotKeys:
    """Keys with more rows than one task should hold.

    ``keys`` has at most one row per shuffle partition: a key is hot only when it exceeds an
    even share of the rows. So it may always be broadcast. ``rows`` is their number of rows.
    """

    rows_per_block: int
    keys: DataFrame
    rows: int

    @staticmethod
    def find(df: DataFrame, on: list[str], floor_rows: int = HOT_ROWS) -> HotKeys | None:
        """Find hot keys by a map-side combined count; None when there are none."""
        total = df.count()
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        limit = max(floor_rows, -(-total // partitions))
        if total <= limit:
            return None
        crowded = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
        crowded = cut_lineage(crowded)
        rows = crowded.agg(F.sum("_rows")).first()[0]
        return HotKeys(limit, crowded.select(*on), rows) if rows else None


def _same(on: list[str], prefix: str) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in on])


def _renamed(df: DataFrame, on: list[str], prefix: str, *columns: str | Column) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in on], *columns)


def place_in_blocks(df: DataFrame, on: list[str], order: list[str], before: int, hot: HotKeys) -> DataFrame:
    """Copy ``df`` with each row of a hot key assigned to a block of its timeline.

    Added columns: ``_block``; ``_halo`` (true on the copies that only give context to a later
    block); ``_offset`` (rows of the key before the first row of the block, context included);
    ``_total`` (rows of the key). Rows of other keys get NULL, false, 0 and NULL.

    Rows of hot keys are dealt out by ranges of key and ``order``, which should be total: Spark samples the
    bounds, so that each range has its share of rows, be they of one day or without a date. They are
    stored, which fixes the ranges. Counts per key and range give each block's place on the timeline by
    prefix sums; those tables have one row per hot key and range. The last ``before`` rows of each
    range go to the blocks after it that look back so far.
    """
    keys = F.broadcast(_renamed(hot.keys, on, "_hot_"))
    blocks = -(-hot.rows // hot.rows_per_block)
    ranged = df.join(keys, _same(on, "_hot_"), "left_semi").repartitionByRange(blocks, *on, *order)
    ranged = cut_lineage(ranged.withColumn("_block", F.spark_partition_id().cast("bigint")))

    line = Window.partitionBy(*on).orderBy("_block")
    counts = ranged.groupBy(*on, "_block").agg(F.count(F.lit(1)).alias("_n"))
    until = F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(*on, "_block", "_n", until.alias("_until"), F.sum("_n").over(Window.partitionBy(*on)).alias("_total"))
    start = F.col("_until") - F.col("_n")
    # every range has a row, so those that may need this one as context are among the next few
    later = F.collect_list(F.struct(start.alias("start"), F.col("_block").alias("block"))).over(line.rowsBetween(1, before))
    counts = measured(counts.select(*on, "_block", "_until", "_total", F.greatest(start - before, F.lit(0)).alias("_before"), later.alias("_later")))

    own = ranged.join(_renamed(counts, on, "_at_", F.col("_block").alias("_at"), F.col("_before").alias("_offset"), "_total"), _same(on, "_at_") & (F.col("_block") == F.col("_at")))
    own = own.select(*df.columns, "_block", F.lit(False).alias("_halo"), "_offset", "_total")

    last = Window.partitionBy(*on, "_block").orderBy(*[F.col(c).desc() for c in order])
    tail = ranged.withColumn("_back", F.row_number().over(last)).filter(F.col("_back") <= before)
    tail = tail.join(_renamed(counts, on, "_at_", F.col("_block").alias("_at"), "_until", "_later"), _same(on, "_at_") & (F.col("_block") == F.col("_at")))
    needed_by = F.filter("_later", lambda x: x["start"] - F.col("_until") + F.col("_back") <= before)
    halo = tail.select(*df.columns, F.explode(needed_by).alias("_to"))
    places = _renamed(counts, on, "_at_", F.col("_block").alias("_at"), F.col("_before").alias("_offset"), "_total")
    halo = halo.join(places, _same(on, "_at_") & (F.col("_to.block") == F.col("_at")))
    halo = halo.select(*df.columns, F.col("_to.block").alias("_block"), F.lit(True).alias("_halo"), "_offset", "_total")

    nothing = F.lit(None).cast("bigint")
    rest = df.join(keys, _same(on, "_hot_"), "left_anti").select(
        *df.columns, nothing.alias("_block"), F.lit(False).alias("_halo"), F.lit(0).cast("bigint").alias("_offset"), nothing.alias("_total")
    )
    return own.unionByName(halo).unionByName(rest)
