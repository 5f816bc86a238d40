"""Deep pages: rows stored in ranges of their order, so that a page opens the range it lies in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake.session import scratch_folder

ROWS_PER_RANGE = 100_000
MOST_RANGES = 512
"""Ranges are files, and the driver hears of each: beyond so many they hold more rows instead."""


@dataclass(frozen=True)
class PageIndex:
    """Rows by ranges of a total order with their place in the range, and how many rows lie before each range."""

    rows: DataFrame
    order: list[Column]
    starts: list[tuple[int, int, int]]  # range, rows before it, rows up to its end

    @staticmethod
    def build(df: DataFrame, order: list[Column], rows_per_range: int = ROWS_PER_RANGE, path: str | None = None) -> PageIndex:
        """One range shuffle and one write; ``order`` must be total. Bounds are sampled, counts are exact.

        One number per range comes to the driver, and there are ``MOST_RANGES`` at most: a larger table has more
        than ``rows_per_range`` rows in each. They are sorted and numbered, so that a page reads its rows alone.
        """
        ranges = min(MOST_RANGES, max(1, -(-df.count() // rows_per_range)))
        path = path or scratch_folder(df.sparkSession, "pages")
        sorted_rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its task
        placed = sorted_rows.withColumns({"_range": F.spark_partition_id(), "_place": place})
        placed.write.mode("overwrite").partitionBy("_range").parquet(path)
        rows = df.sparkSession.read.schema(placed.schema).parquet(path)
        starts, before = [], 0
        for r in sorted(rows.groupBy("_range").count().collect()):
            starts.append((r["_range"], before, before + r["count"]))
            before += r["count"]
        return PageIndex(rows, order, starts)

    @property
    def total(self) -> int:
        return self.starts[-1][2] if self.starts else 0

    def ranges_of(self, limit: int, offset: int) -> list[tuple[int, int, int]]:
        return [s for s in self.starts if s[1] < offset + limit and s[2] > offset]

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """``limit`` rows from ``offset`` on, with the overall count as ``total``.

        Only the files of the ranges that the page touches are opened, and only its own rows are sorted, however
        deep the page is.
        """
        if limit < 1 or offset < 0:
            raise ValueError(f"invalid page: limit={limit} (>= 1), offset={offset} (>= 0)")
        touched, of, place = self.ranges_of(limit, offset), F.col("_range"), F.col("_place")
        wanted = F.lit(False)
        if touched:
            first, last = touched[0], touched[-1]
            wanted = of.isin([s[0] for s in touched])
            wanted &= ((of != first[0]) | (place >= offset - first[1])) & ((of != last[0]) | (place < offset + limit - last[1]))
        some = self.rows.where(wanted).drop("_range", "_place")
        return some.orderBy(*self.order).limit(limit).withColumn("total", F.lit(self.total).cast("bigint"))
