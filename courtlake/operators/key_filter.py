"""Which seasons may hold a key: Bloom filters per season, as rows that are merged by OR.

A filter is a number of blocks of 8 words of 64 bits; a key sets one bit in each word of one block. Rows
(season, blocks, block, words, n) of one filter may lie in any number of pieces: appending adds rows, reading
combines them. With 32 bits to a key a foreign key passes about 6 times in a million.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake.operators.skew import fits_broadcast
from courtlake.schemas import SEASON, Schema
from courtlake.session import cut_lineage

WORDS = 8
KEYS_PER_BLOCK = 16
LEAST_BLOCKS = 64

FILTER: Schema = {SEASON: "int", "blocks": "bigint", "block": "bigint", **{f"w{i}": "bigint" for i in range(WORDS)}, "n": "bigint"}
_WORDS = [f"w{i}" for i in range(WORDS)]


def _bits(on: list[str]) -> Column:
    return F.xxhash64(F.lit("bits"), *on)


def _masks(bits: Column) -> list[Column]:
    shifted = [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), s) for s in shifted]


def _block(on: list[str], blocks: Column) -> Column:
    return F.pmod(F.xxhash64(*on), blocks)


def block_count(keys: int) -> int:
    """Blocks for so many keys and as many again, a power of two."""
    return max(LEAST_BLOCKS, 1 << (2 * max(1, keys) // KEYS_PER_BLOCK).bit_length())


def filter_rows(keys: DataFrame, on: list[str], blocks: dict[int, int]) -> DataFrame:
    """Filter rows for ``keys`` (``on`` and the season); ``blocks`` has the number of blocks per season.

    Combined before the shuffle: a block has one row, however many keys or copies it holds.
    """
    size = F.element_at(F.create_map(*[F.lit(x) for season, n in blocks.items() for x in (season, n)]), F.col(SEASON)).cast("bigint")
    marked = keys.select(F.col(SEASON).cast("int").alias(SEASON), size.alias("blocks"), _block(on, size).alias("block"), *[m.alias(w) for m, w in zip(_masks(_bits(on)), _WORDS, strict=True)])
    return marked.groupBy(SEASON, "blocks", "block").agg(*[F.bit_or(w).alias(w) for w in _WORDS], F.count("*").alias("n"))


def season_sizes(keys: DataFrame) -> dict[int, int]:
    """Rows per season; as many numbers as there are seasons."""
    return {r[SEASON]: r["n"] for r in keys.groupBy(F.col(SEASON).cast("int").alias(SEASON)).agg(F.count("*").alias("n")).collect()}


def built(keys: DataFrame, on: list[str]) -> DataFrame:
    """Filters of all seasons of ``keys``, each sized by its rows."""
    sizes = {season: block_count(n) for season, n in season_sizes(keys).items()}
    return filter_rows(keys, on, sizes) if sizes else keys.sparkSession.createDataFrame([], ", ".join(f"{c} {t}" for c, t in FILTER.items()))


def filter_sizes(filters: DataFrame) -> dict[int, tuple[int, int]]:
    """Per season the number of blocks, and of keys set so far."""
    rows = filters.groupBy(SEASON).agg(F.max("blocks").alias("blocks"), F.sum("n").alias("n")).collect()
    return {r[SEASON]: (r["blocks"], r["n"]) for r in rows}


def possible_seasons(keys: DataFrame, filters: DataFrame, on: list[str], known: dict[int, tuple[int, int]] | None = None) -> list[int]:
    """The seasons whose filter knows at least one of ``keys``; no season that holds one is missing.

    Only the blocks that the keys fall in are read beyond the join; a small batch is broadcast, once its probes
    are counted: there are several to a block. ``known`` may give the result of ``filter_sizes``.
    """
    known = filter_sizes(filters) if known is None else known
    sizes = sorted({blocks for blocks, _ in known.values()})  # powers of two: a few dozen at most
    if not sizes:
        return []
    distinct = cut_lineage(keys.select(*on).distinct())
    probes = distinct.withColumn("blocks", F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes])))
    probes = probes.select("blocks", _block(on, F.col("blocks")).alias("block"), _bits(on).alias("bits"))
    touched = probes.select("blocks", "block").distinct()
    if fits_broadcast(probes):  # it has a row at least for each block touched
        touched, probes = F.broadcast(touched), F.broadcast(probes)
    near = filters.join(touched, ["blocks", "block"], "left_semi").groupBy(SEASON, "blocks", "block").agg(*[F.bit_or(w).alias(w) for w in _WORDS])
    set_ = reduce(and_, [F.col(w).bitwiseAND(m) == m for w, m in zip(_WORDS, _masks(F.col("bits")), strict=True)])
    return sorted(r[SEASON] for r in near.join(probes, ["blocks", "block"]).where(set_).select(SEASON).distinct().collect())
