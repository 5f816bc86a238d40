"""Connected components of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """One row (node, root) per node of ``links`` (a, b); a root is its component's smallest node.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest chain. The
    edges never leave Spark: only a row count and a checksum per round reach the driver. Minima are
    combined before the shuffle, so a node with very many links is no crowded group.
    """
    edges = stored(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    state = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "links")
        before, state = state, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "components")
