"""Substring search through a table of n-grams: candidates by an equi join, then the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake.functions.strings import contains_ignoring_case
from courtlake.session import scratch_folder

LENGTHS = (2, 3)  # grams indexed: pairs serve queries of two characters, triples all longer ones


def _grams(text: Column, length: int) -> Column:
    """Distinct runs of ``length`` characters; none in a shorter text."""
    starts = F.sequence(F.lit(1), F.char_length(text) - (length - 1))
    runs = F.transform(starts, lambda i: F.substring(text, i, F.lit(length)))
    return F.when(F.char_length(text) >= length, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(gram, key): once per gram and row, whatever its case."""
    lowered = rows.select(F.col(key), F.lower(F.col(text)).alias("_text")).where(F.col("_text").isNotNull())
    return lowered.select(F.explode(F.concat(*[_grams(F.col("_text"), n) for n in LENGTHS])).alias("gram"), key)


def stored_postings(rows: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """The postings as Parquet in ranges of grams: a search opens only the row groups that its grams fall in.

    Ranges are by gram and key, so a gram that very many rows hold lies in several files.
    """
    path = path or scratch_folder(rows.sparkSession, "grams")
    found = postings(rows, key, text)
    found.repartitionByRange("gram", key).sortWithinPartitions("gram", key).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(found.schema).parquet(path)


def query_grams(query: str) -> list[str]:
    """The grams that a text must hold to contain ``query``: its triples, or the pair that it is."""
    lowered = query.lower()
    length = min(max(LENGTHS), len(lowered))
    return sorted({lowered[i : i + length] for i in range(len(lowered) - length + 1)})


def candidates(index: DataFrame, key: str, query: str) -> DataFrame:
    """The keys of rows that hold every gram of ``query``; counts are combined before the shuffle."""
    grams = query_grams(query)
    hits = index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("_n"))
    return hits.where(F.col("_n") >= len(grams)).select(key)


def containing(rows: DataFrame, index: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """The rows whose ``text`` contains ``query``, ignoring case, by way of the index.

    ``key`` identifies a row. The join leaves candidates only; the exact test on them decides, since grams
    may lie apart.
    """
    if len(query) < min(LENGTHS):
        raise ValueError(f"a search needs at least {min(LENGTHS)} characters")
    return rows.join(candidates(index, key, query), key, "left_semi").where(contains_ignoring_case(F.col(text), query))
