"""Benchmark decontamination by winnowed fingerprints that are extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtlake.llm.common import stored
from courtlake.llm.token_memo import small_batches
from courtlake.llm.words import WordHashes, alnum_words, gram_hashes, mixed

WINDOW = 10  # words of a window
GRAM = 5  # words of a fingerprinted gram
BLOOM_BITS = 26  # the filter of benchmark fingerprints takes 2**26 bits (8 MB) at any size

HIT = "array<struct<start:int,length:int,print:bigint,window:binary>>"


def winnowed(words: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` words, its minimum gram hash: the window's fingerprint.

    It depends on the window's words alone, so a text that repeats the window anywhere has the same
    fingerprint there: every shared span of ``length`` words is found.
    """
    k = min(GRAM, length)
    grams = gram_hashes(words, k)
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, length - k + 1):
        np.minimum(least, grams[j : j + n], out=least)
    return mixed(least + np.uint64(length))


def _hits(words: list[bytes], prints: np.ndarray, at: np.ndarray, length: int) -> list[dict]:
    return [
        {"start": int(i), "length": length, "print": int(prints[i].astype(np.int64)), "window": xxhash.xxh3_128_digest(b" ".join(words[i : i + length]))}
        for i in at
    ]


def _benchmark_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, hits): every window of an item, or the whole item if it is shorter."""
    memo = WordHashes()
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            words = alnum_words(text)
            length = min(WINDOW, len(words))
            prints = winnowed(memo.of(words), length) if length else ()
            out.append(_hits(words, prints, np.arange(len(prints)), length))
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(out, HIT_ARROW)], ["item", "hits"])


HIT_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("print", pa.int64()), ("window", pa.binary())]))


def _document_hits(bits, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kept, digest, text) to (kept, digest, n_words, hits): windows whose fingerprint the filter knows."""
        memo, filter_bits = WordHashes(), np.frombuffer(bits.value, np.uint64)
        for batch in small_batches(batches):
            n_words, out = [], []
            for text in batch.column("text").to_pylist():
                words = alnum_words(text)
                hashes, found = memo.of(words), []
                for length in lengths:
                    prints = winnowed(hashes, length)
                    slot = prints >> np.uint64(64 - BLOOM_BITS)
                    known = (filter_bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
                    found += _hits(words, prints, np.flatnonzero(known), length)
                n_words.append(len(words))
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), batch.column("digest"), pa.array(n_words, pa.int64()), pa.array(out, HIT_ARROW)], ["kept", "digest", "n_words", "hits"])

    return run


def _filter(windows: DataFrame) -> bytes:
    """The benchmark's fingerprints as a bit set of fixed size; its set words come to the driver, 2**20 rows at most."""
    slot = F.shiftrightunsigned("print", 64 - BLOOM_BITS)
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = windows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return bits.tobytes()


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What ``contamination`` and ``without_contaminated`` share.

    First frame: a row per document with kept, digest (of its text), n_words. Second: a row per distinct
    text with a hit: h_digest, n_hit, n_items, items_sha256.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    windows = items.mapInArrow(_benchmark_windows, f"item string, hits {HIT}").select("item", F.explode("hits").alias("hit"))
    windows = stored(windows.select("item", "hit.length", "hit.print", "hit.window").distinct(), "benchmark-windows")
    lengths = sorted(row.length for row in windows.select("length").distinct().collect())  # 1 to WINDOW
    bits = spark.sparkContext.broadcast(_filter(windows))

    whole = F.coalesce(F.col(text), F.lit(""))
    kept = F.struct(*keep) if keep else F.lit(0)
    rows = documents.select(kept.alias("kept"), F.sha2(whole, 256).alias("digest"), whole.alias("text"))
    kept_type = rows.schema["kept"].dataType.simpleString()
    rows = stored(rows.mapInArrow(_document_hits(bits, lengths), f"kept {kept_type}, digest string, n_words bigint, hits {HIT}"), "document-hits")

    hits = rows.where(F.size("hits") > 0).select("digest", F.explode("hits").alias("hit")).select("digest", "hit.*").distinct()
    known = windows.select("length", "print", "window").distinct()
    sure = hits.join(known, ["length", "print", "window"], "left_semi")
    order = Window.partitionBy("digest").orderBy("start", "length")
    seen = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", F.coalesce(seen, F.lit(0))))
    covered = sure.select("digest", fresh.alias("fresh")).groupBy("digest").agg(F.sum("fresh").cast("long").alias("n_hit"))

    pairs = hits.join(windows, ["length", "print", "window"]).select("digest", "item").dropna().distinct()
    listed = F.array_sort(F.collect_list("item"))
    named = pairs.groupBy("digest").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"))
    found = stored(covered.join(named, "digest", "left").withColumnRenamed("digest", "h_digest"), "found")
    return rows.drop("hits"), found


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: ``key``, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters or digits and non-ASCII characters, A-Z lowered. A window is ten
    consecutive words of an item; an item of one to nine words is one window. A document word inside
    any occurrence of a window is hit.

    Winnowing: each window of a text keeps the minimum of its 5-gram hashes. The benchmark's minima make
    a bit filter of fixed size, which is broadcast; document windows whose minimum it knows are joined
    with the benchmark on the minimum and extended to the whole window (128-bit digest of its words).
    Texts are joined as digests, so copies of a text count once before the shuffle.

    Null and empty texts have no words and no hits. Null item ids hit but are not listed. Repeated rows
    give repeated results. With no hit, items_sha256 is the digest of an empty list. An empty benchmark
    hits nothing, an empty table gives no rows. A text of any length is read whole, by one task. Only the
    columns named are read; others, of whatever name, do not matter.
    """
    rows, found = benchmark_hits(documents, benchmark, [key], text, item, item_text)
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(found, F.col("digest") == F.col("h_digest"), "left").select(
        F.col(f"kept.{key}").alias(key), "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns, whose text has no hit.

    Null and empty texts stay, repeated rows stay or go together, an empty benchmark lets all stay.
    Columns may have any names, as rows travel in a struct.
    """
    _, found = benchmark_hits(documents, benchmark, [], text, item, item_text)
    # whole rows travel as one struct, so that no column of theirs can clash with an inner one
    rows = documents.select(F.struct("*").alias("row"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    return rows.join(found.select("h_digest"), F.col("digest") == F.col("h_digest"), "left_anti").select("row.*")
