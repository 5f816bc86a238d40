"""Token counts through a cache keyed by digests of the content and of the tokenizer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.llm.common import shared_folder, stored
from courtlake.llm.token_memo import PieceCounts, in_worker, slices

CHARS = 2_000_000  # characters that a task encodes at a time
CACHE_SCHEMA = "content string, tokenizer string, n_tokens bigint"


def _counter(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = in_worker(PieceCounts, model.value)
        for batch in batches:
            texts, out = batch.column("text"), []
            lengths = pa.compute.binary_length(texts).to_pylist()
            for a, b in slices(lengths, CHARS):
                out += counts.count(texts.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(out, pa.int64())], ["content", "n_tokens"])

    return run


def token_counts(documents: DataFrame, model_path: str, cache: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: ``key``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``model_path`` is a sentencepiece model on the driver; its bytes go to the tasks. Counts are without
    begin, end or other added tokens, and without truncation.

    ``cache`` is a Parquet folder of counts by content digest (SHA-256 of the normalised text: null
    becomes empty, all else stays, as any other change could alter the count) and tokenizer digest
    (SHA-256 of the library's version and the model). Distinct contents without a count for this
    tokenizer are encoded and appended; all others take the stored count. Without ``cache`` a new
    folder is used. Two jobs may append the same content; the reader takes one of the equal counts.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results. An empty table gives
    no rows. A text of any length is counted whole, in one task. Only ``key`` and ``text`` are read; other
    columns, of whatever name, do not matter.
    """
    spark = documents.sparkSession
    cache = cache or shared_folder(spark, "token-counts")
    model = Path(model_path).read_bytes()
    tokenizer = hashlib.sha256(b"sentencepiece " + version("sentencepiece").encode() + b" " + model).hexdigest()
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)  # makes a new folder readable

    def known() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer)
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    content = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key).alias("k"), content.alias("text"), F.sha2(content, 256).alias("content"))
    # equal digests have equal texts; the partial aggregate keeps one copy per task before the shuffle
    missing = rows.groupBy("content").agg(F.max("text").alias("text")).join(known(), "content", "left_anti")
    encoded = missing.select("content", "text").mapInArrow(_counter(spark.sparkContext.broadcast(model)), "content string, n_tokens bigint")
    encoded.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    n_tokens = F.col("n_tokens")
    counts = stored(known(), "known-counts")  # a plain table: adaptive execution can split a hot content of the join
    return rows.select("k", "content", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "content", "left").select(
        F.col("k").alias(key), "n_bytes", n_tokens, (n_tokens > limit).alias("over_limit")
    )
