"""Token ids in binary shards: one zstandard frame per document, one shared dictionary, an offset index.

A shard file holds, in this order:

- the magic ``CTKS0001`` and the SHA-256 of the dictionary (32 zero bytes without one),
- the frames: each document's ids as little-endian unsigned 32-bit integers, compressed by itself,
- the index: the number of documents, then per document its id (int64), whether it has one (uint8),
  the offset and length of its frame (uint64), and its number of ids (uint64), column by column,
- the offset of the index (uint64) and the magic again.

So one document is read with the end of the file, the index and a single frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtlake.llm.common import below_share, shared_folder, stored
from courtlake.llm.token_memo import ByteBpe, in_worker, slices

MAGIC = b"CTKS0001"
HEAD = len(MAGIC) + 32
TAIL = 8 + len(MAGIC)
SHARD_BYTES = 32 << 20  # a shard is closed once its frames exceed this
CHARS = 1_000_000  # characters that a task encodes at a time
LEVEL = 3
#: The dictionary is fitted on stretches of this many documents at most, of so many characters each.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 4096, 64 << 10

MANIFEST = "part int, seq int, path string, n_docs bigint, n_tokens bigint"


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes documents to numbered shard files of one task, each under its final name only when whole."""

    def __init__(self, folder: str, part: int, attempt: int, dictionary: bytes):
        self.folder, self.part, self.attempt, self.seq = folder, part, attempt, 0
        self.files, self.base = _open(folder)
        self.digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.out = None

    def add(self, doc_id: int | None, ids: bytes) -> tuple | None:
        if self.out is None:
            self.partial = f"{self.base}/.part-{self.part:06d}-{self.seq:05d}.{self.attempt}"
            self.out = self.files.open_output_stream(self.partial)
            self.out.write(MAGIC + self.digest)
            self.at, self.rows = HEAD, []
        frame = self.packer.compress(ids)
        self.out.write(frame)
        self.rows.append((doc_id or 0, doc_id is not None, self.at, len(frame), len(ids) // 4))
        self.at += len(frame)
        return self.close() if self.at >= SHARD_BYTES else None

    def close(self) -> tuple | None:
        """Finish the open shard, if any; its row of the manifest."""
        if self.out is None:
            return None
        ids, known, offsets, lengths, counts = zip(*self.rows, strict=True)
        index = [np.array([len(ids)], "<u8"), np.array(ids, "<i8"), np.array(known, "u1"), *(np.array(x, "<u8") for x in (offsets, lengths, counts))]
        self.out.write(b"".join(x.tobytes() for x in index) + np.array([self.at], "<u8").tobytes() + MAGIC)
        self.out.close()
        self.out = None
        name = f"part-{self.part:06d}-{self.seq:05d}.ctk"
        self.files.move(self.partial, f"{self.base}/{name}")
        self.seq += 1
        return self.part, self.seq - 1, f"{self.folder}/{name}", len(ids), sum(counts)


class Shard:
    """Random access to the documents of one shard file."""

    def __init__(self, uri: str, dictionary: bytes):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        head, tail = self.file.read_at(HEAD, 0), self.file.read_at(TAIL, size - TAIL)
        if head[: len(MAGIC)] != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        if head[len(MAGIC) :] != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError(f"{uri} was written with another dictionary")
        at = int(np.frombuffer(tail, "<u8", 1)[0])
        index = self.file.read_at(size - TAIL - at, at)
        n, place = int(np.frombuffer(index, "<u8", 1)[0]), 8
        columns = []
        for kind, width in (("<i8", 8), ("u1", 1), ("<u8", 8), ("<u8", 8), ("<u8", 8)):
            columns.append(np.frombuffer(index, kind, n, place))
            place += n * width
        self.doc_ids, self.known, self.offsets, self.lengths, self.counts = columns
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        frame = self.file.read_at(int(self.lengths[i]), int(self.offsets[i]))
        return np.frombuffer(self.unpacker.decompress(frame), "<u4")

    def find(self, doc_id: int) -> np.ndarray:
        """Positions of a document id; ids ascend, those without one are last."""
        n = int(self.known.sum())
        return np.arange(np.searchsorted(self.doc_ids[:n], doc_id), np.searchsorted(self.doc_ids[:n], doc_id, "right"))


def _end(end_id: int) -> bytes:
    return np.array([end_id], "<u4").tobytes()


def _sample_ids(definition: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = in_worker(ByteBpe, definition.value)
        for batch in batches:
            ids = encoder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return run


def train_dictionary(documents: DataFrame, definition: Broadcast, key: str, text: str) -> bytes:
    """A dictionary for the frames, from serialised id arrays of a bounded sample; empty if too few rows.

    The sample is the ``SAMPLE_DOCUMENTS`` rows of least md5 of key and text, a stretch of each from a
    place that depends on that md5. It only affects the size of the files.
    """
    length = F.length(text)
    start = F.floor(F.greatest(length - SAMPLE_CHARS, F.lit(0)) * (F.conv(F.substring("hash", 9, 6), 16, 10).cast("double") / float(16**6))).cast("int") + 1
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.md5(text)))
    rows = documents.select(F.col(text), digest.alias("hash")).where((length > 0) & below_share(F.col("hash"), SAMPLE_DOCUMENTS, documents.count()))
    rows = rows.select("hash", F.substr(F.col(text), start, F.lit(SAMPLE_CHARS)).alias("text")).orderBy("hash", "text").limit(SAMPLE_DOCUMENTS)
    samples = [row.ids for row in rows.select("text").mapInArrow(_sample_ids(definition), "ids binary").collect()]
    samples = [bytes(s) for s in samples if len(s) >= 8]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 50 else b""
    except zstandard.ZstdError:  # too little variety to fit one
        return b""


def _write(folder: str, dictionary: Broadcast, definition: Broadcast, end: bytes) -> Callable:
    names = [f.split(" ")[0] for f in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer = ShardWriter(folder, context.partitionId(), context.taskAttemptId(), dictionary.value)
        encoder, done = in_worker(ByteBpe, definition.value), []
        for batch in batches:
            keys, texts = batch.column("k").to_pylist(), batch.column("text")
            for a, b in slices(pa.compute.binary_length(texts).to_pylist(), CHARS):
                for doc_id, ids in zip(keys[a:b], encoder.encode(texts.slice(a, b - a).to_pylist()), strict=True):
                    done.append(writer.add(doc_id, ids + end))
        rows = [row for row in (*done, writer.close()) if row]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names).cast(ARROW_MANIFEST)

    return run


ARROW_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def write_tokens(documents: DataFrame, folder: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> tuple[DataFrame, bytes]:
    """Encode all documents, append ``end_id`` to each, and write shards in ascending order of ``key``.

    Returns the manifest (part, seq, path, n_docs, n_tokens; one row per shard) and the dictionary,
    which is also written to ``folder``. ``key`` is an integer; null keys come last; rows with the same
    key are ordered by a hash of their text. Null and empty texts have the end id alone. Strings of added
    tokens inside a text are encoded as the library does by default.

    A range partition on the key gives the global order; each task sorts its range and rolls shard
    files of bounded size. A file gets its final name when it is whole and always has the same content,
    so a repeated task replaces it by itself.
    """
    spark = documents.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    dictionary = train_dictionary(documents, definition, key, text)
    files, base = _open(folder)
    files.create_dir(base)
    with files.open_output_stream(f"{base}/dictionary-{hashlib.sha256(dictionary).hexdigest()[:16]}.zdict") as out:
        out.write(dictionary)
    order = [F.col("k").asc_nulls_last(), F.xxhash64("text").asc()]
    rows = documents.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    task = _write(folder, spark.sparkContext.broadcast(dictionary), definition, _end(end_id))
    return stored(rows.mapInArrow(task, MANIFEST), "token-manifest"), dictionary


def _read(dictionary: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(path, dictionary.value)
                crc = np.fromiter((zlib.crc32(shard.ids(i)) for i in range(len(shard))), np.int64, len(shard))
                counts = shard.counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64(), mask=shard.known == 0), pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(crc)],
                    ["k", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_digests(manifest: DataFrame, dictionary: bytes, key: str = "doc_id") -> DataFrame:
    """One row per document of the shards: ``key``, start (ids before it), n_tokens, ids_crc32.

    Starts are prefix sums: over the tasks' totals, over the shards of a task, over the index of a shard.
    """
    spark = manifest.sparkSession
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # one row per task of the writing job
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    shards = shards.select("path", (F.col("base") + F.col("inner")).alias("start"))
    task = _read(spark.sparkContext.broadcast(dictionary))
    rows = stored(shards, "token-shards").repartition("path").mapInArrow(task, "k bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.withColumnRenamed("k", key)


def token_digests(documents: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Write the shards (to a new shared folder by default) and return what reading them back gives.

    One row per document: ``key``, start, n_tokens, ids_crc32. Null and empty texts have the end id alone; null
    keys come last; repeated rows are documents of their own. An empty table writes no shard and gives
    no rows. A text of any length is encoded whole, in one task. Other columns, of whatever name, do not matter.
    """
    folder = folder or shared_folder(documents.sparkSession, "tokens")
    manifest, dictionary = write_tokens(documents, folder, tokenizer_path, key, text, end_id)
    return read_digests(manifest, dictionary, key)
