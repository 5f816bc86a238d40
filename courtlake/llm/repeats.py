"""Substring dedup: fixed-block anchors, probed by every rolling window, extended to maximal repeats."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.llm.common import shared_folder, stored
from courtlake.llm.hash_space import Vocabulary, part_bounds, part_count, placed
from courtlake.llm.words import gram_hashes

CHUNK_BYTES = 8 << 20  # texts that a task compares at a time; a longer text is a chunk of its own
BUCKET_BYTES = 16 << 20  # texts aimed at per bucket of the stored chunks
MOST_BUCKETS = 100_000  # Spark's own limit; a bucket just holds more chunks beyond it
PART_ENTRIES = 8_000_000  # windows aimed at per part of the hash space

SPANS = "array<struct<start:int,length:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
REPLY = "chunk bigint, step int, part int, mask binary, anchors binary"


def block_words(span: int) -> int:
    """Words of a block: wherever ``span`` words lie, one whole block of a text's fixed grid is among them."""
    return (span + 1) // 2


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kept, text) to (chunk, kept, text): texts in a row are a chunk until they make ``CHUNK_BYTES``."""
    base, chunk, size = TaskContext.get().partitionId() << 33, 0, 0
    for batch in batches:
        numbers = []
        for length in pc.binary_length(batch.column("text")).to_pylist():
            if size and size + length > CHUNK_BYTES:
                chunk, size = chunk + 1, 0
            numbers.append(base + chunk)
            size += length
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column("kept"), batch.column("text")], ["chunk", "kept", "text"])


class Chunk:
    """The words of a chunk's texts, and their windows."""

    def __init__(self, texts: list[bytes], known: Vocabulary, span: int, parts: int):
        known.bounded()
        self.span, self.parts, self.block = span, parts, block_words(span)
        self.words = [t.split() for t in texts]
        # a text shorter than a window neither has one nor repeats one
        self.long = [i for i, w in enumerate(self.words) if len(w) >= span]
        sizes = np.array([len(self.words[i]) for i in self.long], np.int64)
        self.codes = known.codes(list(chain.from_iterable(self.words[i] for i in self.long)))
        self.starts = np.cumsum(sizes) - sizes
        self.place = np.arange(len(self.codes)) - np.repeat(self.starts, sizes)  # of a word in its text
        self.room = np.repeat(sizes, sizes) - self.place  # words from here to the text's end
        self.hashes = {seed: h[self.codes] for seed, h in known.hashes.items()}

    def _grams(self, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        hashes = gram_hashes(self.hashes[seed], k)
        at = np.flatnonzero(self.room[: len(hashes)] >= k)
        return at, hashes[at]

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct rolling windows of a block's length, sorted by name; which of them come twice here; which are
        blocks of a text's grid. Last the places of ``probe_of``, the number of each window's name."""
        at, hashes = self._grams(self.block, 0)
        names, self.probe_of, counts = np.unique(placed(hashes, self.parts), return_inverse=True, return_counts=True)
        anchor = np.zeros(len(names), bool)
        anchor[self.probe_of[self.place[at] % self.block == 0]] = True
        return names, counts > 1, anchor, at

    def extended(self, repeated: np.ndarray, anchored: np.ndarray, at: np.ndarray) -> None:
        """Extend hits to both sides as far as probes are repeated; what holds a whole window gives the suspects.

        ``suspects``: starts of windows all of whose probes are repeated somewhere, one at an anchor.
        ``names``, ``seconds``: their distinct digests in order; ``digest_of``: number of each suspect's digest.
        """
        steps = self.span - self.block + 1  # probes in a window
        rep, anc = np.zeros(len(self.codes) + 1, np.int64), np.zeros(len(self.codes) + 1, np.int64)
        rep[at + 1], anc[at + 1] = repeated[self.probe_of], (anchored & repeated)[self.probe_of]
        rep, anc = np.cumsum(rep), np.cumsum(anc)
        windows = np.flatnonzero(self.room >= self.span)
        whole = (rep[windows + steps] - rep[windows] == steps) & (anc[windows + steps] > anc[windows])
        self.suspects = windows[whole]
        first, second = (gram_hashes(self.hashes[seed], self.span)[self.suspects] if len(self.suspects) else np.empty(0, np.uint64) for seed in (0, 1))
        names = placed(first, self.parts)
        order = np.lexsort((second, names))
        names, second = names[order], second[order]
        new = np.r_[True, (names[1:] != names[:-1]) | (second[1:] != second[:-1])] if len(names) else np.empty(0, bool)
        self.digest_of = np.empty(len(names), np.int64)
        self.digest_of[order] = np.cumsum(new) - 1
        at_first = np.flatnonzero(new)
        self.names, self.seconds, self.again = names[at_first], second[at_first], np.diff(np.r_[at_first, len(names)]) > 1

    def covered(self, confirmed: np.ndarray) -> np.ndarray:
        """Which words the confirmed windows cover."""
        edge = np.zeros(len(self.codes) + 1, np.int64)
        sure = self.suspects[confirmed[self.digest_of]]
        np.add.at(edge, sure, 1)
        np.add.at(edge, sure + self.span, -1)
        return np.cumsum(edge[:-1]) > 0

    def spans(self, covered: np.ndarray) -> list[list[tuple[int, int]]]:
        """Maximal covered stretches of each text: (first word, words)."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.words]
        turns = covered & ~(np.r_[False, covered[:-1]] & (self.place > 0))
        begin = np.flatnonzero(turns)
        stop = np.flatnonzero(covered & ~(np.r_[covered[1:], False] & (self.room > 1)))
        text = np.searchsorted(self.starts, begin, "right") - 1
        for i, a, b in zip(text.tolist(), self.place[begin].tolist(), (stop - begin + 1).tolist(), strict=True):
            out[self.long[i]].append((a, b))
        return out


def _dealt(chunk: int, names: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per part: the lower halves of its names, and its share of the columns (booleans as bits)."""
    at = part_bounds(names, parts)
    full = np.flatnonzero(at[1:] > at[:-1])
    low = names.astype(np.uint32)
    pack = lambda x, p: (np.packbits(x[at[p] : at[p + 1]]) if x.dtype == bool else x[at[p] : at[p + 1]]).tobytes()
    arrays = [pa.array([chunk] * len(full), pa.int64()), pa.array(full, pa.int32())]
    arrays += [pa.array([pack(x, p) for p in full], pa.binary()) for x in (low, *columns.values())]
    return pa.RecordBatch.from_arrays(arrays, ["chunk", "part", "names", *columns])


def _texts(table: pa.Table | pa.RecordBatch) -> list[bytes]:
    return table.column("text").cast(pa.binary()).to_pylist()


def _probes(span: int, parts: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's texts to its probes per part."""
        texts = [t for batch in batches for t in _texts(batch)]
        names, again, anchor, _ = Chunk(texts, Vocabulary(0, 1), span, parts).probes()
        yield _dealt(key[0].as_py(), names, parts, {"again": again, "anchor": anchor})

    return run


def _held(batches: Iterator[pa.RecordBatch], wide: bool) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """The rows of a part: chunks, where each one's entries begin, and the columns of all entries together."""
    chunks, names, others = [], [], ([], [])
    for batch in batches:
        for row in batch.to_pylist():
            chunks.append(row["chunk"])
            names.append(np.frombuffer(row["names"], np.uint32))
            bits = lambda c: np.unpackbits(np.frombuffer(row[c], np.uint8), count=len(names[-1])).view(bool)  # noqa: E731, B023
            others[0].append(bits("again"))
            others[1].append(np.frombuffer(row["seconds"], np.uint64) if wide else bits("anchor"))
    return chunks, np.cumsum([0, *map(len, names)]), [np.concatenate(x) for x in (names, *others)]


def _replies(step: int, part: int, chunks: list[int], at: np.ndarray, mask: np.ndarray, anchors: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    cut = [(c, mask[a:b], None if anchors is None else anchors[a:b]) for c, a, b in zip(chunks, at, at[1:], strict=False)]
    cut = [(c, np.packbits(m).tobytes(), None if x is None else np.packbits(x).tobytes()) for c, m, x in cut if m.any()]
    columns = [pa.array([c for c, _, _ in cut], pa.int64()), pa.array([step] * len(cut), pa.int32()), pa.array([part] * len(cut), pa.int32())]
    yield pa.RecordBatch.from_arrays([*columns, pa.array([m for _, m, _ in cut], pa.binary()), pa.array([x for _, _, x in cut], pa.binary())], ["chunk", "step", "part", "mask", "anchors"])


def _met(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's probes to a reply per chunk: which come more than once over all, and which of them at an anchor."""
    chunks, at, (names, again, anchor) = _held(batches, wide=False)
    found, number = np.unique(names, return_inverse=True)
    times = np.bincount(number, minlength=len(found)) + np.bincount(number[again], minlength=len(found))
    anchored = np.zeros(len(found), bool)
    anchored[number[anchor]] = True
    yield from _replies(1, key[0].as_py(), chunks, at, (times > 1)[number], anchored[number])


def _confirmed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's whole windows to a reply per chunk: which come more than once over all."""
    chunks, at, (names, again, seconds) = _held(batches, wide=True)
    order = np.lexsort((seconds, names))
    a, b = names[order], seconds[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    times = np.bincount(number) + np.bincount(number[again], minlength=int(new.sum()))
    yield from _replies(2, key[0].as_py(), chunks, at, (times > 1)[number], None)


def _answers(replies: pa.Table, step: int, names: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The replies to one step, laid over the names that were asked for."""
    mask, anchors, at = np.zeros(len(names), bool), np.zeros(len(names), bool), part_bounds(names, parts)
    for row in replies.to_pylist():
        if row["step"] == step:
            a, b = at[row["part"]], at[row["part"] + 1]
            for out, bits in ((mask, row["mask"]), (anchors, row["anchors"])):
                if bits is not None:
                    out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return mask, anchors


def _extended_chunk(texts: pa.Table, replies: pa.Table, span: int, parts: int) -> Chunk:
    chunk = Chunk(_texts(texts), Vocabulary(0, 1), span, parts)
    names, _, _, at = chunk.probes()
    chunk.extended(*_answers(replies, 1, names, parts), at)
    return chunk


def _suspects(span: int, parts: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, replies: pa.Table) -> pa.Table:
        """A chunk's texts and the replies on its probes to its suspected windows per part."""
        chunk = _extended_chunk(texts, replies, span, parts)
        return pa.Table.from_batches([_dealt(key[0].as_py(), chunk.names, parts, {"seconds": chunk.seconds, "again": chunk.again})])

    return run


def _cleaned(span: int, parts: int):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        """A chunk's texts and all replies to (kept, n_words, spans, kept_text)."""
        chunk = _extended_chunk(texts, replies, span, parts)
        spans = chunk.spans(chunk.covered(_answers(replies, 2, chunk.names, parts)[0]))
        out = []
        for words, gone in zip(chunk.words, spans, strict=True):
            edges = [0, *chain.from_iterable((a, a + n) for a, n in gone), len(words)]
            out.append(b" ".join(chain.from_iterable(words[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
        columns = [pa.array([len(w) for w in chunk.words], pa.int64()), pa.array([[{"start": a, "length": n} for a, n in s] for s in spans], _SPANS), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays([texts.column("kept").combine_chunks(), *columns], ["kept", "n_words", "spans", "kept_text"])

    return run


def _stored_chunks(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows as chunks, bucketed by chunk, so that later passes bring replies to the texts and not the reverse."""
    spark = rows.sparkSession
    kept_type = rows.schema["kept"].dataType.simpleString()
    chunks = rows.mapInArrow(_chunked, f"chunk bigint, kept {kept_type}, text string")
    name, folder = f"chunks_{uuid.uuid4().hex}", shared_folder(spark, "chunks")
    chunks.write.format("parquet").bucketBy(buckets, "chunk").sortBy("chunk").option("path", folder).saveAsTable(name)
    return spark.table(name)


def repeated_spans(documents: DataFrame, keep: list[str], text: str = "text", span: int = 35) -> DataFrame:
    """One row per row of ``documents``: kept (a struct of ``keep``), n_words, spans (start, length), kept_text.

    Words are runs other than space and the five control blanks, unchanged. A window is ``span`` words in a row
    of one text. ``spans`` are the maximal stretches of words that are covered by windows whose words also
    start elsewhere, in the same text or another; ``kept_text`` joins the other words by a space.

    Every text is cut into a fixed grid of blocks of half a window, the anchors; a window holds a whole one
    wherever it lies. All rolling windows of a block's length probe them. A probe that meets an anchor
    elsewhere is extended to both sides while the probes it passes are repeated too; where the extension
    has room for a whole window, the window itself is confirmed by a digest of its words (hashes of 32 and
    64 bits beside the part). So nothing rests on pairs of texts.

    Tasks work on chunks of texts. A chunk sends each distinct probe, and each distinct window, once, packed by
    part of the hash space, and gets a bit for each back; a passage that very many texts share is one
    entry per chunk. Texts stay where they are, in a table bucketed by chunk (in the folder of
    ``spark.checkpoint.dir``, until the session's JVM ends).

    Null and empty texts have no words, no spans and an empty kept_text. Repeated rows are texts that repeat
    each other. Texts shorter than a window stay whole. A very long text is a chunk of its own and must
    fit a task with its hashes. An empty table gives no rows. Columns of ``keep`` travel in a struct, so
    their names cannot clash with inner ones.
    """
    spark = documents.sparkSession
    kept = F.struct(*[documents[c] for c in keep]) if keep else F.lit(0)
    rows = documents.select(kept.alias("kept"), F.coalesce(documents[text], F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = part_count(spark, size / 6, PART_ENTRIES)
    chunks = _stored_chunks(rows, min(MOST_BUCKETS, part_count(spark, size, BUCKET_BYTES)))
    texts = chunks.select("chunk", "text")

    probes = texts.groupBy("chunk").applyInArrow(_probes(span, parts), "chunk bigint, part int, names binary, again binary, anchor binary")
    met = stored(probes.groupBy("part").applyInArrow(_met, REPLY), "anchor-replies")
    suspects = texts.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(_suspects(span, parts), "chunk bigint, part int, names binary, seconds binary, again binary")
    confirmed = stored(suspects.groupBy("part").applyInArrow(_confirmed, REPLY), "window-replies")
    replies = met.unionByName(confirmed)
    kept_type = rows.schema["kept"].dataType.simpleString()
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_cleaned(span, parts), f"kept {kept_type}, n_words bigint, spans {SPANS}, kept_text string")


def without_repeats(documents: DataFrame, text: str = "text", span: int = 35) -> DataFrame:
    """The rows of ``documents``, all columns, their texts without repeated spans (see ``repeated_spans``).

    Texts from which nothing goes stay as they are, null ones too; of others the words that stay are joined by a space.
    """
    rows = repeated_spans(documents, documents.columns, text, span)
    shorter = F.when(F.size("spans") > 0, F.col("kept_text")).otherwise(F.col(f"kept.{text}"))
    return rows.select(*[shorter.alias(c) if c == text else F.col(f"kept.{c}").alias(c) for c in documents.columns])
