"""Phrase collocations: Misra-Gries summaries find every frequent n-gram, a second pass counts them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlake.llm.common import stored
from courtlake.llm.hash_space import Vocabulary, part_bounds, part_count, placed
from courtlake.llm.words import mixed

CHUNK_BYTES = 4 << 20  # text that a task counts at a time
PART_MASS = 32_000_000  # n-gram occurrences aimed at per part of the hash space
MERGE = 3  # a summary is merged once as many entries wait as this many times its capacity
FILTER_BITS = 26  # the filter of survivors takes 2**26 bits (8 MB) at any size; a fuller one passes more

#: Characters that end a piece, and the byte that stands for them (it is in no UTF-8 text).
SEPARATORS, BREAK = b".,;:!?\n\x0b\x0c\r", b"\xff"
_PLAIN = bytes(0xFF if c in SEPARATORS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _stretches(text: bytes) -> Iterator[bytes]:
    """A text in stretches of whole pieces, of about ``CHUNK_BYTES`` each where it has so many separators."""
    plain = text.translate(_PLAIN)
    at = 0
    while len(plain) - at > CHUNK_BYTES:
        cut = plain.rfind(BREAK, at, at + CHUNK_BYTES)
        cut = cut if cut >= 0 else plain.find(BREAK, at)
        if cut < 0:
            break
        yield plain[at:cut]
        at = cut + 1
    yield plain[at:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Plain texts by language, so many that they make a chunk."""
    held, size = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            for stretch in _stretches(text):
                held[lang].append(stretch)
                size += len(stretch)
                if size >= CHUNK_BYTES:
                    yield held
                    held, size = defaultdict(list), 0
    if held:
        yield held


class Grams:
    """The n-grams of a chunk's texts in one language: codes of its words, and a hash per n-gram."""

    def __init__(self, lang: str, texts: list[bytes], known: Vocabulary, longest: int):
        words = BREAK.join(texts).replace(BREAK, b" \xff ").split()
        self.codes = known.codes([BREAK, *words])
        inside = self.codes != known[BREAK]
        run = np.cumsum(~inside)  # n-grams lie within one run of words
        self.n_words = int(inside.sum())
        salt, hashes = np.uint64(xxhash.xxh3_64_intdigest(lang)), known.hashes[0][self.codes]
        self.starts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        total = np.full(len(hashes), salt)
        for n in range(1, longest + 1):
            total = mixed(total[: len(hashes) - n + 1] * _STEP + hashes[n - 1 :])
            whole = inside[: len(total)] & (run[: len(total)] == run[n - 1 :])
            self.starts.append(np.flatnonzero(whole))
            self.hashes.append(total[whole])


def _languages(chunk: dict[str, list[bytes]], known: Vocabulary, longest: int) -> Iterator[tuple[str, Grams]]:
    known.bounded()
    for lang, texts in chunk.items():
        yield lang, Grams(lang, texts, known, longest)


def _masses(parts: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, text) to (lang, part, mass): words of a language (part -1), n-grams of a part (lang null)."""
        known, words, mass = Vocabulary(0), defaultdict(int), np.zeros(parts, np.int64)
        for chunk in _chunks(batches):
            for lang, grams in _languages(chunk, known, longest):
                words[lang] += grams.n_words
                for hashes in grams.hashes:
                    mass += np.bincount((placed(hashes, parts) >> np.uint64(32)).astype(np.int64), minlength=parts)
        full = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*words, *[None] * len(full)], pa.string()), pa.array([-1] * len(words) + full.tolist(), pa.int32()), pa.array([*words.values(), *mass[full].tolist()], pa.int64())],
            ["lang", "part", "mass"],
        )

    return run


SUMMARY = "part int, mass bigint, single binary, many binary, counts binary"


def _summaries(parts: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, text) to a chunk's summary per part: names that came once, names that came oftener, their counts."""
        known = Vocabulary(0)
        for chunk in _chunks(batches):
            hashes = np.concatenate([h for _, grams in _languages(chunk, known, longest) for h in grams.hashes])
            names, counts = np.unique(placed(hashes, parts), return_counts=True)
            once, often = names[counts == 1], names[counts > 1]
            counts = counts[counts > 1].astype(np.uint32)
            a, b = part_bounds(once, parts), part_bounds(often, parts)
            full = np.flatnonzero((a[1:] > a[:-1]) | (b[1:] > b[:-1]))
            cut = lambda values, at: pa.array([values[at[p] : at[p + 1]].astype(np.uint32).tobytes() for p in full], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.nulls(len(full), pa.int64()), cut(once, a), cut(often, b), cut(counts, b)],
                ["part", "mass", "single", "many", "counts"],
            )

    return run


class MisraGries:
    """A summary of ``capacity`` counters; ``lost`` is what a count may lack at most.

    A merge adds counters up and, where they are too many, takes the count of the first one beyond the
    capacity from all. Each such unit is taken from more than ``capacity`` counters, so that ``lost`` stays
    below mass / capacity whatever the order of merges.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.names, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, names: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((names, counts))
        self.size += len(names)
        if self.size >= MERGE * self.capacity:
            self.merge()

    def merge(self) -> None:
        names = np.concatenate([self.names, *[n for n, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.size = [], 0
        order = np.argsort(names, kind="stable")
        names = names[order]
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.empty(0, np.int64)
        self.names = names[first]
        self.counts = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)
        beyond = len(self.names) - self.capacity
        if beyond > 0:
            least = np.partition(self.counts, beyond - 1)[beyond - 1]  # the largest that does not fit
            self.lost += int(least)
            stays = self.counts > least
            self.names, self.counts = self.names[stays], self.counts[stays] - least


def _survivors(threshold: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's summaries, its mass first, to the words of the filter that its survivors set."""
        summary, part = None, key[0].as_py()
        for batch in batches:
            mass = [m for m in batch.column("mass").to_pylist() if m is not None]
            if mass:
                # more counters than mass / threshold: whatever comes so often is never lost
                summary = MisraGries(mass[0] // threshold + 1)
            for single, many, counts in zip(*[batch.column(c).to_pylist() for c in ("single", "many", "counts")], strict=True):
                if single is not None:
                    names = np.frombuffer(single, np.uint32)
                    summary.add(names, np.ones(len(names), np.int64))
                    summary.add(np.frombuffer(many, np.uint32), np.frombuffer(counts, np.uint32).astype(np.int64))
        summary.merge()
        names = summary.names[summary.counts + summary.lost >= threshold].astype(np.uint64)
        slots = _slots((np.uint64(part) << np.uint64(32)) | names)
        at, where = np.unique(slots >> np.uint64(6), return_inverse=True)
        bits = np.zeros(len(at), np.uint64)
        np.bitwise_or.at(bits, where, np.uint64(1) << (slots & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(bits.view(np.int64))], ["at", "bits"])

    return run


def _slots(places: np.ndarray) -> np.ndarray:
    return mixed(places) >> np.uint64(64 - FILTER_BITS)


def _counted(bits, parts: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, text) to (lang, n, phrase, f): exact counts, per chunk, of the n-grams that the filter knows."""
        known, filter_words = Vocabulary(0), np.frombuffer(bits.value, np.uint64)
        for chunk in _chunks(batches):
            for lang, grams in _languages(chunk, known, longest):
                for n, (starts, hashes) in enumerate(zip(grams.starts, grams.hashes, strict=True), 1):
                    slots = _slots(placed(hashes, parts))
                    kept = np.flatnonzero((filter_words[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1))
                    rows, counts = _same(grams.codes, starts[kept], hashes[kept], n)
                    phrases = [b" ".join([known.words[c] for c in codes]) for codes in rows.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(phrases), pa.string()), pa.array([n] * len(phrases), pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                        ["lang", "n", "phrase", "f"],
                    )

    return run


def _same(codes: np.ndarray, starts: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams at ``starts``, as rows of codes, and how often each comes. Words decide, hashes only sort."""
    order = np.argsort(hashes, kind="stable")
    starts, hashes = starts[order], hashes[order]
    grams = codes[starts[:, None] + np.arange(n)]
    new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.empty(0, bool)
    if not new.all() and ((grams[1:] != grams[:-1]).any(axis=1) & ~new[1:]).any():
        return np.unique(grams, axis=0, return_counts=True)  # two n-grams of one hash
    first = np.flatnonzero(new)
    return grams[first], np.diff(np.r_[first, len(starts)])


def frequent_phrases(texts: DataFrame, threshold: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f) of all n-grams of ``longest`` words at most that come ``threshold`` times, and (lang, words).

    ``texts`` has (lang, text) without nulls. Three readings of it: the first sums the mass of each part of
    the hash space; the second makes summaries per chunk and part, and merges each part's with more
    counters than its mass divided by the threshold; the third counts what survived by its words.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = part_count(spark, size / 6 * longest, PART_MASS)
    masses = texts.mapInArrow(_masses(parts, longest), "lang string, part int, mass bigint")
    masses = stored(masses.groupBy("lang", "part").agg(F.sum("mass").alias("mass")), "phrase-masses")
    words = masses.where("part < 0").select("lang", F.col("mass").alias("words"))

    summaries = texts.mapInArrow(_summaries(parts, longest), SUMMARY)
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("single", "many", "counts")]
    dealt = masses.where("part >= 0").select("part", "mass", *nothing).unionByName(summaries)
    # within a group rows come in the order of their partition: the mass, which capacities rest on, is put first
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", F.col("mass").desc_nulls_last())
    found = dealt.groupBy("part").applyInArrow(_survivors(threshold), "at bigint, bits bigint")
    rows = stored(found.groupBy("at").agg(F.bit_or("bits").alias("bits")), "phrase-filter").toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    counted = texts.mapInArrow(_counted(spark.sparkContext.broadcast(bits.tobytes()), parts, longest), "lang string, n int, phrase string, f bigint")
    totals = counted.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)
    return stored(totals, "frequent-phrases"), words


def _joined(phrase: Column, first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, length), " ")


def collocations(
    documents: DataFrame, text: str = "text", group: str = "lang", unknown: str = "und",
    longest: int = 4, threshold: int = 30, covered: int = 80, first: int = 2000,
) -> DataFrame:
    """The first ``first`` phrases of each group: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered, texts end at ``SEPARATORS`` into pieces and these into words at spaces and tabs.
    Candidates are phrases of 2 to ``longest`` words that come ``threshold`` times (a) in their group's
    pieces. Cut after k words, a candidate scores floor(2000000 a / (l + r)), where l and r count its two
    sides; the lowest-scoring cut counts, on ties the smallest k. Candidates inside a longer one that has
    ``covered`` per cent of their count are dropped. n is the number of words of the group.

    Every part of a candidate comes at least as often as the candidate, so one search for frequent
    n-grams gives all counts. Misra-Gries summaries lose none of them (see ``frequent_phrases``); counts
    are by words, and products are decimals of 38 digits.

    Null texts count as empty, a null group as ``unknown``. Repeated rows count again. Ties fall to the
    higher a, then to the phrase in byte order. An empty table, or one without phrases so frequent, gives
    no rows. A text of any length is read in stretches that end at separators. Only ``text`` and ``group`` are
    read; other columns, of whatever name, do not matter.
    """
    texts = documents.select(F.coalesce(F.col(group).cast("string"), F.lit(unknown)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    frequent, words = frequent_phrases(texts, threshold, longest)
    count = frequent.select("lang", "phrase", "f")
    side = lambda name, value: count.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))

    cuts = frequent.where("n > 1").select("lang", "phrase", "n", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("phrase"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("phrase"), F.col("k") + 1, F.col("n")).alias("right"))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = frequent.where("n > 2").select("lang", "phrase", "n", "f", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m"))
    longer = longer.select("lang", "phrase", "f", "m", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("i"))
    around = longer.groupBy("lang", _joined(F.col("phrase"), F.col("i"), F.col("m")).alias("phrase")).agg(F.max("f").alias("around"))
    enough = F.expr(f"cast(around as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {int(covered)}")
    rows = lowest.join(around, ["lang", "phrase"], "left").where(~F.coalesce(enough, F.lit(False)))

    rows = rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.join(words.withColumnRenamed("words", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
