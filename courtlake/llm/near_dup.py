"""MinHash near-duplicates: min-max signatures, banding, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake.llm.common import stored
from courtlake.llm.components import components
from courtlake.llm.token_memo import small_batches
from courtlake.llm.words import WordHashes, blank_words, gram_hashes, mixed

PERMUTATIONS = 48  # each gives two values, its minimum and its maximum
ROWS = 4  # values of a band: pairs at 0.8 miss all 24 bands with probability 3e-6
BANDS = 2 * PERMUTATIONS // ROWS
HEAD = 32  # shingles of a set that the pair bounds look at
_AT_ONCE = 8  # permutations evaluated together


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    odd = draw.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, draw.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64), draw.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FACTOR, SHIFT, BAND_FACTOR = _constants()


def shingle_set(words: list[bytes], k: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of the whole sequence if it is shorter."""
    return np.unique(gram_hashes(memo.of(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def min_max_signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation, next to each other."""
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    for p in range(0, PERMUTATIONS, _AT_ONCE):
        values = shingles * FACTOR[p : p + _AT_ONCE, None] + SHIFT[p : p + _AT_ONCE, None]
        values.min(axis=1, out=out[p : p + _AT_ONCE, 0])
        values.max(axis=1, out=out[p : p + _AT_ONCE, 1])
    return out.ravel()


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = (mixed(signature.reshape(BANDS, ROWS)) * BAND_FACTOR).sum(axis=1, dtype=np.uint64)
    return mixed(bands + np.arange(BANDS, dtype=np.uint64))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, content, text) to (k, content, n, cls, bands)."""
        memo = WordHashes()
        for batch in small_batches(batches):
            n, cls, bands = [], [], []
            for content, text in zip(batch.column("content").to_pylist(), batch.column("text").to_pylist(), strict=True):
                shingles = shingle_set(blank_words(text), k, memo)
                n.append(len(shingles))
                # a set's digest; a text without words is linked with nothing and gets no bands
                cls.append(xxhash.xxh3_128_digest(shingles.tobytes() if len(shingles) else content.encode()))
                bands.append(band_keys(min_max_signature(shingles)).view(np.int64) if len(shingles) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("content"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["k", "content", "n", "cls", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cls, text) to (cls, shingles)."""
        memo = WordHashes()
        for batch in small_batches(batches):
            sets = [shingle_set(blank_words(text), k, memo).view(np.int64) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.list_(pa.int64()))], ["cls", "shingles"])

    return run


def _linked(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * common >= percent * (n_a + n_b - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent``."""
    side = lambda s: sets.select(F.col("cls").alias(s), F.col("shingles").alias(f"{s}_set"))
    n_a, n_b = F.size("a_set"), F.size("b_set")
    near = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(near)
    return rows.where(_linked(F.size(F.array_intersect("a_set", "b_set")), n_a, n_b, percent)).select("a", "b")


def _further_pairs(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs that could still join two components within some bucket.

    The classes in question are those of buckets that hold several components. An exact prefix filter
    finds their pairs: with shingles from the rarest to the commonest, two sets of ``percent`` share one
    among the first of each, and those of the smaller set may be fewer. Shingles before the first shared
    one, and those that no other set has, bound what two sets can share; this rules out the far members
    of a large family before a pair is made. The bound needs only the first ``HEAD`` shingles of a set.
    """
    root = F.coalesce("root", F.col("cls"))
    members = members.join(roots, F.col("cls") == F.col("node"), "left").select("bucket", "cls", root.alias("root"))
    open_buckets = members.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("bucket")
    unsure = stored(members.join(open_buckets, "bucket", "left_semi").select("cls", "root").distinct(), "unsure")
    tokens = unsure.join(sets, "cls").select("cls", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    # rarest first; a shingle of one set alone cannot be shared, so it only takes up places
    counted = tokens.join(df, "token").groupBy("cls", "root", "n").agg(
        F.count_if(F.col("df") == 1).alias("own"), F.array_sort(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "token")))).alias("shared")
    )
    n, own = F.col("n"), F.col("own")
    long_prefix = n - F.ceil(n * percent / 100) + 1 - own
    short_prefix = n - F.ceil(2 * n * percent / (100 + percent)) + 1 - own
    first = lambda length: F.slice("shared", 1, F.greatest(length, F.lit(0)).cast("int"))
    counted = stored(counted.select("cls", "root", "n", "own", first(long_prefix).alias("long"), F.greatest(short_prefix, F.lit(0)).alias("short")), "prefixes")
    head = F.slice(F.transform("long", lambda x: x["token"]), 1, HEAD).alias("head")
    placed = counted.select("cls", "root", "n", "own", "short", head, F.posexplode("long").alias("at", "shingle"))
    placed = placed.select("cls", "root", "n", "own", "head", "at", F.col("shingle.token").alias("token"), (F.col("at") < F.col("short")).alias("index"))
    a, b = placed.alias("a"), placed.where("index").alias("b")
    i, j, n_a, n_b = F.col("a.at"), F.col("b.at"), F.col("a.n"), F.col("b.n")
    rest = F.least(n_a - F.col("a.own") - i, n_b - F.col("b.own") - j)  # the shared shingle and what may follow it
    heads = F.size(F.array_intersect(F.slice("a.head", F.lit(1), F.least(i, F.lit(HEAD))), F.slice("b.head", F.lit(1), F.least(j, F.lit(HEAD)))))
    before = F.least(i, j, heads + F.greatest(i - HEAD, F.lit(0)) + F.greatest(j - HEAD, F.lit(0)))
    first_shared = (heads == 0) | (i > HEAD) | (j > HEAD)
    condition = (
        (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root"))
        & ((n_a > n_b) | ((n_a == n_b) & (F.col("a.cls") > F.col("b.cls"))))
        & _linked(F.least(i, j) + rest, n_a, n_b, percent) & first_shared & _linked(before + rest, n_a, n_b, percent)
    )
    return stored(a.join(b, condition).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct(), "further-pairs")


def duplicate_classes(documents: DataFrame, key: str, text: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (k, content, n, cls), one per document, and (node, root) for classes with links."""
    content = F.coalesce(F.col(text), F.lit(""))
    source = documents.select(F.col(key).alias("k"), F.sha2(content, 256).alias("content"), content.alias("text"))
    k_type = source.schema["k"].dataType.simpleString()
    signed = stored(source.mapInArrow(_signatures(shingle), f"k {k_type}, content string, n bigint, cls binary, bands array<bigint>"), "signatures")

    # documents of the same set are one class: copies meet no other copy
    classes = signed.where("n > 0").groupBy("cls").agg(F.max("bands").alias("bands"))
    members = stored(classes.select("cls", F.explode("bands").alias("bucket")), "buckets")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(members.join(sizes, "bucket"), "shared-buckets")
    # the set with the most company over all its buckets is the likeliest to be near the others
    company = shared.groupBy("cls").agg(F.sum("size").alias("company"))
    leaders = shared.join(company, "cls").groupBy("bucket").agg(F.max(F.struct("company", "cls")).alias("most"))
    leaders = stored(leaders.select("bucket", F.col("most.cls").alias("leader")), "leaders")
    members = stored(shared.select("cls", "bucket").join(leaders, "bucket"), "led-buckets")

    sample = F.min(F.struct("content", "k"))
    # reduced first: the copies of a text meet in their tasks, before they travel
    texts = stored(signed.groupBy("cls").agg(sample.alias("of")), "samples").join(members.select("cls").distinct(), "cls", "left_semi")
    texts = texts.select("cls", F.col("of.content").alias("c_content"), F.col("of.k").alias("c_k"))
    chosen = source.join(texts, (F.col("content") == F.col("c_content")) & F.col("k").eqNullSafe(F.col("c_k")))
    sets = stored(chosen.select("cls", "text").mapInArrow(_sets(shingle), "cls binary, shingles array<bigint>").dropDuplicates(["cls"]), "sets")

    pairs = members.where(F.col("cls") != F.col("leader")).select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct()
    links = stored(_confirmed(pairs, sets, percent), "confirmed")
    roots = components(links)
    more = stored(_confirmed(_further_pairs(members, sets, roots, percent), sets, percent), "confirmed")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return signed.drop("bands"), roots


def _with_component(signed: DataFrame, roots: DataFrame) -> DataFrame:
    """Add ``component``, a digest that the documents of a component share."""
    joined = signed.join(roots, F.col("cls") == F.col("node"), "left")
    alone = F.concat(F.col("cls"), F.encode(F.coalesce(F.col("k").cast("string"), F.lit("")), "utf-8"))
    return joined.select("k", "content", "n", F.when(F.col("n") == 0, alone).otherwise(F.coalesce("root", "cls")).alias("component"))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id, kept.

    Words are runs other than space and the five control blanks, A-Z lowered. A document's set is its
    distinct ``shingle``-word shingles (the whole sequence if it has fewer words). Documents whose sets
    have a Jaccard similarity of ``percent`` or more are linked; component_id is the smallest key that
    links reach, and kept marks the document with that key.

    Each permutation of a set's hashes gives two signature values, its minimum and its maximum, so 48
    evaluations per shingle make 96 values: 24 bands of 4. Equal sets are one class from the start.
    In each bucket the class with the most company (in all its buckets) is confirmed against every other
    on full sets, which costs one pair per member. Buckets that then still hold several components go through an exact prefix filter over
    their full sets, which leaves out no pair that could link; no bucket is cut or skipped.

    Null, empty and blank texts have no shingles and are linked with nothing. A null key is no smallest
    key: a component without keys has a null component_id, and its documents are all kept. Rows that
    repeat an id and text are one component with that id and all kept. An empty table gives no rows. A text
    of any length is one set, held whole by a task. Only ``key`` and ``text`` are read; other columns, of
    whatever name, do not matter.
    """
    signed, roots = duplicate_classes(documents, key, text, shingle, percent)
    rows = stored(_with_component(signed, roots), "near-duplicates")
    least = stored(rows.groupBy("component").agg(F.min("k").alias("component_id")).withColumnRenamed("component", "c"), "component-ids")
    joined = rows.join(least, F.col("component") == F.col("c"))
    return joined.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents``, all columns, with one document of each component: the one of least key.

    Null keys come after all others; of equal keys the text of least digest stays; of rows that repeat
    key and text the one that comes first as JSON stays. Texts without words all stay, except repeated
    rows. An empty table stays empty. Columns may have any names, as rows travel in a struct.
    """
    signed, roots = duplicate_classes(documents, key, text, shingle, percent)
    rows = stored(_with_component(signed, roots), "near-duplicates")
    rank = F.struct(F.col("k").isNull().alias("last"), "k", "content")
    best = stored(rows.groupBy("component").agg(F.min(rank).alias("best")).withColumnRenamed("component", "c"), "component-ids")
    same = F.col("k").eqNullSafe(F.col("best.k")) & (F.col("content") == F.col("best.content"))
    away = rows.join(best, F.col("component") == F.col("c")).where(~same).select(F.col("k").alias("away_k"), F.col("content").alias("away_content")).distinct()
    # whole rows travel as one struct, so that no column of theirs can clash with an inner one
    docs = documents.select(F.struct("*").alias("row"), F.col(key).alias("d_key"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("d_content"))
    kept = docs.join(away, F.col("d_key").eqNullSafe(F.col("away_k")) & (F.col("d_content") == F.col("away_content")), "left_anti")
    twice = rows.groupBy("k", "content").count().where("count > 1").select(F.col("k").alias("r_k"), F.col("content").alias("r_content"))
    twice = stored(twice, "repeated-rows")
    if twice.isEmpty():
        return kept.select("row.*")
    repeated = F.col("d_key").eqNullSafe(F.col("r_k")) & (F.col("d_content") == F.col("r_content"))
    # of rows alike in key and text the one that comes first as JSON stays, whatever the order of files
    once = kept.join(twice, repeated, "left_semi").groupBy("d_key", "d_content", F.col(f"row.{text}").isNull()).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.join(twice, repeated, "left_anti").select("row.*").unionByName(once.select("row.*"))
