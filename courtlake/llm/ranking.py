"""Ranked lexical search: shards of impact-sorted lists, read without random access until scores are resolved."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtlake.llm.common import stored
from courtlake.llm.words import alnum_words

QUERY_BYTES = 2 << 20  # texts of the items that are searched together
CHUNK_BYTES = 4 << 20  # text that a task counts at a time
SHARD_DOCUMENTS, SHARD_POSTINGS = 50_000, 4_000_000  # a shard is closed at the first of these
FIRST_READ = 256  # entries of each list in the first round; each round reads twice as many as the one before

FORWARD = "n bigint, terms array<int>, counts array<int>"


class _Known(dict):
    """Term to number; -1 for others."""

    def __missing__(self, term: bytes) -> int:
        return -1


def _counted(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, text) to (k, n, terms, counts): all terms of a text, and how often each of the known ones comes."""
        known = _Known(zip(terms.value, range(len(terms.value)), strict=True))
        for batch in batches:
            keys, texts, at = batch.column("k"), batch.column("text").to_pylist(), 0
            while at < len(texts):
                codes, sizes, first, size = [], [], at, 0
                while at < len(texts) and size < CHUNK_BYTES:
                    words = alnum_words(texts[at])
                    codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                    sizes.append(len(words))
                    size += len(texts[at])
                    at += 1
                document = np.repeat(np.arange(len(sizes)), sizes)
                codes = np.concatenate(codes)
                found = codes >= 0
                places, counts = np.unique(document[found] * len(known) + codes[found], return_counts=True)
                offsets = pa.array(np.searchsorted(places, np.arange(len(sizes) + 1) * len(known)), pa.int32())
                numbers = places % len(known) if len(known) else places
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (numbers, counts)]
                yield pa.RecordBatch.from_arrays([keys.slice(first, at - first), pa.array(sizes, pa.int64()), *lists], ["k", "n", "terms", "counts"])

    return run


class Shard:
    """The postings of some documents, per term by falling impact."""

    def __init__(self, batches: list[pa.RecordBatch], documents: int, words: int, n_terms: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        ascending = pc.sort_indices(table.column("k"), null_placement="at_end").to_numpy()
        self.keys = table.column("k").take(pa.array(ascending))  # of equal scores the smaller number comes first
        number = np.empty(len(ascending), np.int64)
        number[ascending] = np.arange(len(ascending))
        lists = table.column("terms").combine_chunks()
        document = np.repeat(number, pc.list_value_length(lists).to_numpy())
        terms, tf = lists.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        length = np.empty(len(ascending), np.int64)
        length[number] = 75 + 25 * table.column("n").to_numpy() * documents // words
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * length[document])
        order = np.lexsort((-impact, terms))
        self.documents, self.impacts = document[order], impact[order]
        self.at = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def list(self, term: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at[term], self.at[term + 1]
        return self.documents[a:b], self.impacts[a:b] * weight


def resolved(lists: list[tuple[np.ndarray, np.ndarray]], n_documents: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of highest sum of impacts and their sums; all with a sum above 0, if fewer.

    No-random-access: rounds read the lists on from where they stopped. What a document was met with is
    the lower end of its score; the upper end adds, for each list that has not shown it, the impact last
    read there. Reading goes on until no unmet document can reach the k-th lower end, and every document
    whose upper end reaches it (so every tie too) has both ends equal. Once unmet ones are out, only lists
    that an open document is still missing from are read on.
    """
    size = np.array([len(d) for d, _ in lists], np.int64)
    at, heads = np.zeros(len(lists), np.int64), np.array([i[0] for _, i in lists], np.int64)
    lower = np.zeros(n_documents, np.int64)
    met = np.zeros((n_documents, -(-len(lists) // 8)), np.uint8)  # a bit per list
    wanted, step = size > 0, FIRST_READ
    while True:
        for j in np.flatnonzero(wanted):
            documents, impacts = lists[j]
            a, b = at[j], min(at[j] + step, size[j])
            lower[documents[a:b]] += impacts[a:b]
            met[documents[a:b], j >> 3] |= np.uint8(1 << (j & 7))
            at[j], heads[j] = b, impacts[b - 1] if b < size[j] else 0
        step *= 2
        unmet = int(heads.sum())
        bar = max(1, int(np.partition(lower, n_documents - k)[n_documents - k])) if n_documents >= k else 1
        if unmet >= bar:  # a document that was not met yet may still belong to the first k, or tie with the last
            wanted = at < size
            continue
        open_ = np.flatnonzero(lower + unmet >= bar)
        unread = 1 - np.unpackbits(met[open_], axis=1, count=len(lists), bitorder="little").astype(np.int64)
        reach = lower[open_] + unread @ heads >= bar
        open_, wanted = open_[reach], ((unread[reach] * heads) > 0).any(axis=0)
        if not wanted.any():
            best = open_[np.lexsort((open_, -lower[open_]))][:k]
            return best, lower[best]


def _searched(queries, documents: int, words: int, weights: list[int], items: pa.Array, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, n, terms, counts) to (item_no, item_id, doc, score): the first of each item in each shard."""

        def search(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            shard, numbers, scores, places = Shard(held, documents, words, len(weights)), [], [], []
            for number, terms in enumerate(queries.value):
                lists = [x for x in (shard.list(t, q * weights[t]) for t, q in terms if weights[t] > 0) if len(x[0])]
                if lists:
                    best, score = resolved(lists, len(shard.keys), k)
                    numbers.append(np.full(len(best), number))
                    scores.append(score)
                    places.append(best)
            whole = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
            at = pa.array(whole(numbers), pa.int64())
            keys = shard.keys.take(pa.array(whole(places), pa.int64()))
            return pa.RecordBatch.from_arrays([at, items.take(at), keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys, pa.array(whole(scores), pa.int64())], ["item_no", "item", "doc", "score"])

        held, n, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            n, postings = n + batch.num_rows, postings + len(batch.column("terms").flatten())
            if n >= SHARD_DOCUMENTS or postings >= SHARD_POSTINGS:
                yield search(held)
                held, n, postings = [], 0, 0
        if n:
            yield search(held)

    return run


def _search_block(rows: DataFrame, items: pa.Table, k: int, key_type: str, item_type: str) -> DataFrame | None:
    """The first ``k`` of each item of a block, whose size is bounded by ``QUERY_BYTES``; None if there can be none."""
    spark = rows.sparkSession
    wanted = [Counter(alnum_words(t or "")) for t in items.column("text").to_pylist()]
    terms = sorted(set().union(*wanted))
    number = {t: i for i, t in enumerate(terms)}
    queries = [[(number[t], q) for t, q in sorted(c.items())] for c in wanted]
    forward = stored(rows.mapInArrow(_counted(spark.sparkContext.broadcast(terms)), f"k {key_type}, {FORWARD}"), "term-counts")
    documents, words = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not words or not terms:
        return None
    holding = forward.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = dict(zip(holding.column("term").to_pylist(), holding.column("count").to_pylist(), strict=True))
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))]
    search = _searched(spark.sparkContext.broadcast(queries), documents, words, weights, items.column("item").combine_chunks(), k)
    found = forward.where(F.size("terms") > 0).mapInArrow(search, f"item_no bigint, item {item_type}, doc {key_type}, score bigint")
    order = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return stored(ranked.select("item", "rank", "doc", "score"), "ranked")


def ranked_search(
    documents: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The ``k`` documents of highest score for each item: ``item``, rank (from 1), ``key``, score.

    Terms are runs of ASCII letters or digits and non-ASCII characters, A-Z lowered. With N documents that
    have terms, L terms in all, n terms in a document, tf of them a given one, which df documents hold,
    a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + (25 n N) div L, and the score sums
    w ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included. Only scores above 0 count;
    of equal ones the smaller ``key`` comes first, null last.

    Documents are counted once per block of items (``QUERY_BYTES`` of texts; the terms of a block are
    broadcast). Tasks then cut what they read into shards of bounded size, sort a shard's postings by impact,
    and answer each item by ``resolved``, exactly; a shard gives at most ``k`` rows for an item, of which
    Spark keeps the first ``k`` over all shards.

    Null and empty texts have no terms: such documents count for nothing, such items get no rows. Rows of
    ``queries`` that repeat id and text are one item; those that repeat only an id are ranked each by
    itself. Repeated rows of ``documents`` are documents of their own. Empty tables give no rows. A long
    text is counted whole, by itself. Only the four columns named are read; others, of whatever name, do
    not matter.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    asked = queries.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    key_type, item_type = rows.schema["k"].dataType.simpleString(), asked.schema["item"].dataType.simpleString()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    found = spark.createDataFrame([], f"item {item_type}, rank int, doc {key_type}, score bigint")
    for block in range(blocks):
        items = asked.where(F.col("block") == block).select("item", "text").toArrow()
        some = _search_block(rows, items, k, key_type, item_type) if len(items) else None
        found = found if some is None else found.unionByName(some)
    return found.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")
