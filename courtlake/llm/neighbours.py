"""Approximate nearest neighbours: NN-descent builds a graph by Spark joins, queries search it greedily."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlake.llm.common import forget, stored
from courtlake.llm.words import mixed

DEGREE = 24  # neighbours that a node keeps
SAMPLE = 11  # new neighbours, as many old ones, and as many nodes that have it as neighbour, which a node introduces
CHANGED = 0.05  # rounds of neighbours of neighbours go on while more than this share of the lists' entries is new
CENTRE = 500  # nodes whose median the hashing takes as the centre
TABLES, BLOCK, PER_BLOCK = 4, 24, 8  # first neighbours: so many hashings into blocks of about BLOCK nodes
FAR = 4  # random neighbours that stay, so that the graph hangs together
BEAM = 500  # nodes that a search keeps; more for a k above its half
ENTRIES = 8  # nodes where every search starts, beside its own
ROWS = 250  # adjacency lists that a search task measures at a time

TOP = 500  # the power of two near which the largest component of doubles is put, so that squares neither overflow nor vanish
MOST = float(np.finfo(np.float64).max)
EDGE_NAMES = ["u", "v", "d"]


def usable_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, vector) that take part: one per id, arrays of doubles of one length.

    Null ids and vectors, zero vectors and those with null or non-finite components are left out. Of
    vectors of several lengths the commonest length counts (of equal counts the shorter). Of rows that
    repeat an id the least vector counts.
    """
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") + 0.0).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("vector", whole) & F.exists("vector", lambda x: x != 0))
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.col("count").desc(), "length").first()
    rows = rows.where(F.size("vector") == (length.length if length else 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def _coded(kind: str, shift: int, bits: int, centre: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, vector) to (node, code, keys): the vector's own floats, moved by a power of two like ``centre``, and a block key per table."""
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch.column("vector").to_numpy(zero_copy_only=False))
            x = np.ldexp(x, shift)
            planes = np.random.default_rng(1).normal(size=(TABLES - 1, x.shape[1], bits))
            signs = np.einsum("nd,tdb->ntb", x - centre, planes) > 0
            keys = (signs * (1 << np.arange(bits))).sum(axis=2, dtype=np.int64)
            chance = mixed(batch.column("node").to_numpy().view(np.uint64)) % np.uint64(1 << bits)  # the last table is random
            keys = np.concatenate([keys, chance.astype(np.int64)[:, None]], axis=1)
            codes = [row.tobytes() for row in x.astype(kind)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(codes, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "code", "keys"])

    return run


def _vectors(codes: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), kind).reshape(len(codes), -1).astype(np.float64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows; the same two rows always give the same number."""
    return ((a - b) ** 2).sum(axis=-1)


def _introduced(most: int, kind: str) -> Callable:
    """Members of a group to edges: to each member its ``most`` nearest others that beat its worst neighbour.

    Two members that are both not fresh have met in an earlier round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for members in batch.column("members"):
                inner = members.values
                nodes = inner.field("node").to_numpy()
                if len(nodes) < 2:
                    continue
                codes = _vectors(inner.field("code"), kind)
                d = _squares(codes[:, None], codes[None])
                np.fill_diagonal(d, np.inf)
                fresh = inner.field("fresh").to_numpy(zero_copy_only=False)
                d[~(fresh[:, None] | fresh)] = np.inf  # both old: they have met
                order = np.argsort(d, axis=1, kind="stable")[:, :most]
                near = np.take_along_axis(d, order, 1)
                row, at = np.nonzero(near < np.minimum(inner.field("worst").to_numpy(), MOST)[:, None])
                for column, values in zip(out, (nodes[row], nodes[order[row, at]], near[row, at]), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], EDGE_NAMES)

    return run


def _introduce(groups: DataFrame, most: int, kind: str) -> DataFrame:
    return groups.select("members").mapInArrow(_introduced(most, kind), "u bigint, v bigint, d double")


def _best(edges: DataFrame) -> DataFrame:
    """(u, neighbours): the ``DEGREE`` nearest of each node, nearest first."""
    return edges.groupBy("u").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "v"))), 1, DEGREE).alias("neighbours"))


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select("u", F.explode("neighbours").alias("n")).select("u", "n.v", "n.d")


def _members(node: str, worst: Column, fresh: Column) -> Column:
    return F.collect_list(F.struct(F.col(node).alias("node"), "code", worst.alias("worst"), fresh.alias("fresh"))).alias("members")


def _meetings(graph: DataFrame, round_: int) -> DataFrame:
    """(u, v, fresh): entries of the lists that take part in a round, fresh if they did in none before.

    Of each list a sample of the fresh and of the old entries, and of those a sample per ``v``, so that
    a node that very many lists contain is in a bounded number of groups.
    """
    entry = lambda x: F.struct(F.xxhash64(F.col("u"), x["v"], F.lit(round_)).alias("h"), x["v"].alias("v"), (~F.array_contains("met", x["v"])).alias("fresh"))
    marked = graph.select("u", F.array_sort(F.transform("neighbours", entry)).alias("all"))
    some = lambda keep: F.slice(F.filter("all", keep), 1, SAMPLE)
    sampled = marked.select("u", F.explode(F.concat(some(lambda x: x["fresh"]), some(lambda x: ~x["fresh"]))).alias("p")).select("u", "p.*")
    back = Window.partitionBy("v", "fresh").orderBy("h", "u")
    return sampled.withColumn("rank", F.row_number().over(back)).where(F.col("rank") <= SAMPLE).select("u", "v", "fresh")


def _groups(meetings: DataFrame) -> DataFrame:
    """(centre, m, fresh): who meets around which node; no group in which all have met before.

    Only ids travel here. A group has ``4 * SAMPLE`` members at most.
    """
    sides = meetings.select(F.col("u").alias("centre"), F.col("v").alias("m"), "fresh").unionByName(meetings.select(F.col("v").alias("centre"), F.col("u").alias("m"), "fresh"))
    groups = sides.groupBy("centre").agg(F.collect_set(F.struct("m", "fresh")).alias("all")).where(F.exists("all", lambda x: x["fresh"]))
    members = groups.select("centre", F.explode("all").alias("x")).select("centre", "x.*")
    return members.groupBy("centre", "m").agg(F.max("fresh").alias("fresh"))


def _mixed_up(*columns) -> Column:
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else F.lit(c) for c in columns])


def neighbour_graph(nodes: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The graph (u, neighbours) of ``nodes`` (node, code, keys), and random edges (u, v) that stay.

    The first neighbours come from blocks of about ``BLOCK`` nodes: hashes by random hyperplanes through
    the centre, split at random where crowded, and one table of random blocks. Then every node introduces a sample of its
    neighbours, and of the nodes it is a neighbour of, to each other, round by
    round until few entries change; lists only get nearer, so this ends. An entry that has taken part
    in a round is old: old ones meet only fresh ones, and a node around which nothing is fresh
    introduces nobody, so rounds become cheaper. Only pairs that beat a list's
    worst entry are passed on. All samples are bounded per node.
    """
    endless, none, yes = F.lit(float("inf")), F.array().cast("array<bigint>"), F.lit(True)
    keyed = nodes.select("node", F.posexplode("keys").alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    keyed = keyed.join(sizes, ["t", "key"]).withColumn("part", F.pmod(_mixed_up("node", "t"), F.col("parts")))
    # ids are dealt to blocks first; a vector joins its node, of which there are few rows, then its block
    keyed = keyed.select("node", "t", "key", "part").join(nodes.select("node", "code"), "node")
    blocks = stored(keyed.groupBy("t", "key", "part").agg(_members("node", endless, yes)), "blocks")
    graph = stored(_best(_introduce(blocks, PER_BLOCK, kind)).withColumn("met", none), "graph")
    chance = blocks.where(F.col("t") == TABLES - 1).select(F.col("members.node").alias("all"))
    chance = chance.select("all", F.posexplode("all").alias("at", "u"))
    around = F.transform(F.sequence(F.lit(1), F.lit(FAR)), lambda i: F.get("all", ((F.col("at") + i) % F.size("all")).cast("int")))
    far = stored(chance.select("u", F.explode(around).alias("v")).where("u != v").distinct(), "far-edges")

    codes = nodes.select(F.col("node").alias("m"), "code")
    for round_ in itertools.count():
        worst = F.when(F.size("neighbours") == DEGREE, F.element_at("neighbours", -1)["d"]).otherwise(endless)
        meetings = stored(_meetings(graph, round_), "meetings")
        known = codes.join(graph.select(F.col("u").alias("m"), worst.alias("worst")), "m", "left").select("m", "code", F.coalesce("worst", endless).alias("worst"))
        groups = _groups(meetings).join(known, "m").groupBy("centre").agg(_members("m", F.col("worst"), F.col("fresh")))
        before = graph.select("u", F.col("neighbours.v").alias("old"), "met")
        now = meetings.where("fresh").groupBy("u").agg(F.collect_list("v").alias("now"))
        lists = _best(_edges(graph).unionByName(_introduce(groups, DEGREE, kind))).join(before, "u", "left").join(now, "u", "left")
        met = F.array_intersect("neighbours.v", F.concat(F.coalesce("met", none), F.coalesce("now", none)))
        new = F.size(F.array_except("neighbours.v", F.coalesce("old", none)))
        last, graph = graph, stored(lists.select("u", "neighbours", met.alias("met"), new.alias("new")), "graph")
        forget(last)
        forget(meetings)
        changed, entries = graph.agg(F.sum("new"), F.sum(F.size("neighbours"))).first()
        if not changed or changed <= CHANGED * entries:
            return graph.select("u", "neighbours"), far


def _adjacency(graph: DataFrame, far: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, links): neighbours both ways and random ones, with their codes; bounded for every node."""
    edges = _edges(graph)
    back = Window.partitionBy("v").orderBy("d", "u")
    reverse = edges.withColumn("rank", F.row_number().over(back)).where(F.col("rank") <= DEGREE).select(F.col("v").alias("u"), F.col("u").alias("v"))
    links = edges.select("u", "v").unionByName(reverse).unionByName(far).distinct()
    links = links.join(nodes.select(F.col("node").alias("v"), "code"), "v")
    return links.groupBy("u").agg(F.collect_list(F.struct("v", "code")).alias("links"))


def _measured(most: int, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(q, code, bound, links) to (q, v, d): linked nodes nearer than the bound, at most ``most`` per query."""
        for whole in batches:
            for a in range(0, len(whole), ROWS):
                batch = whole.slice(a, ROWS)
                links = batch.column("links")
                counts = links.value_lengths().to_numpy()
                inner = links.flatten()
                if not len(inner):
                    continue
                x, own = _vectors(inner.field("code"), kind), _vectors(batch.column("code"), kind)
                q = np.repeat(batch.column("q").to_numpy(), counts)
                v, d = inner.field("v").to_numpy(), _squares(x, np.repeat(own, counts, axis=0))
                keep = np.flatnonzero(d < np.repeat(batch.column("bound").to_numpy(), counts))
                _, first = np.unique(np.stack([q[keep], v[keep]]), axis=1, return_index=True)
                keep = keep[first]
                keep = keep[np.lexsort((v[keep], d[keep], q[keep]))]
                new = np.flatnonzero(np.diff(q[keep], prepend=q[keep][:1] - 1)) if len(keep) else keep
                rank = np.arange(len(keep)) - np.repeat(new, np.diff(new, append=len(keep)))
                keep = keep[rank < most]
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(v[keep]), pa.array(d[keep])], ["q", "v", "d"])

    return run


def _search(queries: DataFrame, nodes: DataFrame, links: DataFrame, most: int, kind: str) -> DataFrame:
    """(q, v, d): the beam of each query (q, code) when none of its nodes is left to look around from.

    A step looks around from all nodes of the beam that it has not yet looked around from. Beams are rows;
    a query never has more than ``most``, and what a task passes on is limited to as many per query.
    """
    endless = F.lit(float("inf"))
    measure = lambda rows: rows.select("q", "code", "bound", "links").mapInArrow(_measured(most, kind), "q bigint, v bigint, d double")
    entries = nodes.orderBy(_mixed_up("node", 7), "node").limit(ENTRIES).select(F.collect_list(F.struct(F.col("node").alias("v"), "code")).alias("links"))
    entries = measure(queries.withColumn("bound", endless).crossJoin(F.broadcast(entries)))
    starts = queries.select("q", F.col("q").alias("v"), F.lit(0.0).alias("d")).unionByName(entries).distinct()
    beam = stored(starts.withColumn("done", F.lit(False)), "beam")
    nearest = Window.partitionBy("q").orderBy("d", "v")
    while True:
        bounds = beam.groupBy("q").agg(F.when(F.count("*") >= most, F.max("d")).otherwise(endless).alias("bound"))
        front = beam.where("not done").select("q", F.col("v").alias("u")).join(bounds, "q").join(queries, "q")
        near = measure(front.hint("shuffle_hash").join(links, "u"))
        rows = beam.withColumn("done", F.lit(True)).unionByName(near.withColumn("done", F.lit(False)))
        rows = rows.groupBy("q", "v").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        last, beam = beam, stored(rows.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= most).drop("rank"), "beam")
        forget(last)
        if beam.where("not done").isEmpty():
            return beam.select("q", "v", "d")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, ``key``, score): the ``k`` nearest rows found for each query row, nearest first.

    Queries are the rows of ``vectors`` for which ``is_query`` (over the column ``id``, the key as a
    long) holds; every row but the query's own is a candidate. Score is the Euclidean distance of the
    original vectors in double precision; ties go to the smaller id. With fewer than ``k`` candidates
    all that the graph reaches are returned.

    Equal vectors are one node of the graph, known by its least id; since every id of a node is at the
    same distance, its ``k + 1`` least ids are all that an answer can need. Vectors that take no part
    are told in ``usable_vectors``; a query among them has no answer, and an empty table gives none.

    Graph and search measure the original vectors in double precision: floats travel as they are, other
    numbers as doubles moved by one power of two, which rounds nothing. So the answer is the ``k`` nearest
    of all that a search has met, however close they lie together or far one of them lies away.
    """
    spark = vectors.sparkSession
    rows = stored(usable_vectors(vectors, key, vector), "vectors")
    by_vector = Window.partitionBy("vector").orderBy("id")
    node = F.min("id").over(Window.partitionBy("vector"))
    least = rows.groupBy("vector").agg(F.min("id").alias("node"))
    plain = stored(least.select("node", "vector"), "nodes")
    members = rows.withColumn("rank", F.row_number().over(by_vector)).where(F.col("rank") <= k + 1)
    members = members.withColumn("node", node).select(F.col("node").alias("v"), "id")
    asked = rows.where(is_query).join(least, "vector").select(F.col("id").alias("query_id"), F.col("node").alias("q"))
    asked = stored(asked, "queries")

    exact = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType | T.ByteType | T.ShortType)  # as 32-bit floats
    kind, most = "f4" if exact else "f8", max(BEAM, 2 * k)
    n, largest = plain.agg(F.count("*"), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    bits = max(0, math.ceil(math.log2(max(n, 1) / BLOCK)))
    power = TOP if exact else math.frexp(largest or 1.0)[1]
    middle = plain.orderBy(_mixed_up("node", 11), "node").limit(CENTRE).toArrow().column("vector").to_pylist()
    # a median: one far vector does not move it; scaled before, as its sums could overflow
    centre = np.median(np.ldexp(middle, TOP - power), axis=0) if middle else np.zeros(0)
    nodes = stored(plain.mapInArrow(_coded(kind, TOP - power, bits, centre), "node bigint, code binary, keys array<bigint>"), "codes")
    graph, far = neighbour_graph(nodes, kind)
    links = _adjacency(graph, far, nodes).sortWithinPartitions("u").persist(StorageLevel.DISK_ONLY)  # the codes of all links are many times the vectors
    queries = stored(asked.select("q").distinct().join(nodes.select(F.col("node").alias("q"), "code"), "q"), "query-codes")
    beam = _search(queries, nodes, links, most, kind)
    links.unpersist()

    score = F.sqrt("d") * 2.0 ** (1 - TOP) * 2.0 ** (power - 1)
    first = Window.partitionBy("q").orderBy("score", "v")
    scored = beam.select("q", "v", score.alias("score")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
    scored = stored(scored.drop("rank"), "nearest-nodes")
    found = scored.join(members, "v").join(asked, "q").where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
