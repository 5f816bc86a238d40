import math

import numpy as np
from pyspark.sql import functions as F

from courtlake.llm import neighbours
from courtlake.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, id bigint, vector string, q string, node string"

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", None, "y") for i, v in rows], SCHEMA).repartition(2)


def exact(rows, k, queries):
    out = {}
    for q, x in rows:
        if q in queries:
            near = sorted((math.sqrt(math.fsum((a - b) ** 2 for a, b in zip(np.float32(x).tolist(), np.float32(y).tolist(), strict=True))), i) for i, y in rows if i != q)[:k]
            out[q] = near
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([sum(s <= near[-1][0] + 1e-9 for s, _ in got.get(q, [])) / len(near) for q, near in want.items()])


def test_recall_and_scores(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    asked = {i for i, _ in rows if i % 100 == 0}
    got, want = answers(neighbours.nearest(df, F.col("id") % 100 == 0)), exact(rows, 10, asked)
    assert set(got) == asked and all(len(x) == 10 for x in got.values()) and recall(got, want) >= 0.95
    table_ = dict(rows)
    for q, near in got.items():
        assert all(abs(s - math.dist(table_[q], table_[v])) < 1e-12 for s, v in near) and near == sorted(near)


def test_equal_vectors_and_ties(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(0, 300, 3)] + [(i, [1.0] * 8) for i in range(1, 300, 3)] + [(i, [-1.0] * 7 + [0.5]) for i in range(2, 20, 3)]
    got, want = answers(neighbours.nearest(vectors(spark, rows), F.col("id") < 30)), exact(rows, 10, {i for i, _ in rows if i < 30})
    near = lambda x: [(round(s, 6), i) for s, i in x]
    assert recall(got, want) >= 0.99 and sum(near(got[q]) == near(want[q]) for q in want) >= len(want) - 1
    assert [i for _, i in got[1]] == [4, 7, 10, 13, 16, 19, 22, 25, 28, 31]


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 2.0, 3.0])]
    rows += [(None, [5.0, 5.0]), (2, [0.0, 2.0]), (10, [0.0, -0.0, 0.0]), (11, [1.0, 0.0])]
    got = answers(neighbours.nearest(vectors(spark, rows), F.lit(True)))
    assert got == {1: [(0.0, 11), (math.sqrt(5), 2)], 2: [(math.sqrt(5), 1), (math.sqrt(5), 11)], 11: [(0.0, 1), (math.sqrt(5), 2)]}
    assert neighbours.nearest(vectors(spark, rows).limit(0), F.lit(True)).collect() == []
    assert answers(neighbours.nearest(vectors(spark, [(5, [1.0, 1.0])]), F.lit(True))) == {}
    assert answers(neighbours.nearest(vectors(spark, rows), F.lit(False))) == {}


def test_near_copies_and_a_far_component(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=64)
    base /= np.linalg.norm(base)
    family = [(i, (base + 1e-5 * draw.normal(size=64)).astype(np.float32).tolist()) for i in range(1500)]
    other = [(i, draw.normal(size=64).astype(np.float32).tolist()) for i in range(1500, 2000)]
    asked = set(range(0, 2000, 40))
    for far in ([], [(2000, [1e8] + [0.0] * 63)]):
        rows = family + other + far
        assert recall(answers(neighbours.nearest(vectors(spark, rows), F.col("id") % 40 == 0)), exact(rows, 10, asked)) >= 0.95


def test_doubles_of_any_size(spark):
    draw = np.random.default_rng(6)
    for size in (1e-200, 1.0, 1e308):
        rows = [(i, ((1 + 1e-12 * draw.normal(size=6)) * size).tolist()) for i in range(200)]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        got, numbers = answers(neighbours.nearest(df, F.col("id") < 5, k=3)), dict(rows)
        for q in range(5):
            want = sorted((math.dist(numbers[q], x), i) for i, x in rows if i != q)[:3]
            assert np.allclose([s / size for s, _ in got[q]], [s / size for s, _ in want], rtol=1e-9, atol=0)


def test_vectors_far_from_the_origin(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(i, (1000 + draw.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)] + [(1500, [1e8] * 16)]
    keys, run = [], neighbours.neighbour_graph
    monkeypatch.setattr(neighbours, "neighbour_graph", lambda nodes, x: (keys.extend(r["keys"] for r in nodes.collect()), run(nodes, x))[1])
    asked = set(range(0, 1500, 50))
    got = answers(neighbours.nearest(vectors(spark, rows), (F.col("id") % 50 == 0) & (F.col("id") < 1500)))
    assert recall(got, exact(rows, 10, asked)) >= 0.95
    assert all(len({k[t] for k in keys}) > 20 for t in range(neighbours.TABLES - 1))  # of 64 blocks
