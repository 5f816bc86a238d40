import math
import random
from collections import Counter

import numpy as np
import pytest

from courtlake.llm import ranking
from tests.llm.helpers import ALNUM_WORD, ODD, documents, lower


def plain(rows, items, k):
    """Score every document for every item."""
    terms = [Counter(ALNUM_WORD.findall(lower(r[1]))) for r in rows]
    n_docs, total = sum(1 for t in terms if t), sum(sum(t.values()) for t in terms)
    df = Counter(x for t in terms for x in t)
    out = []
    for item, text in set(items):
        scored = []
        for (key, *_), t in zip(rows, terms, strict=True):
            n = sum(t.values())
            m = 75 + 25 * n * n_docs // total if total else 0
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t[x] // (1000 * t[x] + 12 * m))
                for x, q in Counter(ALNUM_WORD.findall(lower(text))).items() if t[x]
            )
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, i, key, -score) for i, (score, _, _, key) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: f"w{int(draw.random() ** 3 * 60)}"
    rows = [(i, draw.choice([" ", "-", ", "]).join(word() for _ in range(draw.randrange(60)))) for i in range(150)]
    rows += [(900 + i, rows[3][1]) for i in range(40)]  # many ties
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, rows[5][1])]
    items = [(i, " ".join(word() for _ in range(draw.randrange(1, 25)))) for i in range(12)]
    items += [(100, rows[3][1]), (100, rows[3][1]), (100, "W1 w1 w1 é"), (101, None), (102, ""), (None, "w2 w3"), (103, "nowhere")]
    return rows, items


@pytest.mark.parametrize(("seed", "k", "shard"), [(1, 20, 50_000), (2, 5, 17), (3, 1, 3)])
def test_ranking_equals_scoring_everything(spark, monkeypatch, seed, k, shard):
    rows, items = corpus(seed)
    monkeypatch.setattr(ranking, "SHARD_DOCUMENTS", shard)
    monkeypatch.setattr(ranking, "FIRST_READ", 2)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    got = ranking.ranked_search(documents(spark, rows), queries, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, [x for x in items if x[1] is not None], k)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rows, items = corpus(4)
    monkeypatch.setattr(ranking, "QUERY_BYTES", 300)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    got = ranking.ranked_search(documents(spark, rows), queries, k=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, [x for x in items if x[1] is not None], 4)


def test_odd_rows_and_empty_tables(spark):
    items = [(1, "w0 w3918 word x no"), (2, None)]
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r) for r in ranking.ranked_search(documents(spark, ODD), queries).collect()), key=str)
    assert got == plain(ODD, items[:1], 20)
    assert ranking.ranked_search(documents(spark, []), queries).collect() == []
    assert ranking.ranked_search(documents(spark, ODD), queries.limit(0)).collect() == []
    assert ranking.ranked_search(documents(spark, [(1, None), (2, "")]), queries).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_intervals_resolve_scores_and_ties(monkeypatch, seed):
    """Random lists with many equal impacts, from one list to many, longer and shorter than a round."""
    monkeypatch.setattr(ranking, "FIRST_READ", 1 + seed % 5)
    draw = np.random.default_rng(seed)
    n, k = int(draw.integers(1, 400)), int(draw.integers(1, 25))
    lists = []
    for _ in range(int(draw.integers(1, 20))):
        documents_ = draw.permutation(n)[: int(draw.integers(1, n + 1))]
        impacts = np.sort(draw.integers(1, 2 + 6 * seed, len(documents_)))[::-1].astype(np.int64) * int(draw.integers(1, 9))
        lists.append((documents_, impacts))
    total = np.zeros(n, np.int64)
    for d, i in lists:
        np.add.at(total, d, i)
    want = [x for x in np.lexsort((np.arange(n), -total)).tolist() if total[x] > 0][:k]
    best, scores = ranking.resolved(lists, n, k)
    assert best.tolist() == want and scores.tolist() == total[want].tolist()


def test_reading_stops_early():
    """One document far ahead: the long list of small impacts is not read to its end."""

    class Counting(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counting.read = max(Counting.read, at.stop)
            return super().__getitem__(at)

    n = 40_000
    many = np.arange(n)
    lists = [(many[:3], np.array([10**9, 10**9, 10**9])), (many.view(Counting), np.r_[[10**6] * 3, np.arange(n - 3, 0, -1)])]
    best, _ = ranking.resolved(lists, n, 3)
    assert best.tolist() == [0, 1, 2] and Counting.read < 1000
