"""Search by grams and pages by ranges: the results of a scan, without one."""

import random

import pytest
from pyspark.sql import functions as F

from courtlake.operators import gram_index, page_index
from courtlake.operators.page_index import PageIndex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def names(spark):
    draw = random.Random(5)
    rows = [(n, "".join(draw.choice("aAbB é%_") for _ in range(draw.randrange(9)))) for n in range(400)]
    rows += [(1000, None), (1001, "ab"), (1002, "bab aba"), (1003, "abcabd"), (1004, "İstanbul"), (1005, "x" * 5000)]
    return spark.createDataFrame(rows, "k int, name string").repartition(4)


def test_search_by_grams_equals_the_scan(spark, names):
    rows = {r.k: r.name for r in names.collect()}
    index = gram_index.stored_postings(names, "k", "name")
    for query in ("ab", "AB", "bab", "a%", "__", "é ", "abcabd", "cab", "abcx", "xxx", "stan", "a b"):
        want = {k for k, v in rows.items() if v is not None and query.lower() in v.lower()}
        assert {r.k for r in gram_index.containing(names, index, "k", "name", query).collect()} == want, query
    with pytest.raises(ValueError, match="at least 2"):
        gram_index.containing(names, index, "k", "name", "a")


def test_search_reads_postings_by_gram(spark, names):
    index = gram_index.stored_postings(names, "k", "name")
    text = plan(gram_index.containing(names, index, "k", "name", "aba"))
    assert "Join" in text and "PushedFilters: [IsNotNull(gram), EqualTo(gram,aba)" in text
    assert gram_index.query_grams("Abab") == ["aba", "bab"] and gram_index.query_grams("AB") == ["ab"]
    one = names.where("k = 1005")
    assert gram_index.postings(one, "k", "name").count() == 2  # a gram counts once in a row


@pytest.mark.parametrize("per_range", [7, 100, 10**6])
def test_pages_equal_a_sorted_list(spark, per_range):
    draw = random.Random(per_range)
    rows = [(draw.choice([None, 1, 1, 1, 2, 3]), n) for n in range(300)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    order = [F.col("a").desc_nulls_last(), F.col("b")]
    index = PageIndex.build(df, order, per_range)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert index.total == 300 and index.starts[0][1] == 0
    for limit, offset in ((10, 0), (13, 95), (50, 280), (5, 300), (300, 0)):
        got = index.page(limit, offset).collect()
        assert [(r.a, r.b) for r in got] == want[offset : offset + limit] and all(r.total == 300 for r in got)
    with pytest.raises(ValueError, match="invalid page"):
        index.page(0)


def test_a_deep_page_reads_one_range(spark):
    index = PageIndex.build(spark.range(0, 200_000, 1, 4), [F.col("id")], 10_000)
    assert len(index.starts) == 20
    number, before, _ = index.starts[12]
    page = index.page(10, before + 100)
    assert index.ranges_of(10, before + 100) == [index.starts[12]] and [r.id for r in page.collect()] == list(range(before + 100, before + 110))
    assert "_range#" in plan(page) and f"= {number})" in plan(page).split("PartitionFilters: ")[1][:80]


def test_ranges_do_not_grow_with_the_table(spark, monkeypatch):
    """A file and a message to the driver for each range: many small ranges are stored as few, with the same pages."""
    monkeypatch.setattr(page_index, "MOST_RANGES", 6, raising=False)
    index = PageIndex.build(spark.range(0, 20_000, 1, 4).withColumn("k", F.col("id") % 9), [F.col("k").desc(), F.col("id")], 10)
    want = sorted(((n, n % 9) for n in range(20_000)), key=lambda r: (-r[1], r[0]))
    assert len(index.starts) <= 6 and index.total == 20_000
    edge = index.starts[2][1]
    for limit, offset in ((10, 0), (40, edge - 20), (40, edge), (9000, 4000), (500, 19_700), (5, 20_000)):
        got = index.page(limit, offset).collect()
        assert [(r.id, r.k) for r in got] == want[offset : offset + limit] and all(set(r.asDict()) == {"id", "k", "total"} for r in got)


def test_an_empty_table_has_empty_pages(spark):
    index = PageIndex.build(spark.range(0), [F.col("id")])
    assert index.total == 0 and index.page(5).collect() == []
