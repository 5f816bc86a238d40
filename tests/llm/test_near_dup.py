import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlake.llm import components, near_dup
from courtlake.llm.words import WordHashes, alnum_words, blank_words, gram_hashes
from tests.llm.helpers import ALNUM_WORD, BLANK_WORD, ODD, documents, edited, groups, lower, sentence, shingles


def test_words_are_those_of_the_patterns():
    text = "Ab\x0bC\xa0d É1_2 \x1fx\x00y-z w\x85v\r\nQ"
    assert [w.decode() for w in blank_words(text)] == BLANK_WORD.findall(lower(text))
    assert [w.decode() for w in alnum_words(text)] == ALNUM_WORD.findall(lower(text))


def test_gram_hashes_depend_on_order_and_place_only_through_words():
    h = WordHashes().of([b"a", b"b", b"c", b"a", b"b", b"c", b"b", b"a", b"c"])
    g = gram_hashes(h, 3)
    assert g[0] == g[3] and g[0] != g[6] and len(g) == 7 and len(gram_hashes(h, 10)) == 0


def test_signature_is_unbiased():
    draw = np.random.default_rng(0)
    rates = []
    for _ in range(60):
        x = draw.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = x[:200], x[100:]  # Jaccard 1/3
        rates.append((near_dup.min_max_signature(a) == near_dup.min_max_signature(b)).mean())
    assert abs(np.mean(rates) - 1 / 3) < 0.02


@pytest.fixture(scope="module")
def family():
    """Loose documents, a crowded family of near copies at all distances, exact copies, and chains."""
    draw = random.Random(4)
    texts = [sentence(draw, draw.randrange(1, 60)) for _ in range(40)]
    base = sentence(draw, 120, 10**6)
    texts += [edited(draw, base, draw.randrange(0, 9)) for _ in range(150)]
    texts += [base.upper(), base.replace(" ", "\n"), texts[3], texts[3]]
    link = sentence(draw, 100, 10**6)
    for _ in range(12):
        link = edited(draw, link, 2)
        texts.append(link)
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_brute_force(spark, family, k):
    got = {r.doc_id: r for r in near_dup.near_duplicates(documents(spark, list(enumerate(family))), shingle=k).collect()}
    want = groups(family, k, 80)
    assert [got[i].component_id for i in range(len(family))] == want
    assert all(got[i].kept == (want[i] == i) and got[i].n_shingles == len(shingles(t, k)) for i, t in enumerate(family))


def test_one_document_of_each_component_stays(spark, family):
    kept = near_dup.without_near_duplicates(documents(spark, list(enumerate(family))))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups(family, 5, 80)))


def test_odd_rows(spark):
    df = documents(spark, ODD)
    rows = near_dup.near_duplicates(df, shingle=4).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == r.doc_id and r.kept
    assert {r.doc_id: r.n_shingles for r in rows}[1] == 0 and {r.doc_id: r.n_shingles for r in rows}[4] == 1
    kept = near_dup.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in {r[0] for r in ODD})


def test_null_keys_in_one_component_are_all_kept(spark):
    df = documents(spark, [(None, "one two three four five six"), (None, "one two three four five six"), (9, "seven"), (8, "seven")])
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [("8", "8", True), ("9", "8", False), ("None", "None", True), ("None", "None", True)]


def test_of_repeated_rows_one_stays_whatever_the_order(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, ""), (2, "")]
    df = documents(spark, rows).withColumn("n_chars", F.monotonically_increasing_id() % 7)
    for some in (df, df.repartition(5, "n_chars")):
        kept = near_dup.without_near_duplicates(some)
        assert kept.columns == df.columns
        got = sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=str)
        want = {(r.doc_id, r.text): [] for r in df.collect()}
        for r in df.collect():
            want[r.doc_id, r.text].append(r.n_chars)
        assert [g[:2] for g in got] == sorted(want, key=str) and all(g[2] == min(want[g[:2]]) for g in got)


def test_empty_table(spark):
    df = documents(spark, [])
    assert near_dup.near_duplicates(df).collect() == [] and near_dup.without_near_duplicates(df).collect() == []


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (300, 300)], "a int, b int")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}
