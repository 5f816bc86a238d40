"""Data tests on seeded bad rows."""

import pytest

from courtlake.operators import quality


def test_relationships(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert [tuple(r) for r in quality.orphaned_values(child, "k", parent, "id").collect()] == [(2, 2)]


def test_unique(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (3,)], "k int")
    assert [tuple(r) for r in quality.repeated_values(df, "k").collect()] == [(1, 2)]


def test_report(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (None, 3)], "k int, v int")
    parent = spark.createDataFrame([(2,)], "id int")
    check = quality.Check
    got = quality.report(
        [
            check("k set", df, "not_null", "k"), check("v set", df, "not_null", "v"),
            check("k unique", df, "unique", "k"), check("v unique", df, "unique", "v"),
            check("v known", df, "relationships", "v", parent, "id"),
        ]
    )
    assert {r["check_name"]: (r["failures"], r["passed"]) for r in got.collect()} == {
        "k set": (1, False), "v set": (1, False), "k unique": (1, False), "v unique": (0, True), "v known": (1, False),
    }


def test_unknown_kind(spark):
    with pytest.raises(ValueError, match="unknown kind"):
        quality.Check("x", spark.range(1), "odd", "id").failures()
