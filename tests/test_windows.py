"""Window operators, and that splitting a crowded key changes nothing."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from courtlake.operators import skew
from courtlake.operators.grouped import zscores
from courtlake.operators.windows import history, history_columns, over_timeline, rest_days, rolling_means, slope_of, top_per_key

SCHEMA = "k long, at timestamp_ntz, seq long, v double, w double"


def timeline(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def series(values, k=1):
    start = dt.datetime(2024, 1, 1)
    return [(k, start + dt.timedelta(days=n), n, float(v), 0.0) for n, v in enumerate(values)]


def build_all(line):
    return [
        *history(line, ["v"], 5),
        *rolling_means(line.last(5), ["v"], "_mean5"),
        *rolling_means(line.last(10), ["v", "w"], "_mean10"),
        *rolling_means(line.prior(3), ["v"], "_prior3"),
        rest_days(line, "at").alias("rest"),
        line.position.alias("position"),
        line.recency.alias("recency"),
    ]


def windowed(df, floor_rows):
    built = over_timeline(df, ["k"], "at", ["at", "seq"], 10, build_all, floor_rows)
    trends = {"v_trend": slope_of("v", 0, 4), "v_prior_trend": slope_of("v", 1, 5)}
    return built.withColumns(trends).drop(*history_columns(["v"], 5))


def test_rolling_goldens(spark):
    rows = windowed(timeline(spark, series([3, 5, 4, 9, 1, 7])), 10**6).orderBy("seq").collect()
    assert [r["v_trend"] for r in rows][0] is None
    assert [r["v_trend"] for r in rows][1:] == pytest.approx([2.0, 0.5, 1.7, 0.0, 0.1])
    assert [r["v_mean5"] for r in rows] == pytest.approx([3, 4, 4, 5.25, 4.4, 5.2])
    assert [r["recency"] for r in rows] == [6, 5, 4, 3, 2, 1]


def test_unknown_values_are_skipped(spark):
    rows = windowed(timeline(spark, series([3, 5, 4, 9])).withColumn("v", F.when(F.col("seq") != 1, F.col("v"))), 10**6)
    got = rows.orderBy("seq").collect()
    assert [r["v_mean5"] for r in got] == pytest.approx([3, 3, 3.5, 16 / 3])
    assert got[1]["v_trend"] is None  # a single known value
    assert got[2]["v_trend"] == pytest.approx(0.5)  # values 3 and 4, two rows apart
    assert got[3]["v_trend"] == pytest.approx(np.polyfit([0, 2, 3], [3, 4, 9], 1)[0])


def test_rest_days_golden(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 23), 0, 0.0, 0.0), (1, dt.datetime(2024, 1, 3, 1), 1, 0.0, 0.0)]
    assert [r["rest"] for r in windowed(timeline(spark, rows), 10**6).orderBy("seq").collect()] == [2, 1]


def skewed_rows(seed, hot_days):
    """Key 0 holds over a third of the rows, in days of uneven size; some days are crowded."""
    rng = random.Random(seed)
    start, rows, seq = dt.datetime(2020, 1, 1), [], 0
    for day in range(hot_days):
        for _ in range(rng.choice([0, 1, 1, 2, 3, 25])):
            rows.append((0, start + dt.timedelta(days=day, hours=rng.randrange(24)), seq, rng.random() * 40, rng.random()))
            seq += 1
    crowded = len(rows)
    while len(rows) < 2 * crowded:
        at = start + dt.timedelta(days=rng.randrange(hot_days), hours=rng.randrange(24))
        rows.append((rng.randrange(1, 40), at, seq, rng.random() * 40, rng.random()))
        seq += 1
    return rows


def brute_force(rows):
    frame = pd.DataFrame(rows, columns=["k", "at", "seq", "v", "w"]).sort_values(["k", "at", "seq"])
    out = []
    for _, g in frame.groupby("k"):
        g = g.reset_index(drop=True)
        g["v_mean5"] = g["v"].rolling(5, min_periods=1).mean()
        g["v_mean10"] = g["v"].rolling(10, min_periods=1).mean()
        g["w_mean10"] = g["w"].rolling(10, min_periods=1).mean()
        g["v_prior3"] = g["v"].shift(1).rolling(3, min_periods=1).mean()
        g["v_trend"] = g["v"].rolling(5, min_periods=2).apply(lambda x: np.polyfit(range(len(x)), x, 1)[0])
        g["v_prior_trend"] = g["v_trend"].shift(1)
        g["rest"] = g["at"].diff().dt.days.fillna(2).astype("int64")
        g["position"] = range(1, len(g) + 1)
        g["recency"] = range(len(g), 0, -1)
        out.append(g)
    return pd.concat(out).sort_values("seq").reset_index(drop=True)


@pytest.mark.parametrize(("seed", "floor_rows"), [(1, 10), (2, 3), (3, 40), (4, 1), (5, 10**6)])
def test_split_timelines_match_brute_force(spark, seed, floor_rows):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = skewed_rows(seed, 90)
        got = windowed(timeline(spark, rows), floor_rows).toPandas().sort_values("seq").reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    expected = brute_force(rows)
    pd.testing.assert_frame_equal(got[expected.columns], expected, check_dtype=False, atol=1e-8)


def test_blocks_are_bounded_and_complete(spark):
    df = timeline(spark, skewed_rows(7, 200))
    hot = skew.HotKeys.find(df, ["k"], floor_rows=50)
    assert [r["k"] for r in hot.keys.collect()] == [0]
    placed = skew.place_in_blocks(df, ["k"], ["at", "seq"], 10, hot)
    own = placed.filter("not _halo")
    assert own.count() == df.count()
    largest = placed.filter("k = 0").groupBy("_block").count().agg(F.max("count")).first()[0]
    assert largest <= 1.5 * hot.rows_per_block + 10
    assert own.filter("k = 0").select("_block").distinct().count() > 3


def crowded_day(spark, rows, at):
    """One key holds nine tenths of the rows, all of one moment or without a date; a second key the rest."""
    seq = F.col("id")
    return spark.range(rows, numPartitions=6).select(
        F.when(seq % 10 != 0, 1).otherwise(2).cast("bigint").alias("k"), F.lit(at).cast("timestamp_ntz").alias("at"),
        (seq * 7919 % rows).alias("seq"), (seq * 31 % 97).cast("double").alias("v"), F.lit(0.0).alias("w"),
    )


@pytest.mark.parametrize("at", ["2024-01-05 19:30:00", None])
def test_one_key_on_one_day_runs_in_several_tasks(spark, at):
    df = crowded_day(spark, 1_000_000, at)
    got = windowed(df, 100_000).drop("rest")
    plain = windowed(df, 10**9).drop("rest")
    digest = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64(*[F.round(c, 6) if t == "double" else c for c, t in d.dtypes]))).first()
    assert digest(got) == digest(plain)
    placed = skew.place_in_blocks(df, ["k"], ["at", "seq"], 10, skew.HotKeys.find(df, ["k"], 100_000))
    sizes = {r["_block"]: r["count"] for r in placed.filter("k = 1").groupBy("_block").count().collect()}
    assert len(sizes) >= 7 and max(sizes.values()) < 250_000


@pytest.mark.parametrize("seed", [11, 12])
def test_ranges_shorter_than_the_reach(spark, seed):
    """Blocks of two or three rows: context comes from several ranges before."""
    rng = random.Random(seed)
    rows = [(None if n % 3 else 0, None if n % 4 == 0 else dt.datetime(2024, 1, 1 + n % 2), n, rng.random(), 0.0) for n in range(120)]
    df = timeline(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = windowed(df, 2).toPandas().sort_values("seq").reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = windowed(df, 10**9).toPandas().sort_values("seq").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, atol=1e-8)


def test_small_input_has_no_hot_keys(spark):
    assert skew.HotKeys.find(timeline(spark, series([1, 2, 3])), ["k"]) is None


def test_hot_keys_are_at_most_one_per_partition(spark):
    df = spark.range(10_000).select((F.col("id") % 100).alias("k"))
    hot = skew.HotKeys.find(df, ["k"], floor_rows=10)
    assert hot is None  # an even spread over more keys than partitions has no hot key


def test_frame_beyond_reach_is_refused(spark):
    with pytest.raises(ValueError, match="reach"):
        over_timeline(timeline(spark, series([1])), ["k"], "at", ["at"], 3, lambda line: [F.avg("v").over(line.last(5))])
    with pytest.raises(ValueError, match="reach"):
        over_timeline(timeline(spark, series([1])), ["k"], "at", ["at"], 3, lambda line: history(line, ["v"], 4))


def test_measured_join_is_the_same_both_ways(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    broadcast = big.join(skew.measured(small), "k")
    shuffled = big.join(skew.measured(small, max_rows=1), "k")
    assert "BroadcastHashJoin" in plan(broadcast)
    assert sorted(map(tuple, broadcast.collect())) == sorted(map(tuple, shuffled.collect()))


def test_wide_text_is_not_broadcast(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert skew.fits_broadcast(wide) and not skew.fits_broadcast(wide, max_bytes=5000)


def test_top_per_key_limits_before_the_shuffle(spark):
    df = timeline(spark, skewed_rows(9, 50))
    top = top_per_key(df, ["k"], [F.col("at").desc(), F.col("seq").desc()], 3)
    assert "WindowGroupLimit" in plan(top)
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3


def test_zscores(spark):
    rows = [("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 4.0, 1.0)]
    got = {(r["g"], r["x"]): r for r in zscores(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x", "y"]).collect()}
    assert got["a", 3.0]["x_z"] == pytest.approx(0.707107, abs=1e-6)
    assert got["a", 1.0]["x_z"] == pytest.approx(-0.707107, abs=1e-6)
    assert got["a", 1.0]["y_z"] == 0.0 and got["b", 4.0]["x_z"] == 0.0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
