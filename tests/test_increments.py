"""Mergeable states, and marts kept up by loads."""

import datetime as dt
import random

from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.operators import states
from courtlake.plans import increments, refresh
from courtlake.plans.daily_load import load_documents
from courtlake.sources.files import read_daily_documents
from courtlake.sources.tables import Tables
from tests.test_ingest import NOW, document, history, put  # noqa: F401


def spec():
    return states.KeyedState(
        {"k": F.col("k")},
        [
            states.number("n"), states.number("big", F.col("v") > 5), states.total("total", F.col("v")), states.mean("mean", F.col("v")),
            states.ratio("share", F.col("v"), F.col("w"), 10.0), states.latest("last", F.col("at")),
        ],
    )


def test_states_of_any_split_finish_alike(spark):
    draw = random.Random(3)
    rows = [(draw.choice([1, 1, 1, 2, None]), draw.choice([None, 1, 4, 9]), draw.choice([0, 0, 2]), draw.randrange(50)) for _ in range(300)]
    df = spark.createDataFrame([*rows, (7, None, 0, None)], "k int, v int, w int, at int")
    whole = sorted(map(str, spec().finished(spec().state(df)).collect()))
    for parts in (2, 5):
        pieces = [df.filter(F.col("at") % parts == i) for i in range(parts)] + [df.filter("at is null")]
        state = spec().state(pieces[0])
        for piece in reversed(pieces[1:]):
            state = spec().added(state, piece)
        assert sorted(map(str, spec().finished(state).collect())) == whole
    plain = df.groupBy("k").agg(
        F.count("*").alias("n"), F.count_if(F.col("v") > 5).alias("big"), F.sum("v").alias("total"), F.avg("v").alias("mean"),
        (F.coalesce(F.sum("v"), F.lit(0)) / F.nullif(F.sum("w"), F.lit(0)) * 10.0).alias("share"), F.max("at").alias("last"),
    )
    assert sorted(map(str, plain.collect())) == whole
    nothing = {r["k"]: r for r in spec().finished(spec().state(df)).collect()}[7]
    assert (nothing["total"], nothing["mean"], nothing["share"], nothing["last"], nothing["n"]) == (None, None, None, None, 1)


def test_fewer_keys_merge_further(spark):
    two = states.KeyedState({"k": F.col("k"), "at": F.col("at")}, [states.number("n"), states.mean("mean", F.col("v"))])
    df = spark.createDataFrame([(1, 2, 10), (1, 4, 11), (2, 6, 10)], "k int, v int, at int")
    assert sorted(tuple(r) for r in two.finished(two.state(df), ["k"]).collect()) == [(1, 2, 3.0), (2, 1, 6.0)]


def day(game, year):
    doc = document(game=game)
    for row in doc["recent_games"]:
        row["GAME_DATE_EST"] = f"{year}-01-05T00:00:00"
    return doc


def published(tables, layer, name):
    df = tables.read(layer, name).drop("calculated_at")
    return sorted(str(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.asDict().items())) for r in df.collect())


MARTS = [("marts", "player_season_stats"), ("marts", "team_season_stats"), ("marts", "head_to_head_stats"), ("analytics", "analytics_player_impact_rating")]


def test_updates_equal_a_full_refresh_and_touch_only_their_seasons(spark, history, tmp_path):  # noqa: F811
    tables = Tables(spark, str(tmp_path / "lake"))
    refresh.backfill(spark, history, tables, current_year=2025)
    increments.rebuild(tables)
    assert increments.behind(tables) == []
    refresh.refresh(tables, as_of=dt.date(2024, 1, 10), load_ts=NOW)

    fresh = load_documents(read_daily_documents(spark, put(tmp_path, "d1", day("0000000555", 2021))), tables, NOW)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "lake" / "marts" / "team_season_stats").glob("version-*/season_year=2024/*")}
    old = files()
    changed = increments.update(tables, fresh, NOW)
    assert set(changed) == set(increments.STATES) and all(s == [2021] for s in changed.values())
    assert old and old == files()
    kept = {name: published(tables, *name) for name in MARTS}
    assert any("2021" in row for row in kept["marts", "team_season_stats"])
    refresh.refresh(tables, as_of=dt.date(2024, 1, 10), load_ts=NOW)
    assert {name: published(tables, *name) for name in MARTS} == kept

    # a replay adds nothing, and a load that broke off before its update is made good by the next
    again = load_documents(read_daily_documents(spark, put(tmp_path, "d2", day("0000000555", 2021))), tables, NOW)
    assert all(f.isEmpty() for f in again.values())
    load_documents(read_daily_documents(spark, put(tmp_path, "d3", day("0000000556", 2024))), tables, NOW)
    assert increments.behind(tables) == [2024]
    assert increments.update(tables, again, NOW)["player_season"] == [2024] and increments.behind(tables) == []
    seasons = tables.read("marts", "team_season_stats").filter("season_year = 2024").agg(F.sum("games_played")).first()[0]
    assert seasons == tables.read("public", "team_statistics").filter(F.col(schemas.SEASON) == 2024).count()


def test_unknown_keys_of_season_partitions(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    tables.replace_seasons(spark.createDataFrame([(2020, 1), (2021, 2)], "season int, v int"), "states", "t")
    tables.replace_seasons(spark.createDataFrame([(2021, 3)], "season int, v int"), "states", "t")
    assert sorted((r.season, r.v) for r in tables.read("states", "t").collect()) == [(2020, 1), (2021, 3)]
    assert tables.read("states", "t", seasons=[]).isEmpty() and tables.read("states", "t", seasons=[2020]).first().v == 1
