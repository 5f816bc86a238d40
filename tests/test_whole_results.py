"""No value is capped, no row disappears uncounted, no feature sees its own label."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.functions import casting
from courtlake.operators import paging, quality
from courtlake.operators.grouped import zscores
from courtlake.plans import catalog, features, prediction, refresh
from courtlake.session import cut_lineage
from courtlake.sources import driver_tables as tables
from courtlake.sources.files import read_text_csv
from courtlake.sources.tables import Tables

ORDER = tables.PLAYER_GAME_ORDER


def test_rounding_has_no_bound(spark):
    values = [1e13, 123456789012345.5, -1e300, math.inf, -math.inf, math.nan, -0.0, None, 0.0000005, -2.5e-7, 0.0078125, 1 / 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.v for r in catalog.rounded(df).orderBy("i").collect()]
    want = [1e13, 123456789012345.5, -1e300, math.inf, -math.inf, math.nan, 0.0, None, 1e-6, 0.0, 0.007813, 0.333333]
    assert [str(x) for x in got] == [str(x) for x in want]


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (None, 5.0), (None, 7.0)], "g int, x double")
    got = sorted((str(r.g), round(r.x_z, 6)) for r in zscores(df, ["g"], ["x"]).collect())
    assert got == [("1", -0.707107), ("1", 0.707107), ("None", -0.707107), ("None", 0.707107)]


def test_dates_of_several_forms(spark):
    texts = ["2024-11-05T19:30:00", "2024-11-05 19:30:00", "11/5/2024", "11/05/2024 19:30", "11/5/2024 7:30 PM", "Nov 5, 2024", "5th of November", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(casting.timestamp(F.col("t"))).collect()]
    evening, day = dt.datetime(2024, 11, 5, 19, 30), dt.datetime(2024, 11, 5)
    assert got == [evening, evening, day, evening, evening, day, None, None]


def test_required_values_split_without_loss(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (None, None)], "k int, v string")
    usable, rejected = quality.split_required(df, ["k", "v"])
    assert (usable.count(), rejected.count()) == (1, 3)


def test_features_of_training_do_not_see_their_own_day(spark, folder):
    rows = cut_lineage(tables.player_games(spark, folder).where("person_id < 4"))
    chosen = rows.orderBy(F.col("person_id"), *[F.col(c).desc() for c in ORDER]).first()
    same = F.lit(True)
    for c in ("person_id", *ORDER):
        same = same & F.col(c).eqNullSafe(F.lit(chosen[c]))
    changed = rows.withColumns({c: F.when(same, F.col(c) + 1000).otherwise(F.col(c)) for c in ("points", "assists", "steals")})
    run = lambda df: features.player_features(df, ORDER, leak_free=True).where(same).collect()
    assert run(rows) == run(changed)
    day = F.to_date("game_date")
    before = lambda df: features.player_features(df, ORDER, leak_free=True).where(day <= F.lit(chosen["game_date"].date())).exceptAll
    assert before(rows)(features.player_features(changed, ORDER, leak_free=True)).where(day < F.lit(chosen["game_date"].date())).isEmpty()


def test_latest_features_are_the_last_of_all(spark, folder):
    rows = tables.player_games(spark, folder)
    newest = features.top_per_key(features.player_features(rows, ORDER), ["person_id"], [F.col(c).desc() for c in ORDER], 1)
    exact = lambda df: df.select("person_id", *ORDER, *[F.round(c, 6).alias(c) for c in features.PLAYER_FEATURES])
    got = features.latest_player_features(rows, ORDER)
    assert exact(got).exceptAll(exact(newest)).isEmpty() and got.count() == newest.count()


def test_latest_features_are_limited_before_the_shuffle(spark, folder):
    plan = features.latest_player_features(tables.player_games(spark, folder), ORDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_held_out_metrics(spark, folder):
    rows = tables.player_games(spark, folder)
    targets = {f"target_{t}": F.coalesce(F.col(t), F.lit(0)).cast("double") for t in features.PLAYER_TARGETS}
    # a column that tells the target: the model must beat the mean
    matrix = features.player_features(rows.withColumns(targets), ORDER, carry=tuple(targets)).withColumn("opp_def_rating", F.col("target_points"))
    matrix = cut_lineage(matrix)
    key = ["person_id", *ORDER]
    got = {r.target: r for r in prediction.player_model_metrics(prediction.fit_player_model(matrix, key), matrix, key).collect()}
    assert set(got) == set(features.PLAYER_TARGETS) and got["points"].value < 0.2 * got["points"].baseline
    assert got["points"].n == matrix.filter(~prediction.in_training(*key)).count()


@pytest.mark.parametrize("down", [False, True])
def test_pages_by_key_are_those_by_offset(spark, down):
    rows = [(i % 4 if i % 5 else None, i) for i in range(23)]
    df = spark.createDataFrame(rows, "a int, b int")
    keys = {"a": down, "b": not down}
    order = [F.col(c).desc() if d else F.col(c).asc() for c, d in keys.items()]
    last, at = None, 0
    while True:
        got = [tuple(r) for r in paging.page_after(df, keys, last, 4).collect()]
        assert got == [tuple(r)[:2] for r in paging.page(df, order, 4, at).collect()]
        if not got:
            break
        last, at = {"a": got[-1][0], "b": got[-1][1]}, at + 4
    assert at >= 23
    with pytest.raises(ValueError, match="invalid page"):
        paging.page_after(df, keys, None, 0)


def test_a_failed_write_or_swap_keeps_every_table(spark, tmp_path, monkeypatch):
    lake = Tables(spark, str(tmp_path))
    lake.replace_all({n: spark.range(i + 1) for i, n in enumerate("abc")}, "public")
    sizes = lambda: [lake.read("public", n).count() for n in "abc"]
    damaged = spark.range(3).selectExpr("1 / (id - 1) AS id")
    with pytest.raises(Exception, match="(?i)zero"):
        lake.replace_all({"a": spark.range(7), "b": spark.range(8), "c": damaged}, "public")
    assert sizes() == [1, 2, 3]
    point, calls = Tables._point, []

    def failing(self, folder, version):
        calls.append(folder)
        if len(calls) == 2:  # the second table cannot be pointed to its new version
            raise OSError("no rename today")
        point(self, folder, version)

    monkeypatch.setattr(Tables, "_point", failing)
    with pytest.raises(OSError, match="today"):
        lake.replace_all({n: spark.range(9) for n in "abc"}, "public")
    monkeypatch.undo()
    assert sizes() == [1, 2, 3] and sorted(p.name for p in (tmp_path / "public").iterdir()) == ["a", "b", "c"]


def test_backfill_counts_what_it_rejects(spark, tmp_path):
    history = tmp_path / "history"
    history.mkdir()
    files = {
        "Players.csv": "personId,firstName,lastName,birthdate,lastAttended,country,height,bodyWeight,guard,forward,center,draftYear,draftRound,draftNumber\n"
        "1,Ann,Lee,,,,,,,,,,,\n,No,Id,,,,,,,,,,,\n1,Ann,Lee,,,,,,,,,,,\n",
        "TeamHistories.csv": "teamId,teamCity,teamName,teamAbbrev,seasonFounded,seasonActiveTill,league\n10,Old,Owls,OLD,1950,2100,NBA\n11,Bay,Bats,BAY,1950,2100,NBA\n",
        "Games.csv": "gameId,gameDate,hometeamId,awayteamId,homeScore,awayScore,winner,gameType,attendance,arenaId,gameLabel,gameSubLabel,seriesGameNumber\n"
        "100,11/5/2024 7:30 PM,10,11,1,2,11,,,,,,\n101,some day,10,11,1,2,11,,,,,,\n",
    }
    stats = "assists,blocks,steals,fieldGoalsAttempted,fieldGoalsMade,fieldGoalsPercentage,threePointersAttempted,threePointersMade,threePointersPercentage,freeThrowsAttempted,freeThrowsMade,freeThrowsPercentage,reboundsDefensive,reboundsOffensive,reboundsTotal,foulsPersonal,turnovers,plusMinusPoints"
    empty = "," * stats.count(",")
    files["PlayerStatistics.csv"] = (
        f"playerteamCity,playerteamName,opponentteamCity,opponentteamName,personId,gameId,gameDate,win,home,numMinutes,points,{stats}\n"
        f"Old,Owls,Bay,Bats,1,100,2024-11-05,1,1,30,20,{empty}\nOld,Owls,Bay,Bats,1,100,2024-11-05,1,1,30,25,{empty}\nOld,Owls,Bay,Bats,1,101,one day,1,1,30,20,{empty}\n"
    )
    files["TeamStatistics.csv"] = f"gameId,teamId,opponentTeamId,gameDate,home,win,teamScore,opponentScore,{stats}\n100,10,11,2024-11-05,1,1,1,2,{empty}\n"
    for name, text in files.items():
        (history / name).write_text(text)
    assert read_text_csv(spark, str(history / "Games.csv")).count() == 2
    lake = Tables(spark, str(tmp_path / "lake"))
    assert refresh.backfill(spark, str(history), lake, 2025) == {"players": 1, "teams": 0, "games": 1, "player_statistics": 1, "team_statistics": 0}
    assert {n: lake.read("public", n).count() for n in schemas.SOURCE_TABLES} == {"players": 1, "teams": 2, "games": 1, "player_statistics": 1, "team_statistics": 1}
    assert lake.read("public", "player_statistics").first()["points"] == 25
    assert lake.read("public", "games").first()["game_date"] == dt.datetime(2024, 11, 5, 19, 30)


def test_facts_are_stored_and_read_by_season(spark, tmp_path):
    lake = Tables(spark, str(tmp_path))
    kinds = schemas.SOURCE_TABLES["games"]
    rows = spark.range(40).select(*[
        (F.col("id") if c.endswith("_id") and k == "bigint" else F.make_timestamp_ntz(F.lit(2000) + (F.col("id") % 4).cast("int"), *[F.lit(1)] * 2, *[F.lit(0)] * 3) if c == "game_date" else F.lit(None)).cast(k).alias(c)
        for c, k in kinds.items()
    ])
    lake.replace_all({"games": rows.withColumn(schemas.SEASON, F.year("game_date"))}, "public", {"games": [schemas.SEASON]})
    late = lake.read("public", "games", kinds, since_season=2002)
    assert late.columns == list(kinds) and late.count() == 20 and lake.read("public", "games", kinds).count() == 40
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
