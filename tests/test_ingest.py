"""Backfill files, daily documents, replay, and the streaming drop."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.operators.keyed import build_lookup, insert_if_absent, latest_per_key
from courtlake.plans import refresh
from courtlake.plans.daily_load import load_documents
from courtlake.sources import backfill
from courtlake.sources.files import read_daily_documents, read_text_csv, write_daily_document
from courtlake.sources.tables import Tables
from courtlake.streaming.daily_drop import load_new_documents

NOW = dt.datetime(2024, 2, 1, 8)

STATS = (
    "numMinutes,points,assists,blocks,steals,fieldGoalsAttempted,fieldGoalsMade,fieldGoalsPercentage,"
    "threePointersAttempted,threePointersMade,threePointersPercentage,freeThrowsAttempted,freeThrowsMade,"
    "freeThrowsPercentage,reboundsDefensive,reboundsOffensive,reboundsTotal,foulsPersonal,turnovers,plusMinusPoints"
)
FILES = {
    "Players.csv": """personId,firstName,lastName,birthdate,lastAttended,country,height,bodyWeight,guard,forward,center,draftYear,draftRound,draftNumber
1,Ann,"Lee, Jr.",1999-05-01,,USA,75.0,190,True,False,,2020.0,1.0,N/A
2,Bo,Ray,,State,NaN,,,0,1,0,,,
""",
    "TeamHistories.csv": """teamId,teamCity,teamName,teamAbbrev,seasonFounded,seasonActiveTill,league
10,Old Town,Owls, OTO ,1950,1980,NBA
10,New Town,Owls,NTO,1981,2100,NBA
11,Bay,Bats,BAY,1990,2100,NBA
11,Bay,Bulls,BAB,1960,2023,NBA
12,Cape,Cats,CAP,1990,2100,ABA
13,Cape,Cats,CAP,1995,2100,ABA
""",
    "Games.csv": """gameId,gameDate,hometeamId,awayteamId,homeScore,awayScore,winner,gameType,attendance,arenaId,gameLabel,gameSubLabel,seriesGameNumber
100,2024-01-05 19:30:00,10,11,100.0,90.0,10,Regular Season,,5,,,
101,2024-01-07,11,10,,,,Preseason,18000,5,,,2
""",
    "PlayerStatistics.csv": f"""playerteamCity,playerteamName,opponentteamCity,opponentteamName,personId,gameId,gameDate,win,home,{STATS}
New Town,Owls,Bay,Bats,1,100,2024-01-05 19:30:00,1,1.0,33.5,21,abc,,2,15,8,0.533,4,2,0.5,4,3,0.75,5,1,6,2,3,-4
Nowhere,Owls,Bay,Bats,2,100,2024-01-05 19:30:00,1,1,10,2,0,0,0,1,1,1,0,0,0,0,0,0,0,0,0,0,0,0
Bay,Bats,Old Town,Owls,2,101,2024-01-07,,0,,2,0,0,0,1,1,1,0,0,0,0,0,0,0,0,0,0,0,0
""",
    "TeamStatistics.csv": f"""gameId,teamId,opponentTeamId,gameDate,home,win,teamScore,opponentScore,{STATS.removeprefix('numMinutes,points,')}
100,10,11,2024-01-05 19:30:00,1,1,100,90,20,3,7,80,40,0.5,30,10,0.333,12,10,0.833,30,10,40,18,11,10
""",
}


@pytest.fixture
def history(tmp_path):
    folder = tmp_path / "history"
    folder.mkdir()
    for name, text in FILES.items():
        (folder / name).write_text(text)
    return str(folder)


def rows_of(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_backfill(spark, history, tmp_path):
    tables = Tables(spark, str(tmp_path / "lake"))
    refresh.backfill(spark, history, tables, current_year=2025)

    players = rows_of(tables.read("public", "players"), "person_id")
    assert players[1]["last_name"] == "Lee, Jr." and players[1]["draft_year"] == 2020
    assert players[1]["draft_number"] is None and players[2]["country"] is None
    assert [players[1][f] for f in ("guard", "forward", "center")] == [True, False, False]
    assert players[1]["birthdate"] == dt.datetime(1999, 5, 1)

    teams = rows_of(tables.read("public", "teams"), "team_id")
    assert {k: t["team_city"] for k, t in teams.items()} == {10: "New Town", 11: "Bay"}
    assert teams[11]["team_name"] == "Bats" and teams[10]["team_abbrev"] == "NTO"

    games = rows_of(tables.read("public", "games"), "game_id")
    assert (games[100]["home_score"], games[100]["winning_team_id"], games[100]["attendance"]) == (100, 10, None)
    assert games[101]["home_score"] is None and games[101]["series_game_number"] == 2

    stats = rows_of(tables.read("public", "player_statistics"), "person_id")
    assert stats.keys() == {1, 2}  # the row of an unknown team is gone
    assert (stats[1]["team_id"], stats[1]["opponent_team_id"]) == (10, 11)
    assert (stats[2]["team_id"], stats[2]["opponent_team_id"]) == (11, 10)  # by a former name
    assert (stats[1]["assists"], stats[1]["blocks"], stats[1]["points"], stats[1]["plus_minus_points"]) == (0, 0, 21, -4)
    assert (stats[1]["win"], stats[2]["win"], stats[2]["home"], stats[2]["num_minutes"]) == (True, None, False, 0.0)

    team_rows = rows_of(tables.read("public", "team_statistics"), "team_id")
    assert (team_rows[10]["team_score"], team_rows[10]["rebounds_total"]) == (100, 40)
    for name, schema in schemas.SOURCE_TABLES.items():
        assert dict(tables.read("public", name, schema).dtypes) == schema


def test_backfill_twice_replaces(spark, history, tmp_path):
    tables = Tables(spark, str(tmp_path / "lake"))
    for _ in range(2):
        refresh.backfill(spark, history, tables, current_year=2025)
    assert tables.read("public", "players").count() == 2
    assert sorted(p.name for p in (tmp_path / "lake" / "public").iterdir()) == sorted(schemas.SOURCE_TABLES)


def test_lookup_takes_the_last_line(spark, history):
    raw = read_text_csv(spark, f"{history}/TeamHistories.csv").withColumn("_line", backfill._file_order())
    lookup = backfill.team_lookup(backfill.TEAM_HISTORIES.typed(raw, ("_line",)), F.col("_line"))
    assert lookup.filter("team_city = 'Cape'").first()["team_id"] == 13


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a\n2,1\n")
    assert read_text_csv(spark, str(tmp_path / "t.csv")).select("a").first()["a"] == "1"


def test_missing_flag_in_statistics_is_unknown(spark):
    raw = spark.createDataFrame([(None,), ("1.0",)], "home string")
    assert [r[0] for r in raw.select(backfill.PLAYER_STATISTICS.columns["home"](F.col("home"))).collect()] == [None, True]


def test_snake():
    assert backfill.snake("fieldGoalsPercentage") == "field_goals_percentage"


def box(person, **codes):
    return {"PLAYER_ID": person, "TEAM_ID": 10} | codes


def document(score=100, game="0000000100", extra=()):
    game_row = {
        "GAME_ID": game, "GAME_DATE_EST": "2024-01-05T00:00:00", "HOME_TEAM_ID": 10, "VISITOR_TEAM_ID": 11,
        "PTS_HOME": score, "PTS_AWAY": 90,
    }
    boxes = [
        {"game_id": game, "extraction_date": "2024-01-06", "boxscore": {
            "PlayerStats": [box(1, PTS=21, AST=3, PLUS_MINUS=4.0), box(2)],
            "TeamStats": [{"TEAM_ID": 10, "PTS": score, "REB": 40}, {"TEAM_ID": 11, "PTS": 90}],
        }},
        {"game_id": game, "extraction_date": "2024-01-06", "boxscore": {"TeamStats": []}},
        *extra,
    ]
    return {"todays_games": [{"x": 1}], "recent_games": [game_row] * 3, "boxscores": boxes, "extraction_timestamp": "now"}


def put(folder, name, doc):
    path = folder / name
    path.mkdir(parents=True)
    (path / "raw_data.json").write_text(json.dumps(doc))
    return str(path / "raw_data.json")


def counts(tables):
    return [tables.read("public", n).count() for n in ("games", "player_statistics", "team_statistics")]


def test_daily_document(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "lake"))
    load_documents(read_daily_documents(spark, put(tmp_path, "d1", document())), tables, NOW)
    assert counts(tables) == [1, 2, 2]
    game = tables.read("public", "games").first()
    assert (game["game_id"], game["home_score"], game["game_type"]) == (100, 100, "Regular Season")
    assert game["game_date"] == dt.datetime(2024, 1, 5)
    stats = rows_of(tables.read("public", "player_statistics"), "person_id")
    assert (stats[1]["points"], stats[1]["assists"], stats[1]["rebounds_total"], stats[1]["plus_minus_points"]) == (21, 3, 0, 4)
    assert (stats[1]["game_date"], stats[1]["opponent_team_id"], stats[1]["num_minutes"]) == (dt.datetime(2024, 1, 5), 11, None)
    teams = rows_of(tables.read("public", "team_statistics"), "team_id")
    assert (teams[10]["team_score"], teams[10]["rebounds_total"], teams[11]["opponent_team_id"]) == (100, 40, 10)


def test_replay_adds_nothing(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "lake"))
    first = put(tmp_path, "d1", document())
    for _ in range(2):
        load_documents(read_daily_documents(spark, first), tables, NOW)
    load_documents(read_daily_documents(spark, put(tmp_path, "d2", document(score=101))), tables, NOW)
    assert counts(tables) == [1, 2, 2]
    assert tables.read("public", "games").first()["home_score"] == 100  # the first load wins


def test_corrected_date_adds_nothing(spark, tmp_path):
    tables, wrong = Tables(spark, str(tmp_path / "lake")), document()
    for row in wrong["recent_games"]:
        row["GAME_DATE_EST"] = "2014-01-05T00:00:00"
    load_documents(read_daily_documents(spark, put(tmp_path, "d1", wrong)), tables, NOW)
    load_documents(read_daily_documents(spark, put(tmp_path, "d2", document())), tables, NOW)
    assert counts(tables) == [1, 2, 2]


def test_rows_without_a_key_are_left_out(spark, tmp_path):
    extra = [{"game_id": "100", "boxscore": {"PlayerStats": [box(None, PTS=9)]}}]
    tables = Tables(spark, str(tmp_path / "lake"))
    load_documents(read_daily_documents(spark, put(tmp_path, "d1", document(extra=extra))), tables, NOW)
    assert counts(tables) == [1, 2, 2]


def test_damaged_document_fails(spark, tmp_path):
    path = put(tmp_path, "bad", {})
    (tmp_path / "bad" / "raw_data.json").write_text('{"recent_games": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_daily_documents(spark, path).collect()


def test_document_sink(spark, tmp_path):
    docs = read_daily_documents(spark, put(tmp_path, "d1", document()))
    again = read_daily_documents(spark, write_daily_document(docs, str(tmp_path / "drop"), "2024-01-06"))
    assert again.select(F.size("recent_games")).first()[0] == 3


def test_streaming_drop(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "lake"))
    drop, checkpoint = tmp_path / "drop", str(tmp_path / "checkpoint")

    def run():
        load_new_documents(spark, str(drop), tables, checkpoint, now=lambda: NOW).awaitTermination(120)

    put(drop, "2024-01-06", document())
    run()
    assert counts(tables) == [1, 2, 2]
    run()  # nothing new
    put(drop, "2024-01-07", document(game="0000000099"))  # an earlier game, delivered late
    put(drop, "2024-01-08", document())  # a repeat
    run()
    assert counts(tables) == [2, 4, 4]


def test_insert_if_absent(spark):
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    existing = spark.createDataFrame([(2, "old"), (3, "old")], "k int, v string")
    got = insert_if_absent(batch, existing, ["k"], [F.col("v")]).collect()
    assert [tuple(r) for r in got] == [(1, "a")]


def test_insert_many_copies_of_one_key(spark):
    batch = spark.range(9000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), (-F.col("id")).alias("v"))
    existing = batch.filter("k >= 8000").repartition(4)
    got = insert_if_absent(batch, existing, ["k"], [F.col("v")])
    assert got.count() == 5001 and got.filter("k = 7").first()["v"] == -2999


def test_latest_and_lookup(spark):
    df = spark.createDataFrame([("x", 1, 10), ("x", 2, 20), ("y", 1, 30)], "k string, seq int, v int")
    assert {r["k"]: r["v"] for r in latest_per_key(df, ["k"], [F.col("seq").desc()]).collect()} == {"x": 20, "y": 30}
    assert {r["k"]: r["v"] for r in build_lookup(df, ["k"], "v", F.col("seq")).collect()} == {"x": 20, "y": 30}


def test_refresh_after_load(spark, history, tmp_path):
    tables = Tables(spark, str(tmp_path / "lake"))
    refresh.backfill(spark, history, tables, current_year=2025)
    load_documents(read_daily_documents(spark, put(tmp_path, "d1", document(game="102"))), tables, NOW)
    report = refresh.refresh(tables, as_of=dt.date(2024, 1, 10), load_ts=NOW)
    assert report.count() == 5 and report.filter("not passed").isEmpty()
    published = {p.name for p in (tmp_path / "lake" / "marts").iterdir()}
    assert published == {
        "player_season_stats", "team_season_stats", "head_to_head_stats", "recent_player_performance",
        "player_value_analytics", "unified_player_analytics",
    }
    assert tables.read("marts", "recent_player_performance").count() == 4
    assert tables.read("marts", "player_season_stats").first()["calculated_at"] == NOW
    # Daily rows have no minutes, so only the backfilled player is rated.
    assert [r["person_id"] for r in tables.read("analytics", "analytics_player_impact_rating").collect()] == [1]
    assert spark.table("staging_stg_games").count() == 3
