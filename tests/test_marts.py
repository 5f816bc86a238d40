"""Marts, ratings, form and features on hand-computed rows, and their invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.plans import features, impact, leaderboards, lookups, marts, staging
from courtlake.session import cut_lineage
from courtlake.sources import driver_tables as tables

DAY = dt.datetime(2024, 1, 10)


def frame(spark, schema, *rows):
    """Rows given as dicts; absent columns are NULL."""
    ddl = schemas.as_ddl(schema)
    return spark.createDataFrame([tuple(r.get(c) for c in schema) for r in rows], ddl)


def games(spark, *rows):
    columns = ("game_id", "home_team_id", "away_team_id", "home_score", "away_score")
    return frame(spark, schemas.GAMES, *[dict(zip(columns, r, strict=True)) | {"game_date": DAY} for r in rows])


BOX = {
    "num_minutes": 30.0, "points": 10, "rebounds_total": 4, "assists": 3, "steals": 1, "blocks": 0, "turnovers": 2,
    "field_goals_attempted": 8, "field_goals_made": 4, "three_pointers_attempted": 2, "three_pointers_made": 1,
    "free_throws_attempted": 2, "free_throws_made": 1, "plus_minus_points": 0, "team_id": 1, "opponent_team_id": 2,
}


def player_rows(spark, *rows):
    return frame(spark, schemas.PLAYER_STATISTICS, *[{"game_date": DAY, "game_id": n} | BOX | r for n, r in enumerate(rows)])


def ratings(spark, *rows):
    rated = impact.player_impact_rating(staging.stg_player_games(player_rows(spark, *rows)))
    return {r["person_id"]: r["player_impact_rating"] for r in rated.collect()}


def test_rating_of_two_players(spark):
    better = {"person_id": 1, "points": 20, "field_goals_made": 7, "plus_minus_points": 5}
    got = ratings(spark, better, {"person_id": 2})
    assert got[1] == pytest.approx(0.707107, abs=1e-6) and got[2] == pytest.approx(-0.707107, abs=1e-6)


def test_rating_edge_cases(spark):
    assert ratings(spark, {"person_id": 1}) == {1: 0.0}
    assert ratings(spark, {"person_id": 1}, {"person_id": 2}) == {1: 0.0, 2: 0.0}
    idle = ({"person_id": 3, "num_minutes": 0.0}, {"person_id": 4, "num_minutes": None})
    assert ratings(spark, {"person_id": 1}, *idle) == {1: 0.0}


def test_head_to_head(spark):
    rows = games(spark, (1, 1, 2, 100, 90), (2, 2, 1, 80, 95), (3, 1, 2, None, None))
    (got,) = marts.head_to_head(staging.stg_games(rows)).collect()
    assert (got["team_1_id"], got["team_2_id"], got["team_1_wins"], got["team_2_wins"]) == (1, 2, 2, 1)
    assert got["total_games"] == 3 and got["avg_margin"] == 12.5
    strict = marts.head_to_head(staging.stg_games(rows, strict=True)).first()
    assert (strict["team_1_wins"], strict["team_2_wins"], strict["total_games"]) == (2, 0, 2)


def test_team_season_record(spark):
    rows = [{"game_id": n, "team_id": 1, "game_date": DAY, "win": w} for n, w in enumerate((True, False, None))]
    got = marts.team_season_stats(staging.stg_team_games(frame(spark, schemas.TEAM_STATISTICS, *rows))).first()
    assert (got["games_played"], got["wins"], got["losses"]) == (3, 1, 1)
    assert got["win_percentage"] == pytest.approx(1 / 3)


def test_season_shooting_without_attempts_is_unknown(spark):
    rows = player_rows(spark, {"person_id": 1, "field_goals_attempted": 0, "field_goals_made": 0})
    staged = staging.stg_player_games(rows)
    assert staged.first()["fg_percentage_calculated"] == 0.0
    players = frame(spark, schemas.PLAYERS, {"person_id": 1, "first_name": "A", "last_name": "B"})
    teams = frame(spark, schemas.TEAMS, {"team_id": 1, "team_city": "C", "team_name": "D"})
    got = marts.player_season_stats(staged, staging.stg_players(players), staging.stg_teams(teams)).first()
    assert got["season_fg_percentage"] is None and (got["full_name"], got["team_name"]) == ("A B", "C D")


def log(spark, points, person=1):
    start = dt.datetime(2024, 1, 1)
    rows = [{"person_id": person, "points": p, "game_date": start + dt.timedelta(days=n)} for n, p in enumerate(points)]
    return player_rows(spark, *rows)


def test_player_form(spark):
    got = features.player_form(log(spark, range(1, 16)), ["game_date", "game_id"]).first()
    assert (got["recent_form"], got["latest_5_avg"], got["avg_points"], got["games"]) == (3.0, 13.0, 8.0, 15)
    assert features.player_form(log(spark, [1, 2, 3, 4]), ["game_date", "game_id"]).isEmpty()


def test_home_edge(spark):
    sides = [(10, True), (20, True), (5, False), (99, None)]
    rows = player_rows(spark, *[{"person_id": 1, "points": p, "home": h} for p, h in sides])
    got = features.player_features(rows, ["game_date", "game_id"]).first()
    assert got["home_away_diff"] == 10.0
    only_home = player_rows(spark, *[{"person_id": 1, "points": p, "home": True} for p in (1, 2)])
    assert features.player_features(only_home, ["game_date", "game_id"]).first()["home_away_diff"] == 0.0


def test_leak_free_features_ignore_the_row_itself(spark):
    rows = features.player_features(log(spark, [10, 20, 60]), ["game_date", "game_id"], leak_free=True)
    assert [r["points_5_game_avg"] for r in rows.orderBy("game_date").collect()] == [0.0, 10.0, 15.0]


def test_the_home_edge_shares_the_shuffle_by_player(spark, folder, monkeypatch):
    """No table of players and days, which is nearly as long as the rows; the same values as where timelines are cut."""
    rows = tables.player_games(spark, folder).filter("game_id % 4 < 2")
    rows = rows.withColumns({"person_id": F.when(F.col("game_id") % 3 != 0, F.col("person_id")), "game_date": F.when(F.col("k_part") % 11 != 0, F.col("game_date"))})
    rows, keys, earlier = cut_lineage(rows), [], features._earlier_days
    monkeypatch.setattr(features, "_earlier_days", lambda df, key, sums: (keys.append(key), earlier(df, key, sums))[1])
    order = tables.PLAYER_GAME_ORDER
    whole = cut_lineage(features.player_features(rows, order, leak_free=True))
    assert keys == ["opponent_team_id"] and whole.filter("home_away_diff <> 0").count() > 100
    in_blocks = features.player_features(rows, order, leak_free=True, floor_rows=20)
    assert keys[1:] == ["opponent_team_id", "person_id"]
    assert whole.count() == rows.count() and whole.exceptAll(in_blocks).isEmpty()


def test_prior_game_features_ignore_the_same_day(spark):
    rows = [
        {"game_id": n, "team_id": t, "game_date": DAY + dt.timedelta(days=d), "team_score": s, "win": s > 90}
        for n, t, d, s in ((1, 1, 0, 80), (1, 2, 0, 100), (2, 1, 1, 120), (2, 2, 1, 60))
    ]
    team_rows = frame(spark, schemas.TEAM_STATISTICS, *rows)
    played = frame(
        spark, schemas.GAMES,
        *[{"game_id": n, "game_date": DAY + dt.timedelta(days=d), "home_team_id": 1, "away_team_id": 2} for n, d in ((1, 0), (2, 1))],
    )
    got = {r["game_id"]: r for r in features.prior_game_features(played, team_rows).collect()}
    assert (got[1]["team_score_home"], got[2]["team_score_home"], got[2]["team_score_away"]) == (0.0, 80.0, 100.0)
    assert got[2]["win_away"] == 1.0
    assert len(features.GAME_FEATURES) == 24 and len(features.PLAYER_FEATURES) == 33


def test_recent_performance_splits_like_the_plain_window(spark, folder):
    staged = staging.stg_player_games(tables.player_games(spark, folder))
    players = staging.stg_players(tables.players(spark, folder))
    run = lambda rows: marts.recent_performance(
        staged, players, dt.date(2001, 6, 1), tables.PLAYER_GAME_ORDER, days=900, floor_rows=rows
    )
    plain, split = run(10**6), run(20)
    assert plain.count() == split.count() > 500
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_player_features_split_like_the_plain_window(spark, folder):
    rows = tables.player_games(spark, folder)
    run = lambda floor: features.player_features(rows, tables.PLAYER_GAME_ORDER, floor_rows=floor)
    plain, split = run(10**7), run(100)
    keep = ["person_id", *tables.PLAYER_GAME_ORDER]
    exact = lambda df: df.select(*keep, *[F.round(c, 6).alias(c) for c in features.PLAYER_FEATURES])
    assert exact(plain).exceptAll(exact(split)).isEmpty() and split.count() == plain.count() == rows.count()


def test_season_scores_are_standardised(spark, folder):
    scores = impact.season_scores(staging.stg_player_games(tables.player_games(spark, folder)))
    per_season = scores.groupBy("season_year").agg(
        F.avg("avg_plus_minus_z").alias("m"), F.stddev_samp("avg_plus_minus_z").alias("d")
    )
    for row in per_season.collect():
        assert row["m"] == pytest.approx(0, abs=1e-9) and row["d"] == pytest.approx(1, abs=1e-9)


def test_results_do_not_depend_on_partitioning(spark, folder):
    rows = tables.player_games(spark, folder)
    one, many = rows.coalesce(1), rows.repartition(13, "game_id")
    rate = lambda df: {
        (r["person_id"], r["season_year"]): round(r["player_impact_rating"], 9)
        for r in impact.player_impact_rating(staging.stg_player_games(df)).collect()
    }
    assert rate(one) == rate(many)


def test_records_add_up(spark, folder):
    pairs = marts.head_to_head(staging.stg_games(tables.games(spark, folder)))
    assert pairs.filter("team_1_id >= team_2_id or team_1_wins + team_2_wins <> total_games").isEmpty()
    teams = marts.team_season_stats(staging.stg_team_games(tables.team_games(spark, folder)))
    assert teams.filter("wins + losses > games_played").isEmpty()


def people(spark):
    return frame(
        spark, schemas.PLAYERS,
        {"person_id": 2544, "first_name": "LeBron", "last_name": "James"},
        {"person_id": 201939, "first_name": "Stephen", "last_name": "Curry"},
    )


def test_search(spark):
    found = leaderboards.search_page(people(spark), "LeBron").collect()
    assert [(r["full_name"], r["person_id"], r["total"]) for r in found] == [("LeBron James", 2544, 1)]
    with pytest.raises(ValueError, match="two characters"):
        leaderboards.search_page(people(spark), "L")


def test_pages_are_checked(spark):
    for bad in ({"limit": 0}, {"limit": 51}, {"limit": 5, "offset": -1}):
        with pytest.raises(ValueError, match="invalid page"):
            leaderboards.search_page(people(spark), "James", **bad)
    with pytest.raises(ValueError, match="between 1 and 100"):
        leaderboards.impact_leaders(people(spark), 2024, 101)


def test_unknown_profile_is_empty(spark):
    assert lookups.player_profile(staging.stg_players(people(spark)), 99).isEmpty()


def test_teams_page(spark):
    teams = frame(spark, schemas.TEAMS, {"team_id": 1610612738, "team_city": "Boston", "team_name": "Celtics"})
    got = leaderboards.teams_page(staging.stg_teams(teams)).first()
    assert (got["full_name"], got["total"]) == ("Boston Celtics", 1)


def test_head_to_head_of_a_team_with_itself(spark):
    with pytest.raises(ValueError, match="against itself"):
        lookups.head_to_head_of(None, None, 3, 3)


def test_roster_of_one_team(spark):
    old = {"person_id": 201939, "game_date": dt.datetime(2020, 1, 1)}
    rows = staging.stg_player_games(player_rows(spark, {"person_id": 2544}, {"person_id": 2544}, old))
    got = lookups.roster_of(rows, staging.stg_players(people(spark)), 1).collect()
    assert [(r["person_id"], r["season_year"]) for r in got] == [(2544, 2024)]


def test_game_with_unknown_team_stays(spark):
    teams = staging.stg_teams(frame(spark, schemas.TEAMS, {"team_id": 1, "team_city": "C", "team_name": "D"}))
    got = lookups.game_by_id(games(spark, (7, 1, 2, 90, 80)), teams, 7).first()
    assert got["home_team"]["full_name"] == "C D" and got["away_team"] is None
