"""Daily JSON documents flattened to games, player rows and team rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.functions.calendar import instant
from courtlake.functions.casting import identifier, timestamp

GAME_TYPE = "Regular Season"  # fixed value: the type given to every daily game

# Short code of each statistic in the document.
STAT_CODES = {
    "AST": "assists", "REB": "rebounds_total", "STL": "steals", "BLK": "blocks",
    "FGM": "field_goals_made", "FGA": "field_goals_attempted",
    "FG3M": "three_pointers_made", "FG3A": "three_pointers_attempted",
    "FTM": "free_throws_made", "FTA": "free_throws_attempted",
    "PF": "fouls_personal", "TO": "turnovers",
}


def counted(path: str) -> Column:
    """A count from the document; 0 where it is absent."""
    return F.coalesce(F.col(path).try_cast("int"), F.lit(0))


def daily_games(documents: DataFrame) -> DataFrame:
    games = documents.select(F.inline("recent_games"))
    shaped = games.select(
        identifier(F.col("GAME_ID")).alias("game_id"),
        timestamp(F.col("GAME_DATE_EST")).alias("game_date"),
        identifier(F.col("HOME_TEAM_ID")).alias("home_team_id"),
        identifier(F.col("VISITOR_TEAM_ID")).alias("away_team_id"),
        F.col("PTS_HOME").try_cast("int").alias("home_score"),
        F.col("PTS_AWAY").try_cast("int").alias("away_score"),
        F.lit(GAME_TYPE).alias("game_type"),
    )
    return schemas.conform(shaped, schemas.GAMES)


def _entries(documents: DataFrame, part: str) -> DataFrame:
    """One row per entry of a box-score part, under its game id. An absent part has no rows."""
    boxes = documents.select(F.inline("boxscores"))
    return boxes.select(identifier(F.col("game_id")).alias("game_id"), F.explode(f"boxscore.{part}").alias("s"))


def _stats() -> list[Column]:
    return [counted(f"s.{code}").alias(name) for code, name in STAT_CODES.items()]


def _placed(rows: DataFrame, games: DataFrame, load_ts: dt.datetime) -> DataFrame:
    """Date and opponent from the games table; the load time stands in for an unknown game."""
    sides = games.select("game_id", F.col("game_date").alias("_played"), "home_team_id", "away_team_id")
    other = F.when(F.col("team_id") == F.col("home_team_id"), F.col("away_team_id")).when(
        F.col("team_id") == F.col("away_team_id"), F.col("home_team_id")
    )
    return rows.join(sides, "game_id", "left").withColumns(
        {
            "game_date": F.coalesce("_played", instant(load_ts)),
            "opponent_team_id": other,
            "created_at": instant(load_ts),
        }
    )


def daily_player_rows(documents: DataFrame, games: DataFrame, load_ts: dt.datetime) -> DataFrame:
    rows = _entries(documents, "PlayerStats").select(
        "game_id",
        identifier(F.col("s.PLAYER_ID")).alias("person_id"),
        identifier(F.col("s.TEAM_ID")).alias("team_id"),
        counted("s.PTS").alias("points"),
        counted("s.PLUS_MINUS").alias("plus_minus_points"),
        *_stats(),
    )
    shaped = _placed(rows, games, load_ts).withColumn("id", F.xxhash64("game_id", "person_id"))
    return schemas.conform(shaped, schemas.PLAYER_STATISTICS)


def daily_team_rows(documents: DataFrame, games: DataFrame, load_ts: dt.datetime) -> DataFrame:
    rows = _entries(documents, "TeamStats").select(
        "game_id",
        identifier(F.col("s.TEAM_ID")).alias("team_id"),
        counted("s.PTS").alias("team_score"),
        *_stats(),
    )
    shaped = _placed(rows, games, load_ts).withColumn("id", F.xxhash64("game_id", "team_id"))
    return schemas.conform(shaped, schemas.TEAM_STATISTICS)
