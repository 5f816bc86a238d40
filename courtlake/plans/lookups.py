"""Lookups: profiles, rosters, games with their teams, head-to-head records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.functions.calendar import on_day
from courtlake.operators.skew import measured
from courtlake.session import cut_lineage

_PLAYER_CARD = (
    "person_id", "full_name", "primary_position", "height", "body_weight", "birthdate", "country",
    "draft_year", "draft_round", "draft_number",
)
_TEAM_CARD = ("team_id", "full_name", "team_abbrev", "team_city", "team_name")


def player_card(stg_players: DataFrame, name: str = "player") -> DataFrame:
    """``person_id`` with a struct of the player's profile."""
    return stg_players.select("person_id", F.struct(*_PLAYER_CARD).alias(name))


def team_card(stg_teams: DataFrame, name: str = "team", key: str = "team_id") -> DataFrame:
    """The team id, as ``key``, with a struct of the team's profile."""
    return stg_teams.select(F.col("team_id").alias(key), F.struct(*_TEAM_CARD).alias(name))


def player_profile(stg_players: DataFrame, person_id: int) -> DataFrame:
    return stg_players.filter(F.col("person_id") == person_id).select(*_PLAYER_CARD)


def games_with_teams(games: DataFrame, stg_teams: DataFrame) -> DataFrame:
    """Games with both teams nested; a game of an unknown team stays, with NULL there."""
    shown = games.select(
        "game_id", "game_date", "home_team_id", "away_team_id", "home_score", "away_score", "winning_team_id"
    )
    for side in ("home", "away"):
        shown = shown.join(team_card(stg_teams, f"{side}_team", f"{side}_team_id"), f"{side}_team_id", "left")
    return shown


def games_on_date(games: DataFrame, stg_teams: DataFrame, day: dt.date) -> DataFrame:
    return games_with_teams(games.filter(on_day(F.col("game_date"), day)), stg_teams)


def game_by_id(games: DataFrame, stg_teams: DataFrame, game_id: int) -> DataFrame:
    return games_with_teams(games.filter(F.col("game_id") == game_id), stg_teams)


def head_to_head_named(head_to_head: DataFrame, stg_teams: DataFrame) -> DataFrame:
    """Head-to-head records with both teams nested."""
    named = head_to_head
    for slot in ("team_1", "team_2"):
        named = named.join(team_card(stg_teams, slot, f"{slot}_id"), f"{slot}_id", "left")
    return named


def head_to_head_of(head_to_head: DataFrame, stg_teams: DataFrame, team_a: int, team_b: int) -> DataFrame:
    """The record of two teams, given in either order."""
    if team_a == team_b:
        raise ValueError("a team has no record against itself")
    low, high = sorted((team_a, team_b))
    chosen = head_to_head.filter((F.col("team_1_id") == low) & (F.col("team_2_id") == high))
    return head_to_head_named(chosen, stg_teams)


def team_roster(stg_player_games: DataFrame, stg_players: DataFrame) -> DataFrame:
    """For every team: the players seen in its latest season.

    Box scores are reduced to one row per team and player before anything else. That table
    gives both the latest season of a team and the players seen in it.
    """
    seen = cut_lineage(stg_player_games.groupBy("team_id", "person_id").agg(F.max("season_year").alias("season_year")))
    latest = seen.groupBy("team_id").agg(F.max("season_year").alias("season_year"))
    current = seen.join(measured(latest), ["team_id", "season_year"], "left_semi")
    return current.join(stg_players.select(*_PLAYER_CARD), "person_id")


def roster_of(stg_player_games: DataFrame, stg_players: DataFrame, team_id: int) -> DataFrame:
    return team_roster(stg_player_games.filter(F.col("team_id") == team_id), stg_players)
