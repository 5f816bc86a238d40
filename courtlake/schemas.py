"""Explicit column types of the source tables and of the raw inputs.

A table is a mapping of column name to SQL type. ``REQUIRED`` lists the columns that must be set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Schema = dict[str, str]


def _columns(*groups: tuple[str, str]) -> Schema:
    """Groups of ``(type, names)`` in order."""
    return {name: kind for kind, names in groups for name in names.split()}


_AUDIT = ("timestamp_ntz", "created_at updated_at")

PLAYERS = _columns(
    ("bigint", "person_id"),
    ("string", "first_name last_name"),
    ("timestamp_ntz", "birthdate"),
    ("string", "last_attended country"),
    ("double", "height body_weight"),
    ("boolean", "guard forward center"),
    ("int", "draft_year draft_round draft_number"),
    _AUDIT,
)

TEAMS = _columns(
    ("bigint", "team_id"),
    ("string", "team_city team_name team_abbrev"),
    ("int", "season_founded season_active_till"),
    ("string", "league"),
    _AUDIT,
)

GAMES = _columns(
    ("bigint", "game_id"),
    ("timestamp_ntz", "game_date"),
    ("bigint", "home_team_id away_team_id"),
    ("int", "home_score away_score"),
    ("bigint", "winning_team_id"),
    ("string", "game_type"),
    ("int", "attendance arena_id"),
    ("string", "game_label game_sub_label"),
    ("int", "series_game_number"),
    _AUDIT,
)

_SHARED_STATS = (
    ("int", "assists blocks steals field_goals_attempted field_goals_made"),
    ("double", "field_goals_percentage"),
    ("int", "three_pointers_attempted three_pointers_made"),
    ("double", "three_pointers_percentage"),
    ("int", "free_throws_attempted free_throws_made"),
    ("double", "free_throws_percentage"),
    ("int", "rebounds_defensive rebounds_offensive rebounds_total fouls_personal turnovers plus_minus_points"),
    ("timestamp_ntz", "created_at"),
)

PLAYER_STATISTICS = _columns(
    ("bigint", "id person_id game_id"),
    ("timestamp_ntz", "game_date"),
    ("bigint", "team_id opponent_team_id"),
    ("boolean", "win home"),
    ("double", "num_minutes"),
    ("int", "points"),
    *_SHARED_STATS,
)

TEAM_STATISTICS = _columns(
    ("bigint", "id game_id team_id opponent_team_id"),
    ("timestamp_ntz", "game_date"),
    ("boolean", "home win"),
    ("int", "team_score opponent_score"),
    *_SHARED_STATS,
)

SOURCE_TABLES = {
    "players": PLAYERS,
    "teams": TEAMS,
    "games": GAMES,
    "player_statistics": PLAYER_STATISTICS,
    "team_statistics": TEAM_STATISTICS,
}

REQUIRED = {
    "players": ["person_id", "first_name", "last_name"],
    "teams": ["team_id", "team_city", "team_name"],
    "games": ["game_id", "game_date", "home_team_id", "away_team_id"],
    "player_statistics": ["person_id", "game_id", "game_date", "team_id"],
    "team_statistics": ["game_id", "team_id", "game_date"],
}

KEYS = {
    "players": ["person_id"],
    "teams": ["team_id"],
    "games": ["game_id"],
    "player_statistics": ["game_id", "person_id"],
    "team_statistics": ["game_id", "team_id"],
}

#: Tables with one row per game and subject. They are stored by season: the year of the game.
FACTS = ("games", "player_statistics", "team_statistics")
SEASON = "season"

# Ids arrive as text or as numbers and statistics as whole or decimal numbers, so both are read
# in the wider type and cast when the document is flattened.
_STAT_CODES = ", ".join(
    f"{code}: DOUBLE" for code in "PTS AST REB STL BLK FGM FGA FG3M FG3A FTM FTA PF TO".split()
)

DAILY_DOCUMENT = f"""
    recent_games ARRAY<STRUCT<GAME_ID: STRING, GAME_DATE_EST: STRING, HOME_TEAM_ID: STRING,
        VISITOR_TEAM_ID: STRING, PTS_HOME: DOUBLE, PTS_AWAY: DOUBLE>>,
    boxscores ARRAY<STRUCT<game_id: STRING, extraction_date: STRING, boxscore: STRUCT<
        PlayerStats: ARRAY<STRUCT<PLAYER_ID: STRING, TEAM_ID: STRING, {_STAT_CODES}, PLUS_MINUS: DOUBLE>>,
        TeamStats: ARRAY<STRUCT<TEAM_ID: STRING, {_STAT_CODES}>>>>>,
    extraction_timestamp STRING"""


def conform(df: DataFrame, schema: Schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``schema`` in order, cast to their types; absent ones become typed NULLs.

    ``keep`` names further columns to carry along.
    """
    have = set(df.columns)
    shaped = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in schema.items()]
    return df.select(*shaped, *keep)


def as_ddl(schema: Schema) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in schema.items())
