"""Historical CSV files: reading, typing, and resolving team names to ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.functions import casting as cast
from courtlake.operators.keyed import build_lookup, latest_per_key, lookup_join
from courtlake.operators.skew import measured
from courtlake.sources.files import read_text_csv

Typing = Callable[[Column], Column]

LEAGUE = "NBA"  # fixed value: the league code in the team histories


def snake(header: str) -> str:
    """``fieldGoalsMade`` to ``field_goals_made``."""
    return "".join(f"_{ch.lower()}" if ch.isupper() else ch for ch in header)


@dataclass(frozen=True)
class CsvTable:
    """A CSV file and how each of its columns is typed.

    ``columns`` maps a header to its typing; the output name is the header in snake case unless
    ``renamed`` says otherwise.
    """

    file: str
    columns: dict[str, Typing]
    renamed: dict[str, str]

    def read(self, spark: SparkSession, folder: str) -> DataFrame:
        raw = read_text_csv(spark, f"{folder}/{self.file}")
        return self.typed(raw)

    def typed(self, raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return raw.select(
            *[how(F.col(h)).alias(self.renamed.get(h, snake(h))) for h, how in self.columns.items()], *keep
        )


def _flag_or_false(c: Column) -> Column:
    return cast.flag(c, missing=False)


def _trimmed(c: Column) -> Column:
    return F.trim(cast.text(c))


def _each(headers: str, how: Typing) -> dict[str, Typing]:
    return dict.fromkeys(headers.split(), how)


_COUNTS = (
    "assists blocks steals fieldGoalsAttempted fieldGoalsMade threePointersAttempted threePointersMade "
    "freeThrowsAttempted freeThrowsMade reboundsDefensive reboundsOffensive reboundsTotal foulsPersonal "
    "turnovers plusMinusPoints"
)
_SHARES = "fieldGoalsPercentage threePointersPercentage freeThrowsPercentage"
_STATS = _each(_COUNTS, cast.whole_or_zero) | _each(_SHARES, cast.number_or_zero)

PLAYERS = CsvTable(
    "Players.csv",
    _each("personId", cast.identifier)
    | _each("firstName lastName lastAttended country", cast.text)
    | _each("birthdate", cast.timestamp)
    | _each("height bodyWeight", cast.number)
    | _each("guard forward center", _flag_or_false)
    | _each("draftYear draftRound draftNumber", cast.whole),
    {},
)
TEAM_HISTORIES = CsvTable(
    "TeamHistories.csv",
    _each("teamId", cast.identifier)
    | _each("teamCity teamName league", cast.text)
    | _each("teamAbbrev", _trimmed)
    | _each("seasonFounded seasonActiveTill", cast.whole),
    {},
)
GAMES = CsvTable(
    "Games.csv",
    _each("gameId hometeamId awayteamId winner", cast.identifier)
    | _each("gameDate", cast.timestamp)
    | _each("homeScore awayScore attendance arenaId seriesGameNumber", cast.whole)
    | _each("gameType gameLabel gameSubLabel", cast.text),
    {"hometeamId": "home_team_id", "awayteamId": "away_team_id", "winner": "winning_team_id"},
)
PLAYER_STATISTICS = CsvTable(
    "PlayerStatistics.csv",
    _each("playerteamCity playerteamName opponentteamCity opponentteamName", cast.text)
    | _each("personId gameId", cast.identifier)
    | _each("gameDate", cast.timestamp)
    | _each("win home", cast.flag)
    | _each("numMinutes", cast.number_or_zero)
    | _each("points", cast.whole_or_zero)
    | _STATS,
    {
        "playerteamCity": "player_team_city", "playerteamName": "player_team_name",
        "opponentteamCity": "opponent_team_city", "opponentteamName": "opponent_team_name",
    },
)
TEAM_STATISTICS = CsvTable(
    "TeamStatistics.csv",
    _each("gameId teamId opponentTeamId", cast.identifier)
    | _each("gameDate", cast.timestamp)
    | _each("home win", cast.flag)
    | _each("teamScore opponentScore", cast.whole_or_zero)
    | _STATS,
    {},
)


def active_teams(histories: DataFrame, current_year: int, league: str = LEAGUE) -> DataFrame:
    """Entries of the league that were active in the previous year or later."""
    return histories.filter((F.col("league") == league) & (F.col("season_active_till") >= current_year - 1))


def current_teams(histories: DataFrame, current_year: int, league: str = LEAGUE) -> DataFrame:
    """One row per active team: its latest history entry."""
    latest = [F.col("season_active_till").desc(), F.col("team_city"), F.col("team_name")]
    return latest_per_key(active_teams(histories, current_year, league), ["team_id"], latest)


def team_lookup(histories: DataFrame, sequence: Column) -> DataFrame:
    """``(team_city, team_name)`` to ``team_id``; the entry latest in ``sequence`` wins."""
    return build_lookup(histories, ["team_city", "team_name"], "team_id", sequence)


def resolve_teams(player_rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Team and opponent names to ids; rows naming an unknown team are dropped."""
    for side, name in (("player_team", "team_id"), ("opponent_team", "opponent_team_id")):
        keys = {f"{side}_city": "team_city", f"{side}_name": "team_name"}
        player_rows = lookup_join(player_rows, lookup, keys, "team_id", name)
    return player_rows


def surrogate(df: DataFrame, *key: str) -> DataFrame:
    """A row id from the logical key: equal on every run, unlike a counter."""
    return df.withColumn("id", F.xxhash64(*key))


def _file_order() -> Column:
    """Position of a row in its file: split offset, then row within the split."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())


def read_backfill(spark: SparkSession, folder: str, current_year: int, league: str = LEAGUE) -> dict[str, DataFrame]:
    """The five source tables from a folder of historical files."""
    raw_histories = read_text_csv(spark, f"{folder}/{TEAM_HISTORIES.file}").withColumn("_line", _file_order())
    histories = TEAM_HISTORIES.typed(raw_histories, keep=("_line",))
    lookup = measured(team_lookup(histories, F.col("_line")))
    player_rows = resolve_teams(PLAYER_STATISTICS.read(spark, folder), lookup)
    team_rows = TEAM_STATISTICS.read(spark, folder)
    return {
        "players": schemas.conform(PLAYERS.read(spark, folder), schemas.PLAYERS),
        "teams": schemas.conform(current_teams(histories, current_year, league), schemas.TEAMS),
        "games": schemas.conform(GAMES.read(spark, folder), schemas.GAMES),
        "player_statistics": schemas.conform(
            surrogate(player_rows, "game_id", "person_id"), schemas.PLAYER_STATISTICS
        ),
        "team_statistics": schemas.conform(surrogate(team_rows, "game_id", "team_id"), schemas.TEAM_STATISTICS),
    }
