"""Cleaned views over the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.functions.boxscore import plain_impact_per_36, primary_position, winner_and_loser
from courtlake.functions.calendar import day_of_week, season_year
from courtlake.functions.numbers import ratio_or_zero
from courtlake.functions.strings import joined_name

# Output name of each per-game shooting percentage.
_SHOOTING = {
    "fg_percentage_calculated": "field_goals",
    "three_pt_percentage_calculated": "three_pointers",
    "ft_percentage_calculated": "free_throws",
}


def stg_games(games: DataFrame, season_start_month: int = 1, strict: bool = False) -> DataFrame:
    """Games with season, calendar parts, winner, loser and score difference."""
    winner, loser = winner_and_loser(strict)
    derived = {
        "season_year": season_year(F.col("game_date"), season_start_month),
        "game_month": F.month("game_date"),
        "day_of_week": day_of_week(F.col("game_date")),
        "winning_team_id": winner,
        "losing_team_id": loser,
        "point_differential": F.abs(F.col("home_score") - F.col("away_score")),
    }
    return games.withColumns(derived)


def stg_player_games(player_games: DataFrame, season_start_month: int = 1) -> DataFrame:
    """Player box scores with season, per-game shooting and impact per 36 minutes."""
    shooting = {
        name: ratio_or_zero(F.col(f"{kind}_made"), F.col(f"{kind}_attempted")) for name, kind in _SHOOTING.items()
    }
    return player_games.withColumns(
        {"season_year": season_year(F.col("game_date"), season_start_month)}
        | shooting
        | {"impact_rating_per_36_min": plain_impact_per_36()}
    )


def stg_team_games(team_games: DataFrame, season_start_month: int = 1) -> DataFrame:
    return team_games.withColumn("season_year", season_year(F.col("game_date"), season_start_month))


def stg_players(players: DataFrame) -> DataFrame:
    """Players with full name and main position."""
    named = players.withColumns(
        {
            "full_name": joined_name(F.col("first_name"), F.col("last_name")),
            "primary_position": primary_position(),
        }
    )
    return named.drop("guard", "forward", "center")


def stg_teams(teams: DataFrame) -> DataFrame:
    return teams.withColumn("full_name", joined_name(F.col("team_city"), F.col("team_name")))
