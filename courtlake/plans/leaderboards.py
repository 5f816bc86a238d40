"""Leaders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake.functions.strings import contains_ignoring_case, strict_name
from courtlake.operators.paging import page, top
from courtlake.plans.lookups import player_card, team_card


def league_leaders(
    season_stats: DataFrame, stg_players: DataFrame, stg_teams: DataFrame, season: int, min_games: int = 20, n: int = 20
) -> DataFrame:
    """Top scorers of a season among players with more than ``min_games``, with nested cards."""
    eligible = season_stats.filter((F.col("season_year") == season) & (F.col("games_played") > min_games))
    order = [F.col("avg_points").desc(), F.col("person_id"), F.col("team_id")]
    leaders = top(
        eligible.select("person_id", "team_id", "games_played", "avg_points", "avg_assists", "avg_rebounds"), order, n
    )
    # At most n rows meet the dimensions. The joins may reorder them, hence the second sort of n rows.
    carded = leaders.join(player_card(stg_players), "person_id", "left").join(team_card(stg_teams), "team_id", "left")
    return top(carded, order, n)


def impact_leaders(player_value: DataFrame, season: int, n: int = 25) -> DataFrame:
    """Best rated players of a season."""
    if not 1 <= n <= 100:
        raise ValueError(f"n must be between 1 and 100, got {n}")
    chosen = player_value.filter(F.col("season_year") == season).select(
        "person_id", "full_name", "season_year", "primary_position", "player_impact_rating", "avg_ts_percentage"
    )
    return top(chosen, [F.col("player_impact_rating").desc(), F.col("person_id")], n)


def search_page(players: DataFrame, query: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """Players whose full name contains ``query``, ignoring case."""
    if len(query) < 2:
        raise ValueError("a search needs at least two characters")
    named = players.withColumn("full_name", strict_name(F.col("first_name"), F.col("last_name")))
    hits = named.filter(contains_ignoring_case(F.col("full_name"), query))
    return page(hits, [F.col("person_id")], limit, offset, max_limit=50)


def player_log_page(
    player_games: DataFrame, person_id: int, order: list[str], limit: int = 10, offset: int = 0
) -> DataFrame:
    """A player's games, newest first."""
    log = player_games.filter(F.col("person_id") == person_id)
    newest: list[Column] = [F.col(c).desc() for c in order]
    shown = ["points", "assists", "rebounds_total", "steals", "blocks", "turnovers", "plus_minus_points"]
    return page(log.select(*order, *shown), newest, limit, offset, max_limit=82)


def teams_page(stg_teams: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    shown = stg_teams.select("team_id", "full_name", "team_abbrev", "team_city", "team_name")
    return page(shown, [F.col("team_id")], limit, offset, max_limit=50)
