"""Published tables: season, head-to-head, recent form and combined player analytics.

``calculated_at`` is not part of these frames; ``stamped`` adds it when a table is written.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.functions.calendar import instant, within_last_days
from courtlake.functions.numbers import ratio_of_sums
from courtlake.operators.skew import HOT_ROWS
from courtlake.operators.windows import over_timeline


def stamped(mart: DataFrame, load_ts: dt.datetime) -> DataFrame:
    return mart.withColumn("calculated_at", instant(load_ts))


def player_season_stats(stg_player_games: DataFrame, stg_players: DataFrame, stg_teams: DataFrame) -> DataFrame:
    """Per player, season and team: games, averages, shooting, totals.

    The names depend on the ids alone, so the box scores are reduced first and only the
    result meets the two dimensions.
    """
    averages = {
        "avg_minutes": "num_minutes", "avg_points": "points", "avg_assists": "assists",
        "avg_rebounds": "rebounds_total", "avg_steals": "steals", "avg_blocks": "blocks",
        "avg_turnovers": "turnovers", "avg_plus_minus": "plus_minus_points",
        "avg_impact_rating": "impact_rating_per_36_min",
    }
    shooting = {
        "season_fg_percentage": "field_goals", "season_3p_percentage": "three_pointers",
        "season_ft_percentage": "free_throws",
    }
    totals = {
        "total_points": "points", "total_assists": "assists", "total_rebounds": "rebounds_total",
        "total_steals": "steals", "total_blocks": "blocks",
    }
    seasons = stg_player_games.groupBy("person_id", "season_year", "team_id").agg(
        F.count(F.lit(1)).alias("games_played"),
        *[F.avg(c).alias(name) for name, c in averages.items()],
        *[ratio_of_sums(f"{kind}_made", f"{kind}_attempted").alias(name) for name, kind in shooting.items()],
        *[F.sum(c).alias(name) for name, c in totals.items()],
    )
    named = seasons.join(stg_players.select("person_id", "full_name"), "person_id")
    return named.join(stg_teams.select("team_id", F.col("full_name").alias("team_name")), "team_id")


def team_season_stats(stg_team_games: DataFrame) -> DataFrame:
    """Per team and season: record and averages. An unknown result is neither win nor loss."""
    averages = {
        "avg_points_scored": F.col("team_score"), "avg_points_allowed": F.col("opponent_score"),
        "avg_point_differential": F.col("team_score") - F.col("opponent_score"),
        "avg_assists": F.col("assists"), "avg_rebounds": F.col("rebounds_total"), "avg_steals": F.col("steals"),
        "avg_blocks": F.col("blocks"), "avg_turnovers": F.col("turnovers"),
    }
    return stg_team_games.groupBy("team_id", "season_year").agg(
        F.count(F.lit(1)).alias("games_played"),
        F.count_if("win").alias("wins"),
        F.count_if(~F.col("win")).alias("losses"),
        (F.count_if("win") / F.count(F.lit(1))).alias("win_percentage"),
        *[F.avg(c).alias(name) for name, c in averages.items()],
    )


def head_to_head(stg_games: DataFrame) -> DataFrame:
    """Per unordered pair of teams: wins of each, games, mean margin, last meeting."""
    pair = {"team_1_id": F.least("home_team_id", "away_team_id"), "team_2_id": F.greatest("home_team_id", "away_team_id")}
    decided = stg_games.filter(F.col("winning_team_id").isNotNull())
    return (
        decided.withColumns(pair)
        .groupBy(*pair)
        .agg(
            F.count_if(F.col("winning_team_id") == F.col("team_1_id")).alias("team_1_wins"),
            F.count_if(F.col("winning_team_id") == F.col("team_2_id")).alias("team_2_wins"),
            F.count(F.lit(1)).alias("total_games"),
            F.avg("point_differential").alias("avg_margin"),
            F.max("game_date").alias("last_meeting"),
        )
    )


def recent_performance(
    stg_player_games: DataFrame,
    stg_players: DataFrame,
    as_of: dt.date,
    order: list[str],
    days: int = 30,
    floor_rows: int = HOT_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Box scores of the last days with 10-game averages and a recency rank.

    The averages start inside the period. The player join follows the windows: it needs no
    particular distribution there, so adaptive execution may split a skewed key.
    """
    recent = stg_player_games.filter(within_last_days(F.col("game_date"), as_of, days))
    rated = recent.select(
        "person_id", "team_id", *order, "points", "assists", "rebounds_total", "steals", "blocks",
        "fg_percentage_calculated", "three_pt_percentage_calculated",
    )
    if probe is not None:
        probe = probe.filter(within_last_days(F.col("game_date"), as_of, days))
    averaged = {"points": "points_10_game_avg", "assists": "assists_10_game_avg", "rebounds_total": "rebounds_10_game_avg"}
    ranked = over_timeline(
        rated,
        ["person_id"],
        "game_date",
        order,
        reach=9,
        build=lambda line: [F.avg(c).over(line.last(10)).alias(name) for c, name in averaged.items()]
        + [line.recency.alias("recency_rank")],
        floor_rows=floor_rows,
        probe=probe,
    )
    return ranked.join(stg_players.select("person_id", "full_name"), "person_id")


def player_value(stg_players: DataFrame, rating: DataFrame) -> DataFrame:
    """Ratings with the player's name, position and draft."""
    who = stg_players.select("person_id", "full_name", "primary_position", "draft_year", "draft_number")
    return who.join(rating, "person_id")


def unified_player(season_stats: DataFrame, rating: DataFrame) -> DataFrame:
    """Season averages next to the impact rating, where there is one."""
    scores = rating.select("person_id", "season_year", F.col("player_impact_rating").alias("impact_score"))
    stats = season_stats.select(
        "person_id", "season_year", "full_name", "team_name", "avg_points", "avg_rebounds", "avg_assists"
    )
    return stats.join(scores, ["person_id", "season_year"], "left")
