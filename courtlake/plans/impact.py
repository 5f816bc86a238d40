"""Player impact rating: season efficiency, standardised against the league."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.functions.boxscore import PER_MINUTES, RATING_WEIGHTS, true_shooting, weighted_impact
from courtlake.functions.numbers import ratio_of_sums, weighted_sum
from courtlake.operators.grouped import zscores
from courtlake.session import cut_lineage

METRICS = list(RATING_WEIGHTS)


def season_efficiency(stg_player_games: DataFrame) -> DataFrame:
    """Per player and season: mean impact per minute, shooting, plus-minus and per-36 rates.

    Games without playing time are left out.
    """
    played = stg_player_games.filter(F.col("num_minutes") > 0)
    per_36 = {"points_per_36": "points", "assists_per_36": "assists", "rebounds_per_36": "rebounds_total"}
    return played.groupBy("person_id", "season_year").agg(
        F.avg(weighted_impact() / F.col("num_minutes")).alias("avg_impact_per_min"),
        F.avg(true_shooting()).alias("avg_ts_percentage"),
        F.avg("plus_minus_points").alias("avg_plus_minus"),
        *[(ratio_of_sums(stat, "num_minutes") * PER_MINUTES).alias(name) for name, stat in per_36.items()],
    )


def season_scores(stg_player_games: DataFrame) -> DataFrame:
    """``season_efficiency`` with the z-score of each rated metric within its season.

    The per-season table is small beside the box scores and is needed twice, so it is
    written once: the box scores are read a single time.
    """
    seasons = cut_lineage(season_efficiency(stg_player_games))
    return zscores(seasons, ["season_year"], METRICS)


def player_impact_rating(stg_player_games: DataFrame) -> DataFrame:
    return rated(season_scores(stg_player_games))


def rated(scores: DataFrame) -> DataFrame:
    """The rating from season efficiency with z-scores."""
    rating = weighted_sum([(F.col(f"{metric}_z"), weight) for metric, weight in RATING_WEIGHTS.items()])
    return scores.select(
        "person_id",
        "season_year",
        rating.alias("player_impact_rating"),
        "points_per_36",
        "rebounds_per_36",
        "assists_per_36",
        "avg_ts_percentage",
    )
