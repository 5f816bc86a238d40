"""Box-score metrics as column expressions over the player and game tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtlake.functions.numbers import ratio_or_zero, weighted_sum

# The weights of the game impact score and of the season rating.
FREE_THROW_POSSESSION = 0.44
IMPACT_WEIGHTS = {
    "points": 1.0,
    "rebounds_total": 0.8,
    "assists": 1.2,
    "steals": 1.5,
    "blocks": 1.1,
    "turnovers": -1.5,
}
MISSED_FIELD_GOAL_WEIGHT = -1.0
MISSED_FREE_THROW_WEIGHT = -0.5
RATING_WEIGHTS = {"avg_impact_per_min": 0.5, "avg_ts_percentage": 0.3, "avg_plus_minus": 0.2}
PER_MINUTES = 36
PROJECTION_SPREAD = 15.0


def _missed(kind: str) -> Column:
    return F.col(f"{kind}_attempted") - F.col(f"{kind}_made")


def true_shooting() -> Column:
    """Points per two scoring chances; 0 for a player who never shot."""
    chances = F.col("field_goals_attempted") + F.lit(FREE_THROW_POSSESSION) * F.col("free_throws_attempted")
    return ratio_or_zero(F.col("points"), 2 * chances)


def weighted_impact() -> Column:
    """Weighted box-score impact of one game."""
    terms = [(F.col(c), weight) for c, weight in IMPACT_WEIGHTS.items()]
    terms += [(_missed("field_goals"), MISSED_FIELD_GOAL_WEIGHT), (_missed("free_throws"), MISSED_FREE_THROW_WEIGHT)]
    return weighted_sum(terms)


def plain_impact_per_36() -> Column:
    """Unweighted impact scaled to 36 minutes; 0 without playing time."""
    gained = [F.col(c) for c in ("points", "rebounds_total", "assists", "steals", "blocks")]
    lost = [_missed("field_goals"), _missed("free_throws"), F.col("turnovers")]
    impact = weighted_sum([(c, 1.0) for c in gained] + [(c, -1.0) for c in lost])
    return ratio_or_zero(impact * PER_MINUTES, F.col("num_minutes"))


def primary_position() -> Column:
    """First set flag of guard, forward, center."""
    position = F.when(F.col("guard"), "Guard")
    for name in ("forward", "center"):
        position = position.when(F.col(name), name.capitalize())
    return position.otherwise("Unknown")


def winner_and_loser(strict: bool = False) -> tuple[Column, Column]:
    """Team ids of winner and loser.

    A tie or an unknown score counts as an away win. ``strict=True`` gives NULL instead
    when a score is missing.
    """
    home, away = F.col("home_team_id"), F.col("away_team_id")
    home_won = F.col("home_score") > F.col("away_score")
    winner = F.when(home_won, home).otherwise(away)
    loser = F.when(home_won, away).otherwise(home)
    if strict:
        played = home_won.isNotNull()
        winner, loser = F.when(played, winner), F.when(played, loser)
    return winner, loser


def prediction_confidence(probability: Column) -> Column:
    """0 for a coin flip, 1 for certainty."""
    return F.abs(probability - 0.5) * 2


def projection_confidence(spread: Column) -> Column:
    """1 for a steady scorer, falling to 0 at a deviation of 15 points."""
    return F.greatest(F.lit(0.0), 1 - spread / PROJECTION_SPREAD)
