"""Marts kept up by increments: states per season, to which a load adds its own rows only.

A day's load reads the day's rows and the states of the seasons they fall in, and rewrites those seasons of
states and marts. The facts of earlier days are not read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.functions.boxscore import PER_MINUTES, true_shooting, weighted_impact
from courtlake.operators.grouped import zscores
from courtlake.operators.states import KeyedState, latest, mean, number, ratio, total
from courtlake.plans import impact, marts, staging
from courtlake.session import cut_lineage
from courtlake.sources.tables import Tables

# States are made by functions, since columns need a running session.
_c = F.col
_SHOTS = {"season_fg_percentage": "field_goals", "season_3p_percentage": "three_pointers", "season_ft_percentage": "free_throws"}


def player_season() -> KeyedState:
    return KeyedState(
        {"person_id": _c("person_id"), "season_year": _c("season_year"), "team_id": _c("team_id")},
        [
            number("games_played"),
            *[mean(f"avg_{name}", _c(c)) for name, c in {
                "minutes": "num_minutes", "points": "points", "assists": "assists", "rebounds": "rebounds_total", "steals": "steals",
                "blocks": "blocks", "turnovers": "turnovers", "plus_minus": "plus_minus_points", "impact_rating": "impact_rating_per_36_min",
            }.items()],
            *[ratio(name, _c(f"{kind}_made"), _c(f"{kind}_attempted")) for name, kind in _SHOTS.items()],
            *[total(f"total_{name}", _c(c)) for name, c in {"points": "points", "assists": "assists", "rebounds": "rebounds_total", "steals": "steals", "blocks": "blocks"}.items()],
        ],
    )


def team_season() -> KeyedState:
    return KeyedState(
        {"team_id": _c("team_id"), "season_year": _c("season_year")},
        [
            number("games_played"), number("wins", _c("win")), number("losses", ~_c("win")),
            *[mean(f"avg_{name}", c) for name, c in {
                "points_scored": _c("team_score"), "points_allowed": _c("opponent_score"), "point_differential": _c("team_score") - _c("opponent_score"),
                "assists": _c("assists"), "rebounds": _c("rebounds_total"), "steals": _c("steals"), "blocks": _c("blocks"), "turnovers": _c("turnovers"),
            }.items()],
        ],
    )


def head_to_head_state() -> KeyedState:
    """By season too, so that a load touches the pairs of its seasons only; the mart merges all seasons of a pair."""
    return KeyedState(
        {"season_year": _c("season_year"), "team_1_id": F.least("home_team_id", "away_team_id"), "team_2_id": F.greatest("home_team_id", "away_team_id")},
        [
            number("team_1_wins", _c("winning_team_id") == F.least("home_team_id", "away_team_id")),
            number("team_2_wins", _c("winning_team_id") == F.greatest("home_team_id", "away_team_id")),
            number("total_games"), mean("avg_margin", _c("point_differential")), latest("last_meeting", _c("game_date")),
        ],
        where=lambda games: games.filter(_c("winning_team_id").isNotNull()),
    )


def efficiency() -> KeyedState:
    return KeyedState(
        {"person_id": _c("person_id"), "season_year": _c("season_year")},
        [
            mean("avg_impact_per_min", weighted_impact() / _c("num_minutes")), mean("avg_ts_percentage", true_shooting()), mean("avg_plus_minus", _c("plus_minus_points")),
            *[ratio(f"{name}_per_36", _c(c), _c("num_minutes"), PER_MINUTES) for name, c in {"points": "points", "assists": "assists", "rebounds": "rebounds_total"}.items()],
        ],
        where=lambda rows: rows.filter(_c("num_minutes") > 0),
    )


STATES = {"player_season": player_season, "team_season": team_season, "head_to_head": head_to_head_state, "efficiency": efficiency}


def player_season_stats(state: DataFrame, stg_players: DataFrame, stg_teams: DataFrame) -> DataFrame:
    named = player_season().finished(state).join(stg_players.select("person_id", "full_name"), "person_id")
    return named.join(stg_teams.select("team_id", F.col("full_name").alias("team_name")), "team_id")


def team_season_stats(state: DataFrame) -> DataFrame:
    return team_season().finished(state).withColumn("win_percentage", F.col("wins") / F.col("games_played"))


def head_to_head(state: DataFrame) -> DataFrame:
    return head_to_head_state().finished(state, ["team_1_id", "team_2_id"])


def player_impact_rating(state: DataFrame) -> DataFrame:
    """The rating from the state: scores are within a season, so whole seasons are needed, but no box score."""
    return impact.rated(zscores(cut_lineage(efficiency().finished(state)), ["season_year"], impact.METRICS))


def staged(facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows for each state from rows of the fact tables."""
    players = staging.stg_player_games(facts["player_statistics"])
    return {
        "player_season": players, "efficiency": players,
        "team_season": staging.stg_team_games(facts["team_statistics"]), "head_to_head": staging.stg_games(facts["games"]),
    }


def add_rows(tables: Tables, fresh: dict[str, DataFrame]) -> dict[str, list[int]]:
    """Add rows that a load has appended to the states; returns the seasons that changed, per state.

    A season whose state does not count as many rows as the facts then hold (a load that broke off in
    between) is made anew from that season's facts, so a state is never behind or counted twice.
    """
    changed = {}
    for name, rows in staged(fresh).items():
        spec = STATES[name]()
        touched = [r["season_year"] for r in rows.select("season_year").distinct().collect()]
        if touched:
            old = tables.read("states", name, seasons=touched) if tables.exists("states", name) else None
            new = spec.state(rows) if old is None else spec.merged(old.drop(schemas.SEASON).unionByName(spec.state(rows)))
            tables.replace_seasons(cut_lineage(new.withColumn(schemas.SEASON, F.col("season_year"))), "states", name)
        changed[name] = touched
    return changed


def behind(tables: Tables) -> list[int]:
    """Seasons whose player or team states count other numbers of rows than the facts hold. Only counts are read."""
    odd: set[int] = set()
    for name, fact in (("player_season", "player_statistics"), ("team_season", "team_statistics")):
        if tables.exists("public", fact):
            have = tables.read("public", fact).groupBy(schemas.SEASON).agg(F.count("*").alias("rows"))
            if tables.exists("states", name):
                kept = tables.read("states", name).groupBy(schemas.SEASON).agg(F.sum("games_played__n").alias("counted"))
                have = have.join(kept, schemas.SEASON, "full").where(~F.col("rows").eqNullSafe(F.col("counted")))
            odd |= {r[schemas.SEASON] for r in have.collect()}
    return sorted(odd)


def rebuild(tables: Tables, seasons: list[int] | None = None) -> None:
    """Make the states of some seasons, or of all, anew from the facts."""
    facts = {name: tables.read("public", name, schemas.SOURCE_TABLES[name], seasons=seasons) for name in schemas.FACTS}
    for name, rows in staged(facts).items():
        tables.replace_seasons(cut_lineage(STATES[name]().state(rows).withColumn(schemas.SEASON, F.col("season_year"))), "states", name)


def update(tables: Tables, fresh: dict[str, DataFrame], load_ts: dt.datetime) -> dict[str, list[int]]:
    """After a load: add its rows to the states and rewrite the marts of the seasons they fall in.

    Returns the seasons rewritten, per state. Seasons found behind are rebuilt first and rewritten too.
    """
    changed = add_rows(tables, fresh)
    late = behind(tables)
    if late:
        rebuild(tables, late)
        changed = {name: sorted({*seasons, *late}) for name, seasons in changed.items()}

    def state(name: str) -> DataFrame:
        return tables.read("states", name, seasons=changed[name]).drop(schemas.SEASON)

    def publish(mart: DataFrame, layer: str, name: str) -> None:
        tables.replace_seasons(mart, layer, name, by="season_year")

    players = staging.stg_players(tables.read("public", "players", schemas.PLAYERS))
    teams = staging.stg_teams(tables.read("public", "teams", schemas.TEAMS))
    if changed["player_season"]:
        publish(marts.stamped(player_season_stats(state("player_season"), players, teams), load_ts), "marts", "player_season_stats")
        publish(player_impact_rating(state("efficiency")), "analytics", "analytics_player_impact_rating")
    if changed["team_season"]:
        publish(marts.stamped(team_season_stats(state("team_season")), load_ts), "marts", "team_season_stats")
    if changed["head_to_head"]:
        pairs = head_to_head(tables.read("states", "head_to_head").drop(schemas.SEASON))
        tables.replace(marts.stamped(pairs, load_ts), "marts", "head_to_head_stats")
    return changed
