"""The jobs that run on a schedule: backfill, nightly refresh, training."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.functions import calendar
from courtlake.operators import quality
from courtlake.operators.keyed import latest_per_key
from courtlake.plans import features, impact, marts, prediction, staging
from courtlake.plans.daily_load import rebuild_filters
from courtlake.session import cut_lineage
from courtlake.sources.backfill import read_backfill
from courtlake.sources.tables import Tables

GAME_ORDER = ["game_date", "game_id"]


def backfill(spark: SparkSession, folder: str, tables: Tables, current_year: int) -> dict[str, int]:
    """Load the historical files; returns the number of rejected rows per table.

    All tables are written beside the live ones before any is swapped in, so a failed read leaves
    the live tables alone. Rows without a required value (an unreadable date is one) go to layer
    ``rejects``. Of rows that repeat a key the one with the highest values stays.
    """
    usable, rejected = {}, {}
    for name, df in read_backfill(spark, folder, current_year).items():
        complete, rejected[name] = quality.split_required(df, schemas.REQUIRED[name])
        key = schemas.KEYS[name]
        usable[name] = latest_per_key(complete, key, [F.col(c).desc() for c in df.columns if c not in key])
        if name in schemas.FACTS:
            usable[name] = usable[name].withColumn(schemas.SEASON, F.year("game_date"))
    by_season = {name: [schemas.SEASON] for name in schemas.FACTS}
    rebuild_filters(tables, usable, lambda: tables.replace_all(usable, "public", by_season))
    tables.replace_all(rejected, "rejects")
    return {name: tables.read("rejects", name).count() for name in rejected}


def staging_views(tables: Tables) -> dict[str, DataFrame]:
    source = {name: tables.read("public", name, schema) for name, schema in schemas.SOURCE_TABLES.items()}
    views = {
        "stg_games": staging.stg_games(source["games"]),
        "stg_player_statistics": staging.stg_player_games(source["player_statistics"]),
        "stg_team_statistics": staging.stg_team_games(source["team_statistics"]),
        "stg_players": staging.stg_players(source["players"]),
        "stg_teams": staging.stg_teams(source["teams"]),
    }
    tables.register_views("staging", views)
    return views


def refresh(tables: Tables, as_of: dt.date, load_ts: dt.datetime) -> DataFrame:
    """Rebuild all derived tables and return the data-test report.

    Order: base marts, then the rating, then the tables that use the rating, then the tests.
    Season tables are partitioned by season, so a reader of one season opens only its files.
    """
    views = staging_views(tables)
    players, player_games = views["stg_players"], views["stg_player_statistics"]

    def publish(df: DataFrame, name: str, by_season: bool = True) -> None:
        tables.replace(marts.stamped(df, load_ts), "marts", name, ["season_year"] if by_season else None)

    publish(marts.player_season_stats(player_games, players, views["stg_teams"]), "player_season_stats")
    publish(marts.team_season_stats(views["stg_team_statistics"]), "team_season_stats")
    publish(marts.head_to_head(views["stg_games"]), "head_to_head_stats", by_season=False)
    lately = tables.read("public", "player_statistics", schemas.PLAYER_STATISTICS, since_season=as_of.year - 1)
    recent = marts.recent_performance(staging.stg_player_games(lately), players, as_of, GAME_ORDER)
    publish(recent, "recent_player_performance", by_season=False)

    tables.replace(
        impact.player_impact_rating(player_games), "analytics", "analytics_player_impact_rating", ["season_year"]
    )
    rating = tables.read("analytics", "analytics_player_impact_rating")
    season_stats = tables.read("marts", "player_season_stats")
    publish(marts.player_value(players, rating), "player_value_analytics")
    tables.replace(marts.unified_player(season_stats, rating), "marts", "unified_player_analytics", ["season_year"])
    return data_tests(views["stg_games"], rating, players)


def data_tests(games: DataFrame, rating: DataFrame, players: DataFrame) -> DataFrame:
    check = quality.Check
    return quality.report(
        [
            check("not_null games.game_id", games, "not_null", "game_id"),
            check("unique games.game_id", games, "unique", "game_id"),
            check("not_null rating.person_id", rating, "not_null", "person_id"),
            check("not_null rating.season_year", rating, "not_null", "season_year"),
            check("relationships rating.person_id", rating, "relationships", "person_id", players, "person_id"),
        ]
    )


def train(tables: Tables, since: dt.date, model_root: str, **fit: int) -> list[prediction.Leg]:
    """Fit and save both models on box scores from ``since`` on; returns the legs of the game model's fit.

    ``fit`` may bound the game model's legs (see ``prediction.fit_best_game_model``).
    """
    def read(name: str) -> DataFrame:
        return tables.read("public", name, schemas.SOURCE_TABLES[name], since_season=since.year)

    games = read("games").filter(calendar.since(F.col("game_date"), since))
    team_rows = read("team_statistics").filter(calendar.since(F.col("game_date"), since))
    matrix = cut_lineage(features.prior_game_features(games, team_rows))
    model, legs = prediction.fit_best_game_model(matrix, **fit)
    prediction.save(model, f"{model_root}/game")

    players = tables.read("public", "players")
    rows = features.player_training_frame(read("player_statistics"), players, since)
    targets = {f"target_{t}": F.coalesce(F.col(t), F.lit(0)).cast("double") for t in features.PLAYER_TARGETS}
    past = features.player_features(rows.withColumns(targets), GAME_ORDER, leak_free=True, carry=tuple(targets))
    prediction.save(prediction.fit_player_model(cut_lineage(past), ["person_id", *GAME_ORDER]), f"{model_root}/player")
    return legs
