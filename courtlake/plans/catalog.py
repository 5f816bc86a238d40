"""The registered queries: each plan applied to the driver tables.

Doubles are rounded to six places here, for comparison only; the plans do not round.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.functions.calendar import instant
from courtlake.functions.casting import number_or_zero, whole
from courtlake.functions.strings import strict_name
from courtlake.operators import gram_index, key_filter, keyed, page_index, paging, quality, states
from courtlake.operators.skew import measured
from courtlake.plans import features, impact, increments, leaderboards, lookups, marts, prediction, staging
from courtlake.plans.linear import LinearTargets
from courtlake.plans.scaling import ColumnScaler
from courtlake.session import cut_lineage, scratch_folder, tune
from courtlake.sources import daily, rejects
from courtlake.sources import driver_tables as tables
from courtlake.sources.backfill import LEAGUE, active_teams, team_lookup
from courtlake.sources.daily import counted
from courtlake.sources.files import read_daily_documents, write_daily_document

Query = Callable[[SparkSession, str], DataFrame]

ORDER = tables.PLAYER_GAME_ORDER
AS_OF = dt.date(2001, 6, 1)
SEASON = 1998
TRAIN_SINCE = dt.date(1998, 1, 1)
LOADED_UNTIL = dt.datetime(2000, 1, 1)
LOADED_AT = dt.datetime(2002, 3, 4, 5, 6, 7)

_CARD = ["height", "body_weight", "country", "draft_year", "draft_round", "draft_number"]
_QUERIES: dict[str, Query] = {}


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    _QUERIES[fn.__name__] = lambda spark, folder: fn(Inputs(tune(spark), folder))
    return fn


class Inputs:
    """The box-score tables and staging views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.folder, name)

    @property
    def teams(self) -> DataFrame:
        return tables.teams(self.spark, self.folder)

    @property
    def players(self) -> DataFrame:
        return tables.players(self.spark, self.folder)

    @property
    def games(self) -> DataFrame:
        return tables.games(self.spark, self.folder)

    @property
    def player_games(self) -> DataFrame:
        return tables.player_games(self.spark, self.folder)

    @property
    def player_keys(self) -> DataFrame:
        return tables.player_game_keys(self.spark, self.folder)

    @property
    def team_games(self) -> DataFrame:
        return tables.team_games(self.spark, self.folder)

    @property
    def stg_teams(self) -> DataFrame:
        return staging.stg_teams(self.teams)

    @property
    def stg_players(self) -> DataFrame:
        return staging.stg_players(self.players)

    @property
    def stg_games(self) -> DataFrame:
        return staging.stg_games(self.games)

    @property
    def stg_player_games(self) -> DataFrame:
        return staging.stg_player_games(self.player_games)

    @property
    def stg_team_games(self) -> DataFrame:
        return staging.stg_team_games(self.team_games)

    @property
    def rating(self) -> DataFrame:
        return impact.player_impact_rating(self.stg_player_games)

    @property
    def season_stats(self) -> DataFrame:
        return marts.player_season_stats(self.stg_player_games, self.stg_players, self.stg_teams)


def _six_places(c: str) -> Column:
    """Six decimal places, half away from zero, and no negative zero; any magnitude, infinity and NaN."""
    return (F.round(c, 6) + F.lit(0.0)).alias(c)


def rounded(df: DataFrame, *exact: str) -> DataFrame:
    """Doubles to six places, but for the columns named."""
    return df.select(*[_six_places(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes])


def chosen(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.select(*names))


# --- staging -------------------------------------------------------------------------------------


@query
def stg_games(i: Inputs) -> DataFrame:
    return i.stg_games.select(
        "game_id", "game_date", "season_year", "game_month", "day_of_week", "home_team_id", "away_team_id",
        "home_score", "away_score", "winning_team_id", "losing_team_id", "point_differential",
    )


@query
def stg_player_games(i: Inputs) -> DataFrame:
    staged = i.stg_player_games.select(
        "person_id", *ORDER, "season_year", "team_id", "opponent_team_id", "win", "home", "num_minutes", "points",
        "assists", "blocks", "steals", "field_goals_attempted", "field_goals_made", "three_pointers_attempted",
        "three_pointers_made", "free_throws_attempted", "free_throws_made", "rebounds_defensive",
        "rebounds_offensive", "rebounds_total", "fouls_personal", "turnovers", "plus_minus_points",
        "fg_percentage_calculated", "three_pt_percentage_calculated", "ft_percentage_calculated",
        "impact_rating_per_36_min",
    )
    return rounded(staged, *ORDER, "num_minutes")


def _rows(df: DataFrame) -> DataFrame:
    """Row-level player output: everything rounded but the ordering columns."""
    return rounded(df, *ORDER)


@query
def stg_team_games(i: Inputs) -> DataFrame:
    return chosen(
        i.stg_team_games, "game_id", "game_date", "season_year", "team_id", "opponent_team_id", "home", "win",
        "team_score", "opponent_score", "assists", "blocks", "steals", "rebounds_total", "turnovers",
        "field_goals_percentage", "three_pointers_percentage", "free_throws_percentage",
    )


@query
def stg_players(i: Inputs) -> DataFrame:
    return i.stg_players.select("person_id", "first_name", "last_name", "full_name", "primary_position", *_CARD)


@query
def stg_teams(i: Inputs) -> DataFrame:
    return i.stg_teams.select(
        "team_id", "team_city", "team_name", "full_name", "team_abbrev", "season_founded", "season_active_till", "league"
    )


# --- ratings and marts ---------------------------------------------------------------------------


@query
def player_impact_rating(i: Inputs) -> DataFrame:
    return rounded(i.rating)


@query
def zscore_by_season(i: Inputs) -> DataFrame:
    scores = [f"{m}_z" for m in impact.METRICS]
    return chosen(impact.season_scores(i.stg_player_games), "person_id", "season_year", *impact.METRICS, *scores)


@query
def player_season_stats(i: Inputs) -> DataFrame:
    return rounded(i.season_stats)


@query
def team_season_stats(i: Inputs) -> DataFrame:
    return rounded(marts.team_season_stats(i.stg_team_games))


@query
def head_to_head(i: Inputs) -> DataFrame:
    return rounded(marts.head_to_head(i.stg_games))


@query
def recent_performance(i: Inputs) -> DataFrame:
    return _rows(marts.recent_performance(i.stg_player_games, i.stg_players, AS_OF, ORDER, probe=i.player_keys))


@query
def player_value(i: Inputs) -> DataFrame:
    return rounded(marts.player_value(i.stg_players, i.rating))


@query
def unified_player(i: Inputs) -> DataFrame:
    return rounded(marts.unified_player(i.season_stats, i.rating))


def _in_loads(rows: DataFrame) -> list[DataFrame]:
    """Rows as three loads arrive: the history, and two later ones that each reach over several seasons."""
    late, month = F.col("game_date") >= instant(LOADED_UNTIL), F.month("game_date") % 5 == 0
    return [rows.filter(~late & ~month), rows.filter(~late & month), rows.filter(late)]


def _state_after_loads(spec: states.KeyedState, rows: DataFrame) -> DataFrame:
    first, *more = _in_loads(rows)
    state = cut_lineage(spec.state(first))
    for load in more:
        state = cut_lineage(spec.added(state, load))
    return state


@query
def player_season_by_loads(i: Inputs) -> DataFrame:
    state = _state_after_loads(increments.player_season(), i.stg_player_games)
    return rounded(increments.player_season_stats(state, i.stg_players, i.stg_teams))


@query
def team_season_by_loads(i: Inputs) -> DataFrame:
    return rounded(increments.team_season_stats(_state_after_loads(increments.team_season(), i.stg_team_games)))


@query
def head_to_head_by_loads(i: Inputs) -> DataFrame:
    return rounded(increments.head_to_head(_state_after_loads(increments.head_to_head_state(), i.stg_games)))


@query
def impact_rating_by_loads(i: Inputs) -> DataFrame:
    return rounded(increments.player_impact_rating(_state_after_loads(increments.efficiency(), i.stg_player_games)))


# --- features and form ---------------------------------------------------------------------------


@query
def player_rolling(i: Inputs) -> DataFrame:
    rolled = features.player_rolling(i.player_games, ORDER, probe=i.player_keys)
    return _rows(rolled.drop(*features.ROLLED_STATS))


@query
def player_trend(i: Inputs) -> DataFrame:
    trend = features.player_trend(i.player_games, ORDER, probe=i.player_keys)
    return _rows(trend.drop(*features.ROLLED_STATS))


@query
def player_rest_days(i: Inputs) -> DataFrame:
    return features.player_rest_days(i.player_games, ORDER, probe=i.player_keys)


@query
def player_features(i: Inputs) -> DataFrame:
    return _rows(features.player_features(i.player_games, ORDER, probe=i.player_keys))


@query
def game_features(i: Inputs) -> DataFrame:
    team_games = i.team_games
    return rounded(features.game_features(features.games_of(team_games, i.games), team_games))


@query
def game_labels(i: Inputs) -> DataFrame:
    return features.game_labels(i.games)


@query
def player_targets(i: Inputs) -> DataFrame:
    return features.player_targets(i.player_games, ORDER)


@query
def team_form(i: Inputs) -> DataFrame:
    return rounded(features.team_form(i.team_games))


@query
def player_form(i: Inputs) -> DataFrame:
    return rounded(features.player_form(i.player_games, ORDER))


@query
def train_team_frame(i: Inputs) -> DataFrame:
    return chosen(
        features.team_training_frame(i.team_games, i.games, TRAIN_SINCE), "game_id", "team_id", "game_date", "team_score",
        "opponent_score", "win", "field_goals_percentage", "home_team_id", "away_team_id", "home_score", "away_score",
    )


@query
def train_player_frame(i: Inputs) -> DataFrame:
    return features.player_training_frame(i.player_games, i.players, TRAIN_SINCE).select(
        "person_id", *ORDER, "points", "num_minutes", "first_name", "last_name"
    )


# --- leaders, pages, lookups ---------------------------------------------------------------------


@query
def league_leaders(i: Inputs) -> DataFrame:
    leaders = leaderboards.league_leaders(i.season_stats, i.stg_players, i.stg_teams, SEASON)
    return rounded(
        leaders.select(
            "person_id", "team_id", F.col("player.full_name").alias("player_name"), "player.primary_position",
            F.col("team.full_name").alias("team_name"), "team.team_abbrev", "games_played", "avg_points",
            "avg_assists", "avg_rebounds",
        )
    )


@query
def impact_leaders(i: Inputs) -> DataFrame:
    return rounded(leaderboards.impact_leaders(marts.player_value(i.stg_players, i.rating), SEASON))


@query
def search_page(i: Inputs) -> DataFrame:
    found = leaderboards.search_page(i.players, "LIER 0000", limit=10, offset=5)
    return found.select("person_id", "full_name", *_CARD, "total")


@query
def player_log_page(i: Inputs) -> DataFrame:
    return leaderboards.player_log_page(i.player_games, 7, ORDER, limit=10, offset=10)


def _searched(i: Inputs, text: str) -> DataFrame:
    named = i.stg_players.withColumn("full_name", strict_name(F.col("first_name"), F.col("last_name")))
    index = gram_index.stored_postings(named, "person_id", "full_name")
    return gram_index.containing(named, index, "person_id", "full_name", text)


@query
def search_by_grams(i: Inputs) -> DataFrame:
    found = paging.page(_searched(i, "LIER 0000"), [F.col("person_id")], limit=10, offset=5)
    return found.select("person_id", "full_name", *_CARD, "total")


@query
def search_by_pair(i: Inputs) -> DataFrame:
    return _searched(i, "07").select("person_id", "full_name")


def _deep_page(i: Inputs, limit: int, offset: int) -> DataFrame:
    newest = [F.col(c).desc() for c in [*ORDER, "person_id"]]
    rows = i.player_games.select("person_id", *ORDER, "points", "assists")
    return page_index.PageIndex.build(rows, newest, rows_per_range=2000).page(limit, offset)


@query
def deep_page(i: Inputs) -> DataFrame:
    return _deep_page(i, 40, 4980)


@query
def last_page(i: Inputs) -> DataFrame:
    return _deep_page(i, 500, 5700)


@query
def next_log_page(i: Inputs) -> DataFrame:
    """The page of a player's log that follows a given game, found by key."""
    log = i.player_games.filter(F.col("person_id") == 7).select(*ORDER, "points", "assists")
    last = {"game_date": dt.datetime(1998, 6, 1), "game_id": 0} | dict.fromkeys(ORDER[2:], 0)
    return paging.page_after(log, dict.fromkeys(ORDER, True), last, 10)


@query
def teams_page(i: Inputs) -> DataFrame:
    return leaderboards.teams_page(i.stg_teams, limit=10, offset=10)


@query
def team_roster(i: Inputs) -> DataFrame:
    roster = lookups.team_roster(i.stg_player_games, i.stg_players)
    return roster.select("team_id", "season_year", "person_id", "full_name", "primary_position", *_CARD)


@query
def player_profile(i: Inputs) -> DataFrame:
    return lookups.player_profile(i.stg_players, 7).drop("birthdate")


def _flat_games(games: DataFrame) -> DataFrame:
    return games.select(
        "game_id", "game_date", "home_team_id", "away_team_id", "home_score", "away_score",
        F.col("home_team.full_name").alias("home_name"), F.col("home_team.team_abbrev").alias("home_abbrev"),
        F.col("away_team.full_name").alias("away_name"), F.col("away_team.team_abbrev").alias("away_abbrev"),
    )


@query
def games_with_teams(i: Inputs) -> DataFrame:
    return _flat_games(lookups.games_with_teams(i.games, i.stg_teams))


@query
def games_on_date(i: Inputs) -> DataFrame:
    return _flat_games(lookups.games_on_date(i.games, i.stg_teams, dt.date(1998, 3, 5)))


def _flat_pairs(pairs: DataFrame) -> DataFrame:
    return rounded(
        pairs.select(
            "team_1_id", "team_2_id", F.col("team_1.full_name").alias("team_1_name"),
            F.col("team_2.full_name").alias("team_2_name"), "team_1_wins", "team_2_wins", "total_games",
            "avg_margin", "last_meeting",
        )
    )


@query
def head_to_head_named(i: Inputs) -> DataFrame:
    return _flat_pairs(lookups.head_to_head_named(marts.head_to_head(i.stg_games), i.stg_teams))


@query
def head_to_head_of(i: Inputs) -> DataFrame:
    return _flat_pairs(lookups.head_to_head_of(marts.head_to_head(i.stg_games), i.stg_teams, 11, 3))


# --- ingest --------------------------------------------------------------------------------------


@query
def latest_per_key(i: Inputs) -> DataFrame:
    newest = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    orders = i.table("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return keyed.latest_per_key(orders, ["o_custkey"], newest)


@query
def active_filter(i: Inputs) -> DataFrame:
    return active_teams(i.teams, 1999).drop("created_at", "updated_at")


@query
def lookup_build(i: Inputs) -> DataFrame:
    return team_lookup(i.teams, F.col("team_id"))


@query
def lookup_join(i: Inputs) -> DataFrame:
    """Ids to names and back: rows naming a team outside the league have no match."""
    names = i.teams.select("team_id", "team_city", "team_name")
    named = i.player_games.select("person_id", *ORDER, "team_id", "opponent_team_id")
    for side in ("team", "opponent_team"):
        renamed = names.select(
            F.col("team_id").alias(f"{side}_id"), F.col("team_city").alias(f"{side}_city"),
            F.col("team_name").alias(f"{side}_label"),
        )
        named = named.join(renamed, f"{side}_id").drop(f"{side}_id")
    lookup = measured(team_lookup(i.teams.filter(F.col("league") == LEAGUE), F.col("team_id")))
    for side in ("team", "opponent_team"):
        keys = {f"{side}_city": "team_city", f"{side}_label": "team_name"}
        named = keyed.lookup_join(named, lookup, keys, "team_id", f"{side}_id")
    return named


@query
def cast_nullable(i: Inputs) -> DataFrame:
    priority = F.col("o_orderpriority")
    return i.table("orders").select(
        "o_orderkey",
        whole(F.concat(F.substring(priority, 1, 1), F.lit(".0"))).alias("rank"),
        whole(priority).alias("unparsable"),
    )


@query
def cast_coerce_zero(i: Inputs) -> DataFrame:
    priority = F.col("o_orderpriority")
    mixed = F.when(F.col("o_orderstatus") == "F", priority).otherwise(F.substring(priority, 1, 1))
    return i.table("orders").select("o_orderkey", number_or_zero(mixed).alias("rank"))


def _redelivered(df: DataFrame) -> DataFrame:
    """Every row twice, as when one document is delivered again."""
    return df.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")


def _absent(df: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    loaded = df.filter(F.col("game_date") < instant(LOADED_UNTIL))
    return keyed.insert_if_absent(_redelivered(df), loaded, on, [F.col(c) for c in order])


@query
def insert_if_absent_games(i: Inputs) -> DataFrame:
    games = i.games.select("game_id", "game_date", "home_team_id", "away_team_id", "home_score", "away_score")
    return _absent(games, ["game_id"], ["game_date"])


@query
def insert_if_absent_players(i: Inputs) -> DataFrame:
    rows = i.player_games.select("person_id", *ORDER, "points")
    return _absent(rows, ["game_id", "person_id"], ORDER)


@query
def insert_if_absent_teams(i: Inputs) -> DataFrame:
    rows = i.team_games.select("game_id", "team_id", "game_date", "team_score", "opponent_score", "win")
    return _absent(rows, ["game_id", "team_id"], ["game_date"])


@query
def insert_if_absent_by_filter(i: Inputs) -> DataFrame:
    """The player rows to add, searched for only in the seasons whose key filter knows one of them."""
    key, rows = ["game_id", "person_id"], i.player_games.select("person_id", *ORDER, "points")
    seasoned = rows.withColumn(schemas.SEASON, F.year("game_date"))
    loaded = seasoned.filter(F.col("game_date") < instant(LOADED_UNTIL))
    filters = cut_lineage(key_filter.built(loaded.select(*key, schemas.SEASON), key))
    seasons = key_filter.possible_seasons(rows, filters, key)
    existing = loaded.filter(F.col(schemas.SEASON).isin(seasons))
    return keyed.insert_if_absent(_redelivered(rows), existing, key, [F.col(c) for c in ORDER])


@query
def ingest_json(i: Inputs) -> DataFrame:
    parsed = i.table("events").withColumn("doc", F.from_json("props", "k INT, absent INT"))
    return parsed.select(
        "event_id", F.col("ts").alias("game_date"), F.col("user_id").alias("person_id"), "event_type",
        counted("doc.k").alias("points"), counted("doc.absent").alias("assists"),
    )


def _dropped_documents(i: Inputs) -> DataFrame:
    """The daily documents, written to a drop folder and read back from it."""
    drop = scratch_folder(i.spark, "daily-drop")
    return read_daily_documents(i.spark, write_daily_document(tables.daily_documents(i.spark, i.folder), drop, AS_OF.isoformat()), per_line=True)


def _loaded_games(documents: DataFrame) -> DataFrame:
    return quality.split_required(daily.daily_games(documents), schemas.REQUIRED["games"])[0]


@query
def ingest_document_games(i: Inputs) -> DataFrame:
    return daily.daily_games(_dropped_documents(i)).select(
        "game_id", "game_date", "home_team_id", "away_team_id", "home_score", "away_score", "game_type"
    )


_DAILY_STATS = [
    "assists", "rebounds_total", "steals", "blocks", "field_goals_made", "field_goals_attempted", "three_pointers_made",
    "three_pointers_attempted", "free_throws_made", "free_throws_attempted", "fouls_personal", "turnovers",
]


@query
def ingest_document_players(i: Inputs) -> DataFrame:
    documents = _dropped_documents(i)
    return daily.daily_player_rows(documents, _loaded_games(documents), LOADED_AT).select(
        "game_id", "person_id", "team_id", "opponent_team_id", "game_date", "created_at", "points", "plus_minus_points", *_DAILY_STATS
    )


@query
def ingest_document_teams(i: Inputs) -> DataFrame:
    documents = _dropped_documents(i)
    return daily.daily_team_rows(documents, _loaded_games(documents), LOADED_AT).select(
        "game_id", "team_id", "opponent_team_id", "game_date", "created_at", "team_score", *_DAILY_STATS
    )


def _from_lines(i: Inputs) -> tuple[DataFrame, DataFrame]:
    lookup = measured(team_lookup(i.teams, F.col("team_id")))
    return rejects.player_rows(tables.player_lines(i.spark, i.folder), lookup)


@query
def typed_player_rows(i: Inputs) -> DataFrame:
    return rounded(_from_lines(i)[0].drop("id", "created_at"))


@query
def rejected_rows(i: Inputs) -> DataFrame:
    fields = F.split("line", ",")
    names = ["team_city", "team_name", "opponent_city", "opponent_name", "person", "game", "played"]
    shown = [F.get(fields, n).alias(name) for n, name in enumerate(names)]
    return _from_lines(i)[1].select(*shown, F.size(fields).alias("n_fields"), F.array_join("reasons", "; ").alias("reasons"))


@query
def reject_reasons(i: Inputs) -> DataFrame:
    return rejects.reason_counts(_from_lines(i)[1])


# --- data quality --------------------------------------------------------------------------------


@query
def dq_not_null(i: Inputs) -> DataFrame:
    return quality.null_rows(i.games, "home_score").select("game_id", "home_team_id", "away_team_id", "game_date")


@query
def dq_unique(i: Inputs) -> DataFrame:
    return quality.repeated_values(i.player_games, "game_id")


def _drafted(players: DataFrame) -> DataFrame:
    return players.filter(F.col("draft_year").isNotNull())


@query
def dq_relationships(i: Inputs) -> DataFrame:
    return quality.orphaned_values(i.player_games, "person_id", _drafted(i.players), "person_id")


@query
def dq_report(i: Inputs) -> DataFrame:
    games, player_games, rating = i.stg_games, i.player_games, i.rating
    check = quality.Check
    return quality.report(
        [
            check("games.game_id is set", games, "not_null", "game_id"),
            check("games.home_score is set", games, "not_null", "home_score"),
            check("games.game_id is unique", games, "unique", "game_id"),
            check("player_games.game_id is unique", player_games, "unique", "game_id"),
            check("rating.person_id is set", rating, "not_null", "person_id"),
            check("rating.season_year is set", rating, "not_null", "season_year"),
            check("rating.person_id is a player", rating, "relationships", "person_id", i.stg_players, "person_id"),
            check("player_games.person_id was drafted", player_games, "relationships", "person_id",
                  _drafted(i.players), "person_id"),
        ]
    )


# --- models --------------------------------------------------------------------------------------


@query
def feature_scaling(i: Inputs) -> DataFrame:
    matrix = cut_lineage(features.game_features(i.games, i.team_games))
    return rounded(ColumnScaler(inputCols=features.GAME_FEATURES).fit(matrix).transform(matrix))


@query
def train_split(i: Inputs) -> DataFrame:
    split = prediction.in_training("game_id").alias("in_training")
    return i.games.select("game_id", "game_date", split)


@query
def game_by_id(i: Inputs) -> DataFrame:
    return _flat_games(lookups.game_by_id(i.games, i.stg_teams, 321))


@query
def player_features_prior(i: Inputs) -> DataFrame:
    return _rows(features.player_features(i.player_games, ORDER, leak_free=True, probe=i.player_keys))


@query
def latest_player_features(i: Inputs) -> DataFrame:
    return _rows(features.latest_player_features(i.player_games, ORDER))


def _game_matrix(i: Inputs) -> DataFrame:
    rows = i.games.select("game_id", "game_date", "home_team_id", "away_team_id", "home_score", "away_score")
    return cut_lineage(features.prior_game_features(rows, i.team_games))


def _player_matrix(i: Inputs) -> DataFrame:
    targets = {f"target_{t}": F.coalesce(F.col(t), F.lit(0)).cast("double") for t in features.PLAYER_TARGETS}
    labelled = i.player_games.withColumns(targets)
    rows = features.player_features(labelled, ORDER, leak_free=True, probe=i.player_keys, carry=tuple(targets))
    # the nine key columns serve the split alone and would be a quarter of the stored bytes
    key = ["person_id", *ORDER]
    return cut_lineage(rows.withColumn(prediction.IN_TRAINING, prediction.in_training(*key)).drop(*key))


@query
def model_metrics(i: Inputs) -> DataFrame:
    games, key = _game_matrix(i), ["person_id", *ORDER]
    # stored, so that what the games' fit keeps is given up before the players' rows come
    measured_games = cut_lineage(prediction.game_model_metrics(prediction.fit_game_model(games), games))
    players = _player_matrix(i)
    return measured_games.unionByName(prediction.player_model_metrics(prediction.fit_player_model(players, key), players, key))


@query
def target_lines(i: Inputs) -> DataFrame:
    """Slope and start of each target by minutes played: all from one matrix."""
    targets = [t for t in features.PLAYER_TARGETS if t != "num_minutes"]
    fit = LinearTargets(inputCols=["num_minutes"], targetCols=targets, outputCols=[f"_{t}" for t in targets])
    model = fit.fit(features.player_targets(i.player_games, ORDER))
    rows = [(t, float(w[0]), b) for t, w, b in zip(targets, model.matrix(), model.getOrDefault("intercepts"), strict=True)]
    return rounded(i.spark.createDataFrame(rows, "target string, slope double, start double"))


@query
def game_training_legs(i: Inputs) -> DataFrame:
    legs = prediction.fit_best_game_model(_game_matrix(i), leg_iterations=10, most_legs=6, trees=2)[1]
    return i.spark.createDataFrame([dataclasses.astuple(leg) for leg in legs], "leg int, iterations int, held_out_loss double, best boolean")


@query
def predict_matchups(i: Inputs) -> DataFrame:
    pairs = i.games.select("game_id", F.col("away_team_id").alias("home_team_id"), F.col("home_team_id").alias("away_team_id"))
    return prediction.predict_matchups(prediction.fit_game_model(_game_matrix(i)), pairs, i.team_games)


@query
def predict_game(i: Inputs) -> DataFrame:
    matrix = _game_matrix(i)
    return prediction.predict_games(prediction.fit_game_model(matrix), matrix)


@query
def predict_player(i: Inputs) -> DataFrame:
    games = i.player_games
    model = prediction.fit_player_model(_player_matrix(i), ["person_id", *ORDER])
    current = features.latest_player_features(games, ORDER)
    projected = prediction.project_players(model, current, features.player_form(games, ORDER), ORDER)
    stats = [F.col("projections")[t].alias(t) for t in features.PLAYER_TARGETS]
    return projected.select("person_id", *stats, "confidence_score")
