"""Features and labels for game and player models, and current form of teams and players."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlake.functions.boxscore import projection_confidence
from courtlake.functions.calendar import since as on_or_after
from courtlake.operators.skew import HOT_ROWS, fits_broadcast, measured
from courtlake.operators.windows import (
    Timeline,
    history,
    history_columns,
    mean_of_earlier_days,
    over_timeline,
    rest_days,
    rolling_means,
    slope_of,
    top_per_key,
)
from courtlake.session import cut_lineage

# The statistics behind each model, in the order of the feature matrix.
TEAM_STATS = [
    "team_score", "opponent_score", "win", "field_goals_percentage", "three_pointers_percentage",
    "free_throws_percentage", "rebounds_total", "assists", "turnovers", "steals", "blocks",
]
ROLLED_STATS = [
    "points", "assists", "rebounds_total", "steals", "blocks", "field_goals_percentage",
    "three_pointers_percentage", "free_throws_percentage", "turnovers", "num_minutes",
]
PLAYER_TARGETS = [
    "points", "assists", "rebounds_total", "steals", "blocks", "field_goals_made", "field_goals_attempted",
    "three_pointers_made", "three_pointers_attempted", "free_throws_made", "free_throws_attempted", "turnovers",
    "fouls_personal", "num_minutes", "plus_minus_points",
]

GAME_FEATURES = [f"{c}_{side}" for side in ("home", "away") for c in ["team_id", *TEAM_STATS]]
PLAYER_FEATURES = [f"{c}{s}" for c in ROLLED_STATS for s in ("_5_game_avg", "_10_game_avg", "_trend")] + [
    "opp_def_rating", "rest_days", "home_away_diff",
]
_PLAYER = ["person_id"]


def _as_number(name: str) -> Column:
    return F.col(name).cast("double")


# --- games ---------------------------------------------------------------------------------------


def team_training_frame(team_games: DataFrame, games: DataFrame, since: dt.date) -> DataFrame:
    """Team box scores from a date on, with the sides and score of their game."""
    sides = games.select("game_id", "home_team_id", "away_team_id", "home_score", "away_score")
    return team_games.filter(on_or_after(F.col("game_date"), since)).join(sides, "game_id")


def games_of(team_games: DataFrame, games: DataFrame) -> DataFrame:
    """The distinct games behind team rows. Ids are made distinct before they meet the games."""
    sides = games.select("game_id", "home_team_id", "away_team_id", "home_score", "away_score")
    return team_games.select("game_id").distinct().join(sides, "game_id")


def team_averages(team_games: DataFrame) -> DataFrame:
    return team_games.groupBy("team_id").agg(*[F.avg(_as_number(c)).alias(c) for c in TEAM_STATS])


def _side(averages: DataFrame, side: str, extra: list[str]) -> DataFrame:
    renamed = [F.col(c).alias(f"{c}_{side}") for c in TEAM_STATS]
    return averages.select(F.col("team_id").alias(f"{side}_team_id"), *extra, *renamed)


def _with_sides(games: DataFrame, averages: DataFrame, extra: list[str]) -> DataFrame:
    averages = measured(averages)
    wide = games
    for side in ("home", "away"):
        wide = wide.join(_side(averages, side, extra), [f"{side}_team_id", *extra])
        wide = wide.withColumn(f"team_id_{side}", F.col(f"{side}_team_id"))
    return wide


def game_features(games: DataFrame, team_games: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """24 features per game: team id and 11 averages over all games, for each side.

    For games still to come, all averages are of the past. ``carry`` names columns to keep.
    """
    wide = _with_sides(games, team_averages(team_games), [])
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in GAME_FEATURES]
    return wide.select("game_id", *carry, *filled)


def prior_team_averages(team_games: DataFrame) -> DataFrame:
    """Per team and day: averages over the games of earlier days.

    Daily sums come first; the running window then holds one row per team and calendar day.
    """
    daily = team_games.groupBy("team_id", F.to_date("game_date").alias("day")).agg(
        *[F.sum(_as_number(c)).alias(f"_sum_{c}") for c in TEAM_STATS],
        *[F.count(c).alias(f"_n_{c}") for c in TEAM_STATS],
    )
    before = Window.partitionBy("team_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    means = [
        (F.sum(f"_sum_{c}").over(before) / F.nullif(F.sum(f"_n_{c}").over(before), F.lit(0))).alias(c)
        for c in TEAM_STATS
    ]
    return daily.select("team_id", "day", *means)


def prior_game_features(games: DataFrame, team_games: DataFrame) -> DataFrame:
    """The features of ``game_features`` from earlier days only, so that no game sees itself."""
    dated = games.withColumn("day", F.to_date("game_date"))
    wide = _with_sides(dated, prior_team_averages(team_games), ["day"])
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in GAME_FEATURES]
    return wide.select(*games.columns, *filled)


def game_labels(games: DataFrame) -> DataFrame:
    """Home win flag (0 when the score is unknown) and both scores."""
    return games.select(
        "game_id",
        F.when(F.col("home_score") > F.col("away_score"), 1).otherwise(0).alias("home_win"),
        "home_score",
        "away_score",
    )


# --- players -------------------------------------------------------------------------------------


def player_training_frame(player_games: DataFrame, players: DataFrame, since: dt.date) -> DataFrame:
    """Player box scores from a date on, with the player's names."""
    names = players.select("person_id", "first_name", "last_name")
    return player_games.filter(on_or_after(F.col("game_date"), since)).join(names, "person_id")


def _means(line: Timeline, n: int, leak_free: bool = False) -> list[Column]:
    frame = line.prior(n) if leak_free else line.last(n)
    return rolling_means(frame, ROLLED_STATS, f"_{n}_game_avg")


def _with_slopes(wide: DataFrame, first: int = 0, n: int = 5) -> DataFrame:
    """Trends over ``n`` rows, the newest ``first`` rows ago, in place of the history columns."""
    slopes = [slope_of(c, first, first + n - 1).alias(f"{c}_trend") for c in ROLLED_STATS]
    return wide.select("*", *slopes).drop(*history_columns(ROLLED_STATS, first + n - 1))


def player_rolling(
    player_games: DataFrame, order: list[str], floor_rows: int = HOT_ROWS, probe: DataFrame | None = None
) -> DataFrame:
    """Means over the last 5 and 10 games of ten statistics."""
    rows = player_games.select("person_id", *order, *ROLLED_STATS)
    build = lambda line: [*_means(line, 5), *_means(line, 10)]
    return over_timeline(rows, _PLAYER, "game_date", order, 9, build, floor_rows, probe)


def player_trend(
    player_games: DataFrame, order: list[str], floor_rows: int = HOT_ROWS, probe: DataFrame | None = None
) -> DataFrame:
    """Slope over the last 5 games of ten statistics."""
    rows = player_games.select("person_id", *order, *ROLLED_STATS)
    build = lambda line: history(line, ROLLED_STATS, 4)
    return _with_slopes(over_timeline(rows, _PLAYER, "game_date", order, 4, build, floor_rows, probe))


def player_rest_days(
    player_games: DataFrame, order: list[str], floor_rows: int = HOT_ROWS, probe: DataFrame | None = None
) -> DataFrame:
    rows = player_games.select("person_id", *order)
    build = lambda line: [rest_days(line, "game_date").alias("rest_days")]
    return over_timeline(rows, _PLAYER, "game_date", order, 1, build, floor_rows, probe)


def _scoring_context(player_games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean points against each opponent, and each player's home minus away mean.

    Both derive from one pre-aggregate per player and opponent, so the box scores are read once.
    """

    def part(name: str, chosen: Column | None = None) -> list[Column]:
        points = F.col("points") if chosen is None else F.when(chosen, F.col("points"))
        return [F.sum(points).alias(f"{name}_sum"), F.count(points).alias(f"{name}_n")]

    def mean(name: str) -> Column:
        return F.sum(f"{name}_sum") / F.nullif(F.sum(f"{name}_n"), F.lit(0))

    parts = player_games.groupBy("person_id", "opponent_team_id").agg(
        *part("all"), *part("home", F.col("home")), *part("away", ~F.col("home"))
    )
    parts = cut_lineage(parts)
    opponents = parts.groupBy("opponent_team_id").agg(mean("all").alias("opp_def_rating"))
    players = parts.groupBy("person_id").agg((mean("home") - mean("away")).alias("home_away_diff"))
    # Neither aggregate can have more rows than the parts.
    if fits_broadcast(parts):
        return F.broadcast(opponents), F.broadcast(players)
    return measured(opponents), measured(players)


def _earlier_days(player_games: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Per key and day: each sum over the rows of earlier days, and the number of known values.

    Daily sums come first, so the running window holds one row per key and calendar day.
    """
    daily = player_games.groupBy(F.col(key).alias(f"_{key}"), F.to_date("game_date").alias("_day")).agg(
        *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()],
        *[F.count(c).alias(f"_n_{name}") for name, c in sums.items()],
    )
    before = Window.partitionBy(f"_{key}").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    means = [
        (F.sum(f"_sum_{name}").over(before) / F.nullif(F.sum(f"_n_{name}").over(before), F.lit(0))).alias(name)
        for name in sums
    ]
    return daily.select(f"_{key}", "_day", *means)


def _home_and_away() -> dict[str, Column]:
    points = F.col("points")
    return {"_home": F.when(F.col("home"), points), "_away": F.when(~F.col("home"), points)}


def _with_prior_scoring(rows: DataFrame, player_games: DataFrame) -> DataFrame:
    """Add opponent strength and home edge as they stood before the day of each row.

    The means behind the home edge are ``_home`` and ``_away``, where ``rows`` does not have them.
    """
    tables = {"opponent_team_id": {"opp_def_rating": F.col("points")}}
    if "_home" not in rows.columns:
        tables["person_id"] = _home_and_away()
    day = F.to_date("game_date")
    for key, sums in tables.items():
        same = F.col(key).eqNullSafe(F.col(f"_{key}")) & day.eqNullSafe(F.col("_day"))
        rows = rows.join(measured(_earlier_days(player_games, key, sums)), same, "left").drop(f"_{key}", "_day")
    return rows.withColumn("home_away_diff", F.col("_home") - F.col("_away"))


def opponent_strength(player_games: DataFrame) -> DataFrame:
    """Mean points scored against each team."""
    return player_games.groupBy("opponent_team_id").agg(F.avg("points").alias("opp_def_rating"))


def player_features(
    player_games: DataFrame,
    order: list[str],
    leak_free: bool = False,
    floor_rows: int = HOT_ROWS,
    probe: DataFrame | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """33 features per player game: rolling means, trends, opponent strength, rest, home edge.

    By default the frames include the row's own game, and opponent strength and home edge come from
    all games. ``leak_free=True`` ends the frames one game earlier and takes both from the games of
    earlier days: the home edge by a window beside the others, unless a timeline is crowded. ``carry``
    names further columns to keep.
    """

    first = 1 if leak_free else 0

    def build(line: Timeline) -> list[Column]:
        means = [*_means(line, 5, leak_free), *_means(line, 10, leak_free)]
        if leak_free and line.whole:
            means += mean_of_earlier_days(_PLAYER, "game_date", _home_and_away())
        return [*means, *history(line, ROLLED_STATS, 4 + first), rest_days(line, "game_date").alias("rest_days")]

    needed = dict.fromkeys(["person_id", *order, "opponent_team_id", *ROLLED_STATS, *carry])
    rows = player_games.select(*needed, *(["home"] if leak_free and "home" not in needed else []))
    wide = over_timeline(rows, _PLAYER, "game_date", order, 9 + first, build, floor_rows, probe)
    rolled = _with_slopes(wide, first)
    if leak_free:
        wide = _with_prior_scoring(rolled, player_games)
    else:
        opponents, players = _scoring_context(player_games)
        wide = rolled.join(opponents, "opponent_team_id", "left").join(players, _PLAYER, "left")
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PLAYER_FEATURES]
    return wide.select("person_id", *order, *[c for c in carry if c not in order], *filled)


def latest_player_features(player_games: DataFrame, order: list[str]) -> DataFrame:
    """The features of each player's latest game, as in ``player_features``.

    Frames reach ten rows back at most, so only those rows of a player pass the windows; they are
    limited per task before the shuffle. Opponent strength and home edge still come from all games.
    """
    newest = [F.col(c).desc() for c in order]
    recent = top_per_key(player_games, _PLAYER, newest, 11)

    def build(line: Timeline) -> list[Column]:
        return [*_means(line, 5), *_means(line, 10), *history(line, ROLLED_STATS, 4), rest_days(line, "game_date").alias("rest_days")]

    rows = recent.select(*dict.fromkeys(["person_id", *order, "opponent_team_id", *ROLLED_STATS]))
    spec = Window.partitionBy("person_id").orderBy(*order)
    wide = rows.select("*", *build(Timeline(spec, 10, F.lit(None), F.lit(None))))
    latest = top_per_key(_with_slopes(wide), _PLAYER, newest, 1)
    opponents, players = _scoring_context(player_games)
    wide = latest.join(opponents, "opponent_team_id", "left").join(players, _PLAYER, "left")
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PLAYER_FEATURES]
    return wide.select("person_id", *order, *filled)


def player_targets(player_games: DataFrame, order: list[str]) -> DataFrame:
    """The 15 statistics to predict; a missing one counts as 0."""
    targets = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in PLAYER_TARGETS]
    return player_games.select("person_id", *order, *targets)


# --- form ----------------------------------------------------------------------------------------


def team_form(team_games: DataFrame, n: int = 10) -> DataFrame:
    """Seven means over each team's last ``n`` games. An unknown result counts as not won."""
    latest = [F.col("game_date").desc(), F.col("game_id").desc()]
    means = {
        "avg_points_scored": F.col("team_score"),
        "avg_points_allowed": F.col("opponent_score"),
        "win_rate": F.when(F.col("win"), 1).otherwise(0),
        "avg_fg_percentage": F.col("field_goals_percentage"),
        "avg_rebounds": F.col("rebounds_total"),
        "avg_assists": F.col("assists"),
        "avg_turnovers": F.col("turnovers"),
    }
    recent = top_per_key(team_games, ["team_id"], latest, n)
    return recent.groupBy("team_id").agg(*[F.avg(c).alias(name) for name, c in means.items()])


def player_form(player_games: DataFrame, order: list[str], n: int = 15, minimum: int = 5) -> DataFrame:
    """Means over each player's last ``n`` games; players with fewer than ``minimum`` are absent.

    ``recent_form`` is the mean of the oldest five of those games; ``latest_5_avg`` that of the
    newest five.
    """
    latest = [F.col(c).desc() for c in order]
    recent = top_per_key(player_games, _PLAYER, latest, n, rank="_rank")
    means = {
        "avg_points": "points", "avg_assists": "assists", "avg_rebounds": "rebounds_total",
        "avg_minutes": "num_minutes", "fg_percentage": "field_goals_percentage",
    }
    per_player = recent.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("games"),
        *[F.avg(c).alias(name) for name, c in means.items()],
        F.stddev_samp("points").alias("points_spread"),
        F.avg(F.when(F.col("_rank") <= 5, F.col("points"))).alias("latest_5_avg"),
        # The oldest five are the highest ranks; how many there are is known only per player.
        F.sort_array(F.collect_list(F.struct("_rank", "points")), asc=False).alias("_ranked"),
    )
    oldest = F.slice("_ranked", 1, 5)["points"]
    known = F.filter(oldest, lambda p: p.isNotNull())
    form = F.aggregate(known, F.lit(0).cast("bigint"), lambda total, p: total + p) / F.nullif(F.size(known), F.lit(0))
    return (
        per_player.filter(F.col("games") >= minimum)
        .withColumns({"recent_form": form, "confidence_score": projection_confidence(F.col("points_spread"))})
        .drop("_ranked")
    )
